"""Plans over stored samples: what is read, and what is shuffled."""

import pytest

from checks import registry
from lakeassess.functions import donors
from lakeassess.operators.ammonia import ammonia_acute
from lakeassess.operators.chronic import with_chronic_standards
from lakeassess.operators.dependent import hardness_dependent
from lakeassess.operators.prepare import prepare_samples
from lakeassess.operators.standards import acute_single_value
from lakeassess.operators.sulfate import sulfate_standards
from lakeassess.operators.thermocline import thermocline
from lakeassess.sources.storage import keep


@pytest.fixture()
def stored(prepared):
    rows = [{"analyte": a, "result_value": 1.0} for a in ("PH", "IRON", "AMMONIA-NITROGEN")]
    return keep(prepared(rows), "prepared", ["analyte"])


@pytest.fixture()
def standards(spark):
    return keep(spark.createDataFrame(
        [("IRON", None, 1.0, "mg/L", 0.8, "mg/L")],
        "Analyte string, sample_fraction string, acute_standard double, acute_units string, "
        "chronic_standard double, chronic_units string",
    ), "standards")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_wise_checks_do_not_shuffle(stored, standards):
    assert "Exchange hashpartitioning" not in plan(hardness_dependent(stored))
    assert "Exchange hashpartitioning" not in plan(acute_single_value(stored, standards))
    assert "Exchange hashpartitioning" not in plan(with_chronic_standards(stored, standards))


def test_analyte_filters_reach_the_scan(stored, standards):
    for df in (
        hardness_dependent(stored),
        ammonia_acute(stored),
        thermocline(stored),
        acute_single_value(stored, standards),
        with_chronic_standards(stored, standards),
    ):
        pushed = plan(df).split("PushedFilters: ")[1].split("]")[0]
        assert "analyte" in pushed


def test_narrow_reads(stored):
    columns = plan(thermocline(stored)).split("ReadSchema: ")[1].split(">")[0]
    assert columns.count(":") == 7 and "hardness" not in columns
    columns = plan(sulfate_standards(stored)).split("ReadSchema: ")[1].split(">")[0]
    assert "sample_depth" not in columns and "qualifiers" not in columns


def test_shuffle_counts(stored):
    assert plan(ammonia_acute(stored)).count("Exchange hashpartitioning") == 1
    assert plan(thermocline(stored)).count("Exchange hashpartitioning") == 2


def test_summary_shuffles_its_checks_once(spark):
    from lakeassess.operators.summary import FINDING, exceedance_summary
    from pyspark.sql import functions as F

    check = spark.range(9).select(
        *[F.col("id").alias(c) for c in FINDING], F.lit("EXCEEDANCE").alias("standard_violation")
    )
    text = plan(exceedance_summary(check, check, check, check))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    twice = check.union(check)
    assert exceedance_summary(check, twice, check, check).count() == 18


def test_listed_analytes_need_no_list(spark, prepared):
    from lakeassess.operators.standards import only_listed_analytes
    from pyspark.sql import functions as F

    names = spark.range(3000).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("Analyte"))
    data = prepared([{"analyte": a} for a in ("IRON", "N5", "N2999", "ZINC", None)])
    assert sorted(r.analyte for r in only_listed_analytes(data, names, ("ZINC",)).collect()) == ["N2999", "N5", "ZINC"]
    with_null = names.union(spark.createDataFrame([(None,)], "Analyte string"))
    assert only_listed_analytes(data, with_null).where("analyte is null").count() == 1


def test_standards_override_reads_lines_once(spark):
    from checks.registry import QUERIES

    text = plan(QUERIES["standards_override"](spark, "/root/testdata/sf0.001"))
    assert text.count("lineitem.parquet") == 1 and "SinglePartition" not in text


def test_samples_are_not_sorted_to_meet_their_hardness(spark, samples, stations):
    """Beyond the limit of a broadcast, small shares of the visits' records are hashed instead."""
    days = [{"mlid": f"S{i % 50}", "analyte": "Alkalinity, total" if i % 5 == 0 else "Iron", "result_value": float(i)} for i in range(600)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prepared = prepare_samples(samples(days), stations)
        assert len(prepared.collect()) == 600
        final = prepared._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in final
    assert "SortMergeJoin" not in final


def test_sulfate_moves_and_keeps_its_own_columns(spark, monkeypatch):
    kept = {}

    def spy(df, name, *args):
        kept[name] = df.columns
        return df

    monkeypatch.setattr(registry, "keep", spy)
    registry.sulfate_standard(spark, "/root/testdata/sf0.001")
    assert kept == {"columns": ["mlid", "start_date", "analyte", "result_value", "hardness"]}
    registry.sulfate_checks(spark, "/root/testdata/sf0.001")
    assert kept["columns"] == [*registry.ACUTE, "hardness"]


def test_donors_of_hardness_are_found_by_their_analyte_first(spark, monkeypatch):
    plans = {}

    def spy(df, name, *args):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name, *args)

    monkeypatch.setattr(donors, "keep", spy)
    assert registry.Lake(spark, "/root/testdata/sf0.001").prepared.columns[-1] == "hardness"
    # Lines of other analytes leave at the code table, before any rule looks at them.
    assert "Join Inner" in plans["donors"]
