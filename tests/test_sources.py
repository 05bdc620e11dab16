from datetime import date

import pytest
from pyspark.sql import functions as F

from lakeassess.plans.assessment import Inputs, assess, run
from lakeassess.params import AssessmentParams
from lakeassess.sources.columns import map_macrophyte_columns, map_sample_columns
from lakeassess.sources.storage import RESULT_TABLES, keep, read_results, shared_folder, write_results
from lakeassess.sources.tables import MACROPHYTE_START_ROW, SAMPLES_START_ROW, read_standards, read_stations, read_table

HEADER = (
    "Monitoring Location ID,Activity Start Date,Activity Start Time,Activity Depth/Height,"
    "Activity Depth/Height Unit,Characteristic Name,Sample Fraction,Result Value,Result Unit,Result Comment,"
    "Detection Limit Type 1,Detection Limit Value 1,Detection Limit Unit 1,"
    "Detection Limit Type 2,Detection Limit Value 2,Detection Limit Unit 2"
)


def sample_line(i, analyte, value, month=6, fraction="Total"):
    return f'S1,{43831 + 30 * month},0.5,1,m,"{analyte}",{fraction},{value},mg/L,,,,,,,'


@pytest.fixture()
def folder(tmp_path):
    lines = ["Lake sampling results, 2020", HEADER]
    for month in range(1, 12):
        lines.append(sample_line(0, "Chlorophyll a, corrected for pheophytin", 3 + month, month))
        lines.append(sample_line(0, "Iron", 2 if month == 5 else 0.5, month))
    (tmp_path / "samples.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "macrophytes.csv").write_text(
        "Basin Code,Collection Date,Percent Macrophyte Cover\n"
        + "\n".join(f"A,{43831 + 30 * m},20" for m in range(1, 12))
        + "\n"
    )
    (tmp_path / "stations.csv").write_text("StationCode,AUID,Name\nS1,IL_A,Dock\n")
    (tmp_path / "standards.csv").write_text(
        "Analyte,sample_fraction,acute_standard,acute_units,chronic_standard,chronic_units\nIRON,,1,mg/L,1,mg/L\n"
    )
    return tmp_path


def test_csv_with_title_line(spark, folder):
    table = read_table(spark, str(folder / "samples.csv"), SAMPLES_START_ROW)
    assert table.columns[:4] == ["row_id", "monitoring_location_id", "activity_start_date", "activity_start_time"]
    assert table.count() == 22
    assert table.select("row_id").distinct().count() == 22
    values = [r.result_value for r in table.orderBy("row_id").collect()]
    assert values[:4] == ["4", "0.5", "5", "0.5"]


def test_csv_folder_and_blank_lines(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text('\n\nTitle\n\n"A, x",B,B\n1,2,3\n,,\n4,5,6\n')
    table = read_table(spark, str(tmp_path), 4, "csv")
    assert table.columns == ["row_id", "a_x", "b", "b_2"]
    assert sorted(r.a_x or "" for r in table.collect()) == ["", "", "1", "1", "4", "4"]
    (tmp_path / "empty.csv").write_text("only a title\n")
    with pytest.raises(ValueError, match="no header"):
        read_table(spark, str(tmp_path / "empty.csv"), 2)


@pytest.mark.parametrize("kind", ["parquet", "orc", "json"])
def test_other_formats(spark, tmp_path, kind):
    path = str(tmp_path / f"t.{kind}")
    spark.createDataFrame([(1, "x")], "`Result Value` int, Site string").write.format(kind).save(path)
    table = read_table(spark, path)
    assert sorted(table.columns) == ["result_value", "row_id", "site"]


def test_given_row_ids_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(42, "x")], "row_id int, s string").write.parquet(path)
    assert read_table(spark, path).first().row_id == 42


def test_keep_round_trip(spark):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    kept = keep(df, "numbers", ["v"])
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()


def test_unknown_result_table(spark, tmp_path):
    with pytest.raises(ValueError, match="other"):
        write_results({"other": spark.range(1)}, str(tmp_path))


def inputs(spark, folder, macrophytes=True):
    return Inputs(
        samples=keep(
            map_sample_columns(read_table(spark, str(folder / "samples.csv"), SAMPLES_START_ROW)), "samples"
        ),
        stations=read_stations(spark, str(folder / "stations.csv")),
        standards=read_standards(spark, str(folder / "standards.csv")),
        macrophytes=map_macrophyte_columns(
            read_table(spark, str(folder / "macrophytes.csv"), MACROPHYTE_START_ROW)
        )
        if macrophytes
        else None,
    )


def test_whole_assessment_from_files(spark, folder):
    out = str(folder / "results")
    paths = run(inputs(spark, folder), out)
    assert paths == [f"{out}/{name}" for name in RESULT_TABLES]
    acute = spark.read.parquet(f"{out}/acute_results")
    assert acute.count() == 11 and acute.where("standard_violation = 'EXCEEDANCE'").count() == 1
    chronic = spark.read.parquet(f"{out}/chronic_results").where("standard_violation = 'EXCEEDANCE'").collect()
    assert [(r.start_date, round(r.chronic_event_duration)) for r in chronic] == [(date(2020, 5, 30), 40)]
    tsi = spark.read.parquet(f"{out}/tsi_results").first()
    assert (tsi.AUID, tsi.median_analyte, tsi.mean_coverage) == ("IL_A", 9.0, 20.0)
    with pytest.raises(Exception, match="exist"):
        run(inputs(spark, folder), out)


def test_trophic_state_is_optional(spark, folder):
    without = inputs(spark, folder, macrophytes=False)
    assert list(assess(without, AssessmentParams(trophic_state=False))) == list(RESULT_TABLES[:-1])
    with pytest.raises(ValueError, match="Macrophyte"):
        assess(without)


def test_overrides_reach_the_checks(spark, folder):
    base = inputs(spark, folder, macrophytes=False)
    edits = spark.createDataFrame([("IRON", None, 0.1)], "Analyte string, sample_fraction string, acute_standard double")
    edited = Inputs(base.samples, base.stations, base.standards, overrides=edits)
    acute = assess(edited, AssessmentParams(trophic_state=False))["acute_results"]
    assert acute.where("standard_violation = 'EXCEEDANCE'").count() == 11


def cells(table):
    return [tuple(r)[1:] for r in table.orderBy("row_id").collect()]


def test_rows_like_the_title_or_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Lake report\n\nSite,Value,\nx,1,p\nLake report,,\nSite,Value,\n,,\n")
    table = read_table(spark, str(tmp_path / "a.csv"), 2)
    assert table.columns == ["row_id", "site", "value", "x"]
    assert cells(table) == [("x", "1", "p"), ("Lake report", None, None), ("Site", "Value", None), (None, None, None)]


def test_files_of_other_order_and_depth(spark, tmp_path):
    folder = tmp_path / "my data"
    folder.mkdir()
    (folder / "a 1%.csv").write_text("T\nSite,Value\nx,1\n")
    (folder / "b.csv").write_text("T\n" + "\n" * 150 + "Value,Site\n2,y\nT\n")
    table = read_table(spark, str(folder), 2, "csv")
    assert sorted((r.site or "", r.value or "") for r in table.collect()) == [("", "T"), ("x", "1"), ("y", "2")]
    (folder / "c.csv").write_text("T\nSite,Depth\nx,1\n")
    with pytest.raises(ValueError, match="other columns"):
        read_table(spark, str(folder), 2, "csv")


def test_large_file_in_several_blocks(spark, tmp_path):
    lines = ["Title", "Key,Text", *[f'{i},"t, {i}"' for i in range(5000)]]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        table = read_table(spark, str(tmp_path / "a.csv"), 2)
        assert cells(table) == [(str(i), f"t, {i}") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_kept_tables_are_removed(spark):
    import os

    from lakeassess.sources.storage import kept_tables

    with kept_tables(spark):
        path = keep(spark.range(3), "short").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def failing(spark):
    return spark.range(3).selectExpr("if(id = 2, raise_error('broken'), id) AS id")


def test_a_failing_table_leaves_no_result(spark, tmp_path):
    out = tmp_path / "results"
    results = {name: spark.range(2) for name in RESULT_TABLES}
    results[RESULT_TABLES[4]] = failing(spark)
    with pytest.raises(Exception, match="broken"):
        write_results(results, str(out))
    assert list(tmp_path.iterdir()) == []


def test_results_are_replaced_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "results")
    write_results({name: spark.range(2) for name in RESULT_TABLES}, out)
    assert list(read_results(spark, out)) == list(RESULT_TABLES)
    with pytest.raises(FileExistsError):
        write_results({RESULT_TABLES[0]: spark.range(5)}, out)
    with pytest.raises(Exception, match="broken"):
        write_results({RESULT_TABLES[0]: spark.range(5), RESULT_TABLES[1]: failing(spark)}, out, "overwrite")
    assert [t.count() for t in read_results(spark, out).values()] == [2] * len(RESULT_TABLES)
    write_results({RESULT_TABLES[0]: spark.range(5)}, out, "overwrite")
    assert {name: t.count() for name, t in read_results(spark, out).items()} == {RESULT_TABLES[0]: 5}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["results"]
    with pytest.raises(ValueError):
        write_results({RESULT_TABLES[0]: spark.range(5)}, out, "append")
