from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import column
from lakeassess.operators.prepare import prepare_samples, usable_samples
from lakeassess.sources.columns import map_macrophyte_columns, map_sample_columns

DAY = date(2020, 6, 1)


def test_usability_of_every_qualifier(samples, stations):
    expected = {
        None: "Usable",
        "S": "Usable",
        "C": "Usable",
        "TNTC": "Usable",
        "Q,S": "Usable",
        "A": "Conditional Use",
        "J": "Conditional Use",
        "J5": "Conditional Use",
        "J6": "Conditional Use",
        "B2": "Conditional Use",
        "L1": "Conditional Use",
        "ND": "Conditional Use",
        "Trip ID: 7 | J5": "Conditional Use",
        "trip id: 7 | x | K": "Conditional Use",
        # dropped
        "Q": None,
        "J1": None,
        "J,Q": None,
        "J8": None,
        "W": None,
        "": None,
        "zz": None,
        "Trip ID: 7 |": None,
        "Trip ID: 7 | Q": None,
    }
    # Without a pipe the trip number stays; its capital T, I and D then count.
    expected["Trip ID: 7"] = "Conditional Use"
    rows = [{"qualifiers": q, "analyte": "PH", "result_value": 7.0} for q in expected]
    kept = {r.row_id: r.data_usability for r in usable_samples(samples(rows), stations).collect()}
    assert {i: kept.get(i) for i in range(len(rows))} == dict(enumerate(expected.values()))


def test_units_per_kilogram_and_missing_units_are_dropped(samples, stations):
    rows = [{"result_unit": u, "analyte": "PH", "result_value": 7.0} for u in ("mg/L", "mg/kg", "mg/kg dry", None)]
    assert column(usable_samples(samples(rows), stations), "row_id") == [0, 2]


def test_non_detects(samples, stations):
    base = {"analyte": "IRON", "qualifiers": "ND", "limit_value_1": 0.02}
    rows = [
        base,
        {**base, "result_value": 3.0},
        {**base, "limit_type_1": "Lower Reporting Limit"},
        {**base, "qualifiers": "J"},
        {**base, "qualifiers": None},
    ]
    assert column(usable_samples(samples(rows), stations), "result_value") == [0.01, 3.0, None, None, None]


def test_water_body(samples, stations, spark):
    rows = [{"mlid": m, "analyte": "PH"} for m in ("S1", "RHL", "RGF-2", "WTP-1", "unknown", None)]
    with_null = stations.union(spark.createDataFrame([(None, "IL_NULL")], "a string, b string"))
    assert column(usable_samples(samples(rows), with_null), "AUID") == [
        "IL_A", "IL_RHL", "IL_RGF", "IL_WTP", None, "IL_NULL",
    ]


@pytest.mark.parametrize("partitions", [1, 5])
def test_hardness_fills_the_visit_in_input_order(samples, stations, partitions):
    visit = {"start_date": DAY}
    rows = [
        {**visit, "analyte": "Iron"},
        {**visit, "analyte": "Alkalinity, Total", "result_value": 90.0},
        {**visit, "analyte": "Copper"},
        {**visit, "analyte": "Alkalinity, Total", "result_value": 110.0},
        {**visit, "analyte": "Zinc"},
        {"start_date": date(2020, 6, 2), "analyte": "Zinc"},
        {"start_date": None, "analyte": "Alkalinity, total", "result_value": 5.0},
        {"start_date": None, "analyte": "Zinc"},
    ]
    out = prepare_samples(samples(rows).repartition(partitions), stations)
    assert column(out, "hardness") == [90.0, 90.0, 90.0, 110.0, 110.0, None, 5.0, 5.0]
    assert column(out, "analyte")[1] == "ALKALINITY, TOTAL"


def test_text_alkalinity_is_filled_as_reported(samples, stations):
    """Text that is no number occupies its place; only later does it count as missing."""
    rows = [
        {"start_date": DAY, "analyte": "Alkalinity, total", "result_value": "high"},
        {"start_date": DAY, "analyte": "Zinc", "result_value": "3"},
        {"start_date": DAY, "analyte": "Alkalinity, total", "result_value": "80"},
    ]
    out = prepare_samples(samples(rows, text_results=True), stations)
    assert column(out, "hardness") == ["high", "high", "80"]


def test_spreadsheet_dates_and_times(spark, stations, samples):
    raw = samples([{"analyte": "PH", "result_value": 7.0}]).withColumns(
        {"start_date": F.lit(43831.0), "start_time": F.lit(0.5)}
    )
    row = usable_samples(raw, stations).first()
    assert (row.start_date, row.start_time) == (date(2020, 1, 1), 43200)


def test_column_mapping(spark):
    from lakeassess.schema import SAMPLE_COLUMNS

    raw = spark.createDataFrame([tuple(range(18))], [*SAMPLE_COLUMNS.values(), "row_id", "site"])
    mapped = map_sample_columns(raw, {"mlid": "site"})
    assert mapped.columns == ["row_id", *SAMPLE_COLUMNS]
    assert mapped.first().mlid == 17
    with pytest.raises(ValueError, match="mlid"):
        map_sample_columns(raw, {"mlid": None})
    with pytest.raises(ValueError, match="result_value"):
        map_sample_columns(raw.drop("result_value"))
    with pytest.raises(ValueError, match="depth"):
        map_sample_columns(raw, {"depth": "site"})


def test_macrophyte_mapping(spark):
    raw = spark.createDataFrame(
        [("L1", 43831.0, 20.0), ("IL_L2", 43832.0, 30.0)],
        "basin_code string, collection_date double, percent_macrophyte_cover double",
    )
    assert [tuple(r) for r in map_macrophyte_columns(raw).collect()] == [
        ("IL_L1", date(2020, 1, 1), 20.0),
        ("IL_L2", date(2020, 1, 2), 30.0),
    ]
