import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import column
from lakeassess.operators.ammonia import ammonia_chronic_events, ammonia_chronic_standards
from lakeassess.operators.chronic import chronic_events, depth_class, undersampled_series, with_chronic_standards
from lakeassess.operators.thermocline import thermocline

START = date(2020, 5, 1)
TEMPERATURE = "TEMPERATURE, WATER"
STANDARDS = (
    "Analyte string, sample_fraction string, acute_standard double, acute_units string, "
    "chronic_standard double, chronic_units string"
)


@pytest.fixture()
def standards(spark):
    return spark.createDataFrame(
        [
            ("IRON", None, 1.0, "mg/L", 1.0, "mg/L"),
            ("COPPER", "Dissolved", None, "mg/L", 20.0, "mg/L"),
            ("CHLORIDE", "Tot", 500.0, "mg/L", 250.0, "mg/L"),
            ("BORON", "Diss|Total", 1.0, "mg/L", 2.0, "mg/L"),
        ],
        STANDARDS,
    )


@pytest.fixture()
def no_thermocline(spark):
    return spark.createDataFrame([], "mlid string, start_date date, thermocline_depth double")


def reading(depth, degrees, day=1, time=0, site="S1"):
    return {
        "analyte": TEMPERATURE,
        "sample_depth": depth,
        "result_value": degrees,
        "start_date": None if day is None else date(2020, 6, day),
        "start_time": time,
        "mlid": site,
    }


@pytest.mark.parametrize(
    "profile, expected",
    [
        ([(1.0, 20.0), (2.0, 19.8), (3.0, 18.0), (4.0, 10.0)], 3.0),
        ([(1.0, 20.0), (2.0, 19.5)], None),  # 0.5 per unit is not steep
        ([(1.0, 20.0), (2.0, 20.6)], 2.0),  # warming counts too
        ([(3.0, 10.0), (1.0, 20.0), (2.0, 20.1)], 3.0),  # input order does not matter
        ([(1.0, 20.0), (None, 5.0)], None),
        ([(1.0, 20.0), (2.0, None), (3.0, 10.0)], None),
    ],
)
def test_thermocline(prepared, profile, expected):
    out = thermocline(prepared([reading(*r) for r in profile])).collect()
    assert [r.thermocline_depth for r in out] == ([] if expected is None else [expected])


def test_thermocline_repeats(prepared):
    # Same depth at two times with different temperatures is infinitely steep.
    out = thermocline(prepared([reading(2.0, 20.0, time=1), reading(2.0, 19.9, time=2)]))
    assert [r.thermocline_depth for r in out.collect()] == [2.0]
    # Same depth and time: the first in input order counts.
    rows = [reading(1.0, 20.0), reading(1.0, 10.0), reading(2.0, 20.1)]
    assert thermocline(prepared(rows).repartition(3)).count() == 0


def test_thermocline_needs_site_and_day(prepared):
    rows = [reading(d, t, site=None) for d, t in ((1.0, 20.0), (2.0, 10.0))]
    rows += [reading(d, t, day=None) for d, t in ((1.0, 20.0), (2.0, 10.0))]
    rows += [reading(1.0, 20.0, site="S8"), reading(2.0, 10.0, site="S9")]
    assert thermocline(prepared(rows)).count() == 0


def test_depth_classes(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (2.5,), (None,)], "d double")
    coverage = [r[0] for r in df.select(depth_class(F.col("d"), include_limit=True)).collect()]
    series = [r[0] for r in df.select(depth_class(F.bround("d"), include_limit=False)).collect()]
    assert coverage == ["Shallow", "Shallow", "Deep", None]
    assert series == ["Deep", "Deep", "Deep", None]


def test_chronic_standard_match(prepared, standards):
    rows = [
        {"analyte": "IRON", "sample_fraction": "Total", "result_value": 2.0},
        {"analyte": "IRON", "sample_fraction": None, "result_value": 2.0},
        {"analyte": "COPPER", "sample_fraction": "Total", "result_value": 2.0},
        {"analyte": "COPPER", "sample_fraction": None, "result_value": 2.0},
        {"analyte": "COPPER", "sample_fraction": "Dissolved", "result_value": 2.0, "hardness": 100.0},
        {"analyte": "ZINC", "sample_fraction": "Dissolved", "result_value": 2.0, "hardness": 100.0},
        {"analyte": "ZINC", "sample_fraction": "Dissolved", "result_value": 2.0},
        {"analyte": "CHLORIDE", "sample_fraction": "Total", "result_value": 2.0},
        {"analyte": "BORON", "sample_fraction": "Dissolved", "result_value": 2.0},
        {"analyte": "BORON", "sample_fraction": "Other", "result_value": 2.0},
        {"analyte": "OTHER", "sample_fraction": "Total", "result_value": 2.0},
    ]
    out = with_chronic_standards(prepared(rows), standards)
    got = {r.row_id: (r.fraction_match, r.chronic_standard) for r in out.collect()}
    zinc = math.exp(-0.4456 + 0.8473 * math.log(100)) * 0.986
    assert got == {
        0: ("NO", 1.0),
        1: (None, 1.0),
        3: (None, 20.0),
        4: ("YES", 20.0),  # the table wins over hardness
        5: ("NO", pytest.approx(zinc)),
        7: ("YES", 250.0),  # part of the fraction name is enough
        8: ("YES", 2.0),  # a regular expression
    }


def iron(quotients, days=None, **extra):
    days = days or range(0, 10 * len(quotients), 10)
    return [
        {"analyte": "IRON", "sample_fraction": "Total", "result_value": q, "start_date": START + timedelta(days=d), **extra}
        for q, d in zip(quotients, days)
    ]


def events(prepared, standards, thermoclines, rows):
    return chronic_events(prepared(rows).repartition(3), standards, thermoclines)


def test_single_reading_event(prepared, standards, no_thermocline):
    out = events(prepared, standards, no_thermocline, iron([0.5, 1.5, 0.5]))
    first = (START - date(1970, 1, 1)).days
    assert column(out, "chronic_start_date") == [None, first + 5.0, None]
    assert column(out, "chronic_end_date") == [None, None, first + 15.0]
    assert column(out, "chronic_event_duration") == [None, 10.0, None]
    assert column(out, "standard_violation") == ["NONE", "EXCEEDANCE", "NONE"]
    assert column(out, "thermocline_depth") == [None, None, None]


def test_run_of_readings_is_unknown(prepared, standards, no_thermocline):
    out = events(prepared, standards, no_thermocline, iron([0.5, 1.5, 1.5, 0.5]))
    assert column(out, "standard_violation") == ["NONE", None, None, "NONE"]


def test_short_event(prepared, standards, no_thermocline):
    out = events(prepared, standards, no_thermocline, iron([0.5, 1.5, 0.5], [0, 1, 2]))
    assert column(out, "chronic_event_duration")[1] == 1.0
    assert column(out, "standard_violation") == ["NONE", "NONE", "NONE"]


@pytest.mark.parametrize("last, verdict", [(3, None), (4, "EXCEEDANCE")])
def test_whole_series_above(prepared, standards, no_thermocline, last, verdict):
    out = events(prepared, standards, no_thermocline, iron([1.5, 1.5, 1.5], [0, 1, last]))
    assert column(out, "standard_violation") == [verdict] * 3


def test_whole_series_needs_every_result_and_date(prepared, standards, no_thermocline):
    gap = events(prepared, standards, no_thermocline, iron([1.5, None, 1.5]))
    assert column(gap, "standard_violation") == [None, None, None]
    rows = iron([1.5, 1.5, 1.5, 1.5])
    rows[3]["start_date"] = None
    assert column(events(prepared, standards, no_thermocline, rows), "standard_violation") == [None] * 4


def test_quotient_of_one_is_no_crossing(prepared, standards, no_thermocline):
    out = events(prepared, standards, no_thermocline, iron([1.0, 1.5, 0.5]))
    assert column(out, "chronic_start_date") == [None, None, None]
    assert column(out, "standard_violation") == ["NONE", None, "NONE"]


def test_same_day_readings_keep_input_order(prepared, standards, no_thermocline):
    out = events(prepared, standards, no_thermocline, iron([0.5, 1.5, 0.5, 0.5], [0, 10, 10, 20]))
    first = (START - date(1970, 1, 1)).days
    assert column(out, "chronic_start_date") == [None, first + 5.0, None, None]
    assert column(out, "chronic_event_duration") == [None, 5.0, None, None]


def test_undersampled_series_are_dropped(prepared, standards, no_thermocline):
    rows = iron([0.5, 0.5]) + iron([0.5, 0.6, 0.7], mlid="S2") + iron([0.5, 0.5, 0.5], [0, 0, 1], mlid="S3")
    out = events(prepared, standards, no_thermocline, rows)
    assert set(column(out, "mlid")) == {"S2"}
    sparse = undersampled_series(prepared(rows), ["mlid", "analyte", "sample_fraction"])
    assert {(r.mlid, r.times_sampled) for r in sparse.collect()} == {("S1", 2), ("S3", 2)}


def test_chronic_depth_and_unit_filters(prepared, standards, spark):
    thermoclines = spark.createDataFrame([("S1", START, 1.0)], "mlid string, start_date date, thermocline_depth double")
    rows = iron([0.5, 0.5, 0.5, 0.5])
    rows[1].update(start_date=START, sample_depth=0.5)
    rows[2]["result_unit"] = "ug/kg dry"
    out = events(prepared, standards, thermoclines, rows)
    assert column(out, "row_id") == [1, 3]  # at the thermocline is below; no thermocline stays


def ammonia_visit(day, ammonia, ph=7.0, degrees=10.0, depth=1.0, **extra):
    shared = {"start_date": day, "sample_depth": depth, "sample_fraction": "Total", **extra}
    return [
        {"analyte": "AMMONIA-NITROGEN", "result_value": ammonia, **shared},
        {"analyte": "PH", "result_value": ph, **shared},
        {"analyte": TEMPERATURE, "result_value": degrees, **shared},
    ]


def deep_thermoclines(spark, days, sites=("S1",), depth=5.0):
    rows = [(s, d, depth) for s in sites for d in days]
    return spark.createDataFrame(rows, "mlid string, start_date date, thermocline_depth double")


@pytest.mark.parametrize(
    "month, degrees, multiplier",
    [
        (3, 14.51, 2.85),
        (10, 14.52, 1.45 * 10 ** (0.028 * (25 - 14.52))),
        (2, 7.0, 1.45 * 10**0.504),
        (11, 7.1, 1.45 * 10 ** (0.028 * (25 - 7.1))),
    ],
)
def test_ammonia_stages(prepared, spark, month, degrees, multiplier):
    days = [date(2020, month, d) for d in (1, 2, 3)]
    rows = [r for d in days for r in ammonia_visit(d, 1.0, 7.5, degrees)]
    out = ammonia_chronic_standards(prepared(rows), deep_thermoclines(spark, days)).collect()
    curve = 0.0577 / (1 + 10 ** (7.688 - 7.5)) + 2.487 / (1 + 10 ** (7.5 - 7.688))
    assert len(out) == 3
    for row in out:
        assert row.standard == pytest.approx(curve * multiplier)
        assert row.standard_subchronic == pytest.approx(2.5 * curve * multiplier)
        assert row.early_life_present == ("Present" if 3 <= month <= 10 else "Absent")


def test_ammonia_filters(prepared, spark):
    days = [date(2020, 6, d) for d in (1, 2, 3)]
    rows = [r for d in days for r in ammonia_visit(d, 1.0)]
    rows += [r for d in days for r in ammonia_visit(d, 1.0, mlid="S2")]  # no thermocline
    rows += [r for d in days for r in ammonia_visit(d, 1.0, depth=5.0, mlid="S3")]  # at it
    rows += [r for d in days for r in ammonia_visit(d, 1.0, mlid="S4")]
    rows += ammonia_visit(days[0], 1.0, mlid="S4", sample_fraction="Dissolved")[:1]  # one sparse fraction
    rows += [r for d in days for r in ammonia_visit(d, 1.0, ph=None, mlid="S5")]
    out = ammonia_chronic_standards(prepared(rows), deep_thermoclines(spark, days, ("S1", "S3", "S4", "S5")))
    assert column(out, "mlid") == ["S1"] * 3


def test_ammonia_events_and_flags(prepared, spark):
    days = [START + timedelta(days=d) for d in (0, 40, 80, 120)]
    levels = {"S1": [99.0, 0.1, 99.0, 0.1], "S2": [0.1, 0.1, 0.1, 99.0], "S3": [99.0] * 4}
    rows = [
        r for site, values in levels.items() for day, v in zip(days, values) for r in ammonia_visit(day, v, mlid=site)
    ]
    out = ammonia_chronic_events(prepared(rows).repartition(3), deep_thermoclines(spark, days, tuple(levels)))
    got = {
        site: [
            (r.standard_violation, r.standard_violation_subchronic, r.first_exceedance, r.last_exceedance)
            for r in out.where(F.col("mlid") == site).orderBy("start_date").collect()
        ]
        for site in levels
    }
    yes, no = "EXCEEDANCE", "NONE"
    assert got["S1"] == [
        (None, None, "No prior data", None), (no, no, None, None), (yes, yes, None, None), (no, no, None, None),
    ]
    assert got["S2"][3] == (None, None, None, "No following data")
    assert got["S3"] == [
        (yes, yes, "No prior data", None), (yes, yes, None, None), (yes, yes, None, None),
        (yes, yes, None, "No following data"),
    ]
