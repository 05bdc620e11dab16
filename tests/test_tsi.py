from datetime import date

import pytest
from pyspark.sql import functions as F

from lakeassess.operators.tsi import (
    INDEX_POINTS,
    MACROPHYTE_POINTS,
    SOLIDS_POINTS,
    drop_work_columns,
    parameter_requirements,
    points_for,
    site_requirements,
    trophic_index,
    tsi_requirements,
    tsi_samples,
    tsi_use_support,
)

CHLOROPHYLL = "CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN"
SECCHI = "DEPTH, SECCHI DISK DEPTH"
TSS, VSS = "TOTAL SUSPENDED SOLIDS", "VOLATILE SUSPENDED SOLIDS"
DAY = date(2020, 6, 1)


@pytest.fixture()
def no_thermocline(spark):
    return spark.createDataFrame([], "mlid string, start_date date, thermocline_depth double")


@pytest.fixture()
def no_plants(spark):
    return spark.createDataFrame([], "AUID string, start_date date, coverage double")


def test_samples_of_the_index(prepared, no_plants, spark):
    thermoclines = spark.createDataFrame([("S1", DAY, 3.0)], "mlid string, start_date date, thermocline_depth double")
    rows = [
        {"analyte": "PHOSPHORUS", "sample_fraction": "Total", "sample_depth": 3.0, "result_value": 0.1},
        {"analyte": "PHOSPHORUS", "sample_fraction": "Dissolved", "result_value": 0.2},
        {"analyte": "PHOSPHORUS", "sample_fraction": "Total", "sample_depth": 4.0, "result_value": 0.3},
        {"analyte": CHLOROPHYLL, "sample_depth": 9.0, "result_value": 10.0},
        {"analyte": SECCHI, "sample_depth": None, "result_value": 39.3700787},
        {"analyte": SECCHI, "sample_depth": 0.5, "result_value": 39.3700787},
        {"analyte": SECCHI, "sample_depth": 0.5, "result_value": None},
        {"analyte": "IRON", "result_value": 1.0},
        {"analyte": TSS, "sample_depth": 1.0, "result_value": 10.0},
        {"analyte": VSS, "sample_depth": 1.0, "result_value": 4.0},
        {"analyte": TSS, "sample_depth": 2.0, "result_value": 10.0},
        {"analyte": CHLOROPHYLL, "sample_depth": 2.0, "result_value": 11.0},
        {"analyte": VSS, "sample_depth": 1.5, "result_value": 9.0},
        {"analyte": TSS, "sample_depth": 1.5, "result_value": 4.0},
    ]
    data = prepared([{**r, "start_date": DAY} for r in rows])
    out = tsi_samples(data, thermoclines, no_plants)
    got = {(r.analyte, r.sample_depth, r.result_value, r.TSS, r.VSS) for r in out.collect()}
    assert got == {
        ("PHOSPHORUS", 3.0, 0.1, None, None),
        (CHLOROPHYLL, 9.0, 10.0, None, None),
        (SECCHI, 0.5, 1.0, None, None),
        ("NVSS", 1.0, 6.0, 10.0, 4.0),
        (CHLOROPHYLL, 2.0, 11.0, None, None),
        ("NVSS", 1.5, 0.0, 4.0, 9.0),
    }
    assert out.count() == 6  # the two rows of a pair are one
    assert "row_id" not in out.columns and "qualifiers" not in out.columns


def _samples(spark, rows):
    """rows: lake, analyte, site, year, month."""
    return spark.createDataFrame(
        rows, "AUID string, analyte string, mlid string, collection_year int, collection_month int"
    )


def test_month_requirements(spark):
    def lake(name, months, sites=("A",)):
        return [(name, "NVSS", s, 2020, m) for m in months for s in sites]

    rows = [
        *lake("four", [4, 6, 7, 9]),
        *lake("three", [6, 7, 8]),
        *lake("one peak", [4, 5, 6, 9]),
        *lake("neither", [1, 2, 12]),
        *lake("half", [4, 5, 6, 7], ("A", "B")),
        *lake("winter", [11, 12, 1, 6, 7, 8, 9]),
        # Three sites in all; May to July are sampled at one of them only.
        *lake("few sites", [4], ("A", "B", "C")),
        *lake("few sites", [5, 6, 7], ("A",)),
    ]
    out = {r.AUID: r for r in site_requirements(_samples(spark, rows)).collect()}
    assert {k: r.min_site_reqs for k, r in out.items()} == {
        "four": "met",
        "three": "unmet; < 4 months available",
        "one peak": "unmet; < 2 months peak season",
        "neither": "unmet; < 4 months available; < 2 months peak season",
        "half": "met",
        "winter": "met",
        "few sites": "unmet; < 4 months available",
    }
    assert (out["few sites"].n_use_months, out["few sites"].n_collection_months) == (1, 4)
    assert (out["winter"].n_peak_season_months, out["winter"].n_collection_months) == (3, 7)


def test_missing_sites_and_lakes_count(spark):
    rows = [(None, "NVSS", None, 2020, m) for m in (4, 6, 7, 9)] + [(None, "NVSS", "A", 2020, m) for m in (4, 6, 7, 9)]
    out = site_requirements(_samples(spark, rows)).collect()
    assert [(r.AUID, r.n_use_months, r.min_site_reqs) for r in out] == [(None, 4, "met")]


def test_year_without_dates(spark):
    out = site_requirements(_samples(spark, [("L", "NVSS", "A", None, None)])).first()
    assert (out.n_collection_months, out.n_peak_season_months, out.n_use_months) == (1, 0, 7)
    assert out.min_site_reqs == "unmet; < 2 months peak season"


def test_work_columns_are_dropped(spark):
    df = spark.range(1).selectExpr("1 use_april", "1 use_peak_season", "1 use_n_months", "1 n_sites", "1 n_sites_may")
    assert drop_work_columns(df).columns == ["use_peak_season", "use_n_months"]


def test_parameter_requirements(spark):
    rows = [
        ("two", "PHOSPHORUS", 2020, "met"),
        ("two", "NVSS", 2020, "met"),
        ("two", SECCHI, 2020, "met"),
        ("one", "PHOSPHORUS", 2020, "met"),
        ("one", "NVSS", 2020, "unmet; < 4 months available"),
    ]
    sites = spark.createDataFrame(rows, "AUID string, analyte string, collection_year int, min_site_reqs string")
    got = {(r.AUID, r.analyte): r.use_param for r in parameter_requirements(sites).collect()}
    assert got == {
        ("two", "PHOSPHORUS"): "yes",
        ("two", "NVSS"): "yes",
        ("two", SECCHI): None,
        ("one", "PHOSPHORUS"): "no",
        ("one", "NVSS"): None,
    }


def test_requirements_keep_every_sample(prepared, no_thermocline, no_plants):
    rows = [
        {"analyte": CHLOROPHYLL, "start_date": date(2020, m, 1), "result_value": float(m), "AUID": lake}
        for m in range(1, 13)
        for lake in ("IL_A", None)
    ]
    out = tsi_requirements(prepared(rows), no_thermocline, no_plants)
    assert out.count() == 24 and out.where("min_site_reqs = 'met' and use_param = 'no'").count() == 24


@pytest.mark.parametrize(
    "table, values, expected",
    [
        (SOLIDS_POINTS, [11.9, 12, 14.9, 15, 19.9, 20, None], [0, 5, 5, 10, 10, 15, None]),
        (
            MACROPHYTE_POINTS,
            [0, 4.9, 5, 10, 15, 39.9, 40, 49.9, 50, 69.9, 70, None],
            [15, 15, 10, 5, 0, 0, 5, 5, 10, 10, 15, None],
        ),
        (INDEX_POINTS, [float("-inf"), 59.9, 60, 84.9, 85, 89.9, 90, None], [40, 40, 50, 50, 60, 60, 70, None]),
    ],
)
def test_point_tables(spark, table, values, expected):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(points_for(F.col("v"), table)).collect()] == expected


def test_trophic_index(spark):
    df = spark.createDataFrame(
        [(CHLOROPHYLL, 1.0), (SECCHI, 1.0), ("PHOSPHORUS", 0.001), ("NVSS", 1.0), (CHLOROPHYLL, 0.0), (SECCHI, 0.0)],
        "a string, m double",
    )
    got = [r[0] for r in df.select(trophic_index(F.col("a"), F.col("m"))).collect()]
    assert got == [30.6, 60.0, 4.15, None, float("-inf"), float("inf")]


REQUIRED = "AUID string, analyte string, collection_year int, result_value double, coverage double, min_site_reqs string"


def support(spark, rows):
    """rows: lake, analyte, value, coverage -> verdicts by lake."""
    data = [(lake, a, 2020, None if v is None else float(v), c, "met") for lake, a, v, c in rows]
    out = tsi_use_support(spark.createDataFrame(data, REQUIRED)).collect()
    return {(r.AUID, r.analyte): r for r in out}


def test_verdicts(spark):
    got = support(
        spark,
        [
            # All indicators good, plants in the best range.
            *[("good", a, v, 20.0) for a, v in ((CHLOROPHYLL, 1), (SECCHI, 2), ("PHOSPHORUS", 0.01), ("NVSS", 1))],
            # Turbid and overgrown.
            *[("bad", a, v, 90.0) for a, v in ((CHLOROPHYLL, 1000), (SECCHI, 0.1), ("PHOSPHORUS", 5), ("NVSS", 50))],
            # Neither plants nor solids known.
            ("unknown", CHLOROPHYLL, 1, None),
            # Three different answers.
            *[("mixed", a, v, 90.0) for a, v in ((CHLOROPHYLL, 1), (SECCHI, 0.1))],
        ],
    )
    assert {r.ALU_use for (lake, _), r in got.items() if lake == "good"} == {"FULLY SUPPORTING"}
    assert {r.ALU_use for (lake, _), r in got.items() if lake == "bad"} == {"NOT SUPPORTING"}
    unknown = got["unknown", CHLOROPHYLL]
    assert (unknown.chlorophyll_use, unknown.secchi_use, unknown.ALU_use) == ("NOT ASSESSED",) * 3
    mixed = got["mixed", CHLOROPHYLL]
    assert (mixed.secchi_use, mixed.chlorophyll_use, mixed.phosphorus_use) == (
        "NOT SUPPORTING", "FULLY SUPPORTING", "NOT ASSESSED",
    )
    assert mixed.ALU_use == "NEEDS REVIEW"


def test_points_are_shared_over_the_lake_year(spark):
    got = support(spark, [("L", CHLOROPHYLL, 1, None), ("L", "NVSS", 13, 45.0)])
    chlorophyll, solids = got["L", CHLOROPHYLL], got["L", "NVSS"]
    assert (chlorophyll.NVSS_points, chlorophyll.NVSS_usable) == (5, "yes")
    # Plant points belong to the analyte's own rows.
    assert (chlorophyll.macrophyte_points, chlorophyll.mac_usable) == (0, "no")
    assert (solids.macrophyte_points, solids.mac_usable) == (5, "yes")
    assert chlorophyll.chlorophyll_points == solids.chlorophyll_points == 45


def test_strict_median_and_mean(spark):
    got = support(
        spark,
        [
            ("L", CHLOROPHYLL, 1, 20.0), ("L", CHLOROPHYLL, 3, None),
            ("M", CHLOROPHYLL, 1, 20.0), ("M", CHLOROPHYLL, None, 40.0),
            ("Z", CHLOROPHYLL, 0, 20.0),
        ],
    )
    assert (got["L", CHLOROPHYLL].median_analyte, got["L", CHLOROPHYLL].mean_coverage) == (2.0, None)
    assert (got["M", CHLOROPHYLL].median_analyte, got["M", CHLOROPHYLL].mean_coverage) == (None, 30.0)
    # A median of zero scores; the two indicators without data agree with each other.
    assert (got["Z", CHLOROPHYLL].chlorophyll_points, got["Z", CHLOROPHYLL].ALU_use) == (40, "NOT ASSESSED")


def test_unmet_groups_are_left_out(spark):
    data = [("L", CHLOROPHYLL, 2020, 1.0, 20.0, "unmet; < 4 months available")]
    assert tsi_use_support(spark.createDataFrame(data, REQUIRED)).count() == 0
