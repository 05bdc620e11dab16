import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakeassess.functions.dates import to_date_value, to_seconds_of_day
from lakeassess.functions.formulas import crossing_day, half_of_sites, hardness_equation
from lakeassess.functions.median import exact_median
from lakeassess.functions.missing import (
    divide,
    exceeds,
    if_else,
    matching_join,
    natural_log,
    numeric,
    round_even,
)
from lakeassess.sources.columns import clean_names

INF = float("inf")


def test_numbers_from_text(spark):
    texts = [" 1.5 ", "abc", "1d", "2e3", "0x1A", "-Inf", "NaN", "", None, "+.5", "-0xff", "0x10000000000000000000", "0x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(numeric(df, "t")).collect()] == [
        1.5, None, None, 2000.0, 26.0, -INF, None, None, None, 0.5, -255.0, 16.0**19, None,
    ]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "t double")
    assert [r[0] for r in df.select(numeric(df, "t")).collect()] == [None, 2.0]


def test_unknown_condition_gives_unknown(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (None,)], "q double")
    assert [r[0] for r in df.select(exceeds(F.col("q"))).collect()] == ["EXCEEDANCE", "NONE", None]
    assert [r[0] for r in df.select(if_else(F.col("q") > 1, F.lit(1), F.lit(0))).collect()] == [1, 0, None]


def test_division_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(divide(F.col("a"), F.col("b"))).collect()] == [INF, -INF, None, None, 1.5]


def test_log_of_zero_and_negative(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(natural_log(F.col("a"))).collect()] == [-INF, None, 0.0, None]


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (1.5,), (0.5,), (INF,), (None,)], "a double")
    assert [r[0] for r in df.select(round_even(F.col("a"))).collect()] == [2.0, 2.0, 0.0, INF, None]


def test_missing_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, "x"), ("a", "y")], "k string, w string")
    got = {(r.k, r.w) for r in matching_join(left, right, ["k"], "left").collect()}
    assert got == {(None, "x"), ("a", "y"), ("b", None)}
    assert [r.v for r in matching_join(left, right, ["k"], "left_anti").collect()] == [3]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hardness_equation(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-1.0,), (None,)], "h double")
    sloped = [r[0] for r in df.select(hardness_equation(-2.918, 1.128, 1.138672, 0.041838, F.col("h"))).collect()]
    log_h = math.log(100)
    assert sloped[0] == pytest.approx(math.exp(-2.918 + 1.128 * log_h) * (1.138672 - 0.041838 * log_h))
    assert sloped[1:] == [None, None, None]  # 0 * inf at zero hardness is missing
    constant = [r[0] for r in df.select(hardness_equation(3.688, 0.819, 0.316, 0.0, F.col("h"))).collect()]
    assert constant[0] == pytest.approx(math.exp(3.688 + 0.819 * log_h) * 0.316)
    assert constant[1:] == [0.0, None, None]


def test_half_of_sites(spark):
    df = spark.createDataFrame([(0, 4), (1, 4), (2, 4), (4, 4)], "n int, total int")
    assert [r[0] for r in df.select(half_of_sites(F.col("n"), F.col("total"))).collect()] == [0, 0, 1, 1]


def test_crossing_day(spark):
    df = spark.createDataFrame(
        [(0.0, 0.5, 10.0, 1.5), (0.0, 2.0, 10.0, 0.0), (7.0, 0.3, 7.0, 1.7), (0.0, 0.5, 10.0, INF)],
        "d0 double, q0 double, d double, q double",
    )
    got = [r[0] for r in df.select(crossing_day(F.col("d0"), F.col("q0"), F.col("d"), F.col("q"))).collect()]
    assert got == [5.0, 5.0, 7.0, None]


def test_dates(spark):
    df = spark.createDataFrame(
        [("43831", 43831.75, datetime(2020, 1, 1, 5, 6, 7)), ("2020-01-01", None, None), ("soon", None, None)],
        "t string, n double, ts timestamp",
    )
    day = date(2020, 1, 1)
    assert [r[0] for r in df.select(to_date_value(df, "t")).collect()] == [day, day, None]
    assert [r[0] for r in df.select(to_date_value(df, "n")).collect()] == [day, None, None]
    assert df.select(to_date_value(df, "ts")).first()[0] == day


def test_times(spark):
    df = spark.createDataFrame(
        [("0.5", 0.25, 100, datetime(2020, 1, 1, 1, 0, 5)), ("01:02:03", None, None, None), ("x", None, None, None)],
        "t string, n double, s int, ts timestamp",
    )
    assert [r[0] for r in df.select(to_seconds_of_day(df, "t")).collect()] == [43200, 3723, None]
    assert df.select(to_seconds_of_day(df, "n")).first()[0] == 21600
    assert df.select(to_seconds_of_day(df, "s")).first()[0] == 100
    assert df.select(to_seconds_of_day(df, "ts")).first()[0] == 3605


def test_clean_names_are_unique_and_keep_letters():
    assert clean_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert clean_names(["a_2", "a", "a", "", ""]) == ["a_2", "a", "a_3", "x", "x_2"]
    assert clean_names(["Température", "Größe m²"]) == ["temperature", "gro_e_m2"]


def test_time_of_almost_a_day_and_units(spark):
    df = spark.createDataFrame([(0.9999999, "0.5", 3600)], "part double, text string, whole int")
    row = df.select(
        to_seconds_of_day(df, "part"), to_seconds_of_day(df, "text"), to_seconds_of_day(df, "whole"),
        to_seconds_of_day(df, "text", "seconds"), to_seconds_of_day(df, "whole", "day"), to_seconds_of_day(df, "part", "seconds"),
    ).first()
    assert list(row) == [0, 43200, 3600, 0, 0, 0]
    with pytest.raises(ValueError, match="unit"):
        to_seconds_of_day(df, "part", "minutes")


def test_date_formats(spark):
    df = spark.createDataFrame([("06/12/2024",), ("2024-06-12",), ("45455",), ("12.06.2024",)], "d string")
    got = [r[0] for r in df.select(to_date_value(df, "d", ("MM/dd/yyyy", "dd.MM.yyyy"))).collect()]
    assert got == [date(2024, 6, 12)] * 4
    assert df.select(to_date_value(df, "d")).first()[0] is None


def test_clean_names():
    assert clean_names(["Result Value", "Result-Value", "% Cover", "StationCode", "2nd", "Site #"]) == [
        "result_value",
        "result_value_2",
        "percent_cover",
        "station_code",
        "x2nd",
        "site_number",
    ]


def test_median_matches_sorting(spark):
    import random
    import statistics

    source = random.Random(5)
    groups = {
        "many": [round(source.uniform(-50, 50), 1) for _ in range(301)],
        "even": [source.uniform(0, 1e6) for _ in range(40)],
        "close": [1.0, 1.0 + 1e-9, 1.0 + 2e-9, 1.0 + 3e-9],
        "one": [4.0],
        "ties": [2.0] * 9 + [8.0] * 10,
        None: [0.0, -1.0, 5.0],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_median(df, ["g"], "v", "m", {"n": F.count(F.lit(1))}).collect()}
    assert len(got) == 7
    for name, values in groups.items():
        assert got[name].m == pytest.approx(statistics.median(values), rel=1e-15)
    assert got["one"].n == 2 and got["none"].m is None and got["none"].n == 1
