"""Segmented group work must equal plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from lakeassess.functions.groups import (
    GroupSpec,
    HotSites,
    Total,
    day_position,
    depth_position,
    find_hot_sites,
    group_window,
)


def _rows(seed, n=240):
    source = random.Random(seed)
    rows = []
    for i in range(n):
        site = source.choice(["hot", "hot", "hot", "A", "B", None])
        day = source.choice([None, 1, 1, 2, 3, 5, 8])
        rows.append(
            (
                i * 7,
                site,
                None if day is None else f"2020-01-0{day}",
                source.choice([None, 0.5, 1.0, 2.5]),
                source.choice([None, None, None, source.uniform(0, 2)]),
            )
        )
    source.shuffle(rows)
    return rows


SCHEMA = "row_id bigint, mlid string, day string, sample_depth double, x double"


def _spec(order, position):
    return GroupSpec(
        keys=["mlid", "part"],
        order=order,
        position=position,
        previous=("x", "row_id"),
        following=("x", "row_id"),
        fill=("x",),
        totals={
            "n_known": Total(F.count("x"), F.sum),
            "largest": Total(F.max("x"), F.max),
            "all_known": Total(F.every(F.col("x").isNotNull()), F.every),
        },
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("kind", ["row", "day", "depth"])
def test_segments_equal_plain_windows(spark, small_limit, seed, kind):
    df = (
        spark.createDataFrame(_rows(seed), SCHEMA)
        .withColumn("start_date", F.to_date("day"))
        .withColumn("part", F.col("row_id") % 2)
    )
    spec = {
        "row": lambda: _spec(["row_id"], None),
        "day": lambda: _spec(["start_date", "row_id"], day_position()),
        "depth": lambda: _spec(["sample_depth", "row_id"], depth_position()),
    }[kind]()
    hot = find_hot_sites(df)
    assert "hot" in hot.sites
    plain = group_window(df, spec, HotSites(10**9))
    cut = group_window(df, spec, hot)
    assert plain.columns == cut.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_fill_down_then_up(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", 5.0), (3, "a", None), (4, "a", 7.0), (5, "a", None), (6, "b", None)],
        "row_id bigint, mlid string, x double",
    ).repartition(3)
    spec = GroupSpec(keys=["mlid"], order=["row_id"], fill=("x",))
    out = group_window(df, spec, HotSites(10**9)).orderBy("row_id")
    assert [r.x for r in out.collect()] == [5.0, 5.0, 5.0, 7.0, 7.0, None]


def test_hot_group_is_spread(spark, small_limit):
    """Rows of one huge site get many segments of about the limit."""
    from lakeassess.functions.groups import SEGMENT, _cut_hot_groups

    df = spark.range(300).select(F.col("id").alias("row_id"), F.lit("hot").alias("mlid"), F.lit(1.0).alias("x"))
    spec = GroupSpec(keys=["mlid"], order=["row_id"], fill=("x",))
    sizes = [r["count"] for r in _cut_hot_groups(df, spec, find_hot_sites(df)).groupBy(SEGMENT).count().collect()]
    assert len(sizes) >= 90 and max(sizes) <= 6


def test_no_hot_sites_means_one_exchange(spark):
    site = F.concat(F.lit("S"), F.col("id") % 5)
    df = spark.range(100).select(F.col("id").alias("row_id"), site.alias("mlid"), F.lit(1.0).alias("x"))
    spec = GroupSpec(keys=["mlid"], order=["row_id"], fill=("x",), totals={"n": Total(F.count("x"), F.sum)})
    plan = group_window(df, spec, find_hot_sites(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_split_survives_an_earlier_join_on_the_keys(spark, small_limit, threshold):
    """The exchange has the segment in it, though the join has the group's keys."""
    from lakeassess.functions.missing import matching_join

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.range(300).select(F.col("id").alias("row_id"), F.lit("hot").alias("mlid"), F.lit(1.0).alias("x"))
        other = spark.createDataFrame([("hot", 2)], "mlid string, y int")
        spec = GroupSpec(keys=["mlid"], order=["row_id"], fill=("x",))
        out = group_window(matching_join(df, other, ["mlid"], "left"), spec, find_hot_sites(df))
        exchanges = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert any("mlid" in x and "__segment" in x and "REPARTITION" in x for x in exchanges)
        assert out.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["chronic_events", "tsi_nvss", "ammonia_chronic_standard"])
def test_a_hot_site_costs_no_further_scan(spark, small_limit, name):
    from checks.registry import QUERIES

    hot = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("lakeassess.hotGroupRows", "1000000")
    plain = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert hot.count("lineitem.parquet") <= plain.count("lineitem.parquet") + 1
