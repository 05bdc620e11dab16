import random
import statistics

import pytest
from pyspark.sql import functions as F

from lakeassess.functions.median import exact_median


def test_a_million_distinct_values_of_one_bucket(spark):
    steps = spark.range(1_000_001).select(F.lit("a").alias("k"), (F.lit(1000.0) + F.col("id") * F.lit(2.0**-40)).alias("v"))
    row = exact_median(steps, ["k"], "v", "m", {"n": F.count("v")}, ranked=1000).collect()
    assert [(r["k"], r["m"], r["n"]) for r in row] == [("a", 1000.0 + 500_000 * 2.0**-40, 1_000_001)]


@pytest.mark.parametrize("ranked", [2, 3, 1000])
def test_narrowed_ranges_give_the_same_median(spark, ranked):
    r = random.Random(ranked)
    rows = []
    for key in ("a", "b", None):
        for scale in (1e-9, 1.0):
            rows += [(key, 50 + scale * r.choice([r.random(), r.randint(0, 3)])) for _ in range(r.randint(20, 41))]
    # Tiny values of both signs share one bucket; equal ones count each; the rest is missing.
    rows += [("tiny", s * 10.0**-k) for k in range(8, 40) for s in (1, -1)] + [("tiny", 0.0)] * 5
    rows += [("same", 7.5)] * 9 + [("none", None)] * 3 + [("two", 1.0), ("two", 1.0 + 2.0**-52), ("two", None)]
    got = exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m", {"n": F.count(F.lit(1))}, ranked)
    wanted = {}
    for key in {k for k, _ in rows}:
        known = [v for k, v in rows if k == key and v is not None]
        wanted[key] = (statistics.median(known) if known else None, sum(k == key for k, _ in rows))
    assert {r["k"]: (r["m"], r["n"]) for r in got.collect()} == wanted
