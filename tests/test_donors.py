"""Filled values against a walk over the rows, with arrays cut into blocks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from lakeassess.functions.donors import fill_all_from_donors, fill_from_donors


def walked(rows):
    """Last known value before a row, else the first after it, by group."""
    out, groups = {}, {}
    for row_id, site, day, value in sorted(rows):
        groups.setdefault((site, day), []).append((row_id, value))
    for own in groups.values():
        first, last = next((v for _, v in own if v is not None), None), None
        for row_id, value in own:
            last = value if value is not None else last
            out[row_id] = first if last is None else last
    return out


@pytest.mark.parametrize("bits", [0, 2, 14])
def test_against_a_walk(spark, bits):
    r = random.Random(bits)
    ids = r.sample(range(10**9), 1500)
    rows = [(i, r.choice(["A", "A", "A", "B", None]), r.choice([1, None]), f"v{i}" if r.random() < 0.2 else None) for i in ids]
    rows += [(10**9 + i, "C", 2, None) for i in range(5)] + [(2 * 10**9 + i, "D", 2, "x" if i == 4 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "row_id bigint, site string, day int, value string").repartition(5)
    found = fill_from_donors(df, ["site", "day"], F.col("value"), "filled", bits)
    assert {r["row_id"]: r["filled"] for r in found.collect()} == walked(rows)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_nobody_knows(spark):
    df = spark.createDataFrame([(1, "A", None)], "row_id bigint, site string, value double")
    assert fill_from_donors(df, ["site"], F.col("value"), "filled").collect()[0]["filled"] is None
    assert fill_from_donors(df.limit(0), ["site"], F.col("value"), "filled").collect() == []


@pytest.mark.parametrize("bits", [0, 3, 14])
def test_several_values_and_marks_from_one_record(spark, bits):
    r = random.Random(100 + bits)
    kinds = r.choices(["a", "b", "c"], [1, 4, 5], k=1200)
    rows = [(i, r.choice(["A", "A", "B", "C", None]), r.randrange(3), k, r.random() < 0.9) for i, k in zip(r.sample(range(10**9), 1200), kinds)]
    df = spark.createDataFrame(rows, "row_id bigint, site string, day int, kind string, given boolean").repartition(4)
    known = {k: F.when((F.col("kind") == k) & F.col("given"), F.concat(F.col("kind"), F.col("row_id"))) for k in "ab"}
    marks = {"has_a": F.col("kind") == "a"}
    donating = F.col("kind").isin("a", "b")
    found = {x["row_id"]: x for x in fill_all_from_donors(df, ["site", "day"], known, marks, donating, bits).collect()}
    assert len(found) == len(rows)
    for k in "ab":
        own = walked([(i, s, d, f"{k}{i}" if kind == k and given else None) for i, s, d, kind, given in rows])
        assert {i: x[k] for i, x in found.items()} == own
    groups = {}
    for i, s, d, kind, _ in rows:
        groups.setdefault((s, d), set()).add(kind)
    for i, s, d, *_ in rows:
        donors = groups[s, d] & {"a", "b"}
        assert found[i]["has_a"] == ("a" in donors if donors else None)
