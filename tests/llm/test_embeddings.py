"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeassess.llm import embeddings as E

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, least=0.95):
    """Rows (vec_id, n_links, component_id) sorted, by all pairs."""
    vectors = []
    for _, v in rows:
        good = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x = np.array(v, np.float32).astype(float) if good else None
        vectors.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if good else None)
    n = len(rows)
    close = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            close[i, j] = i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= least
    lead = list(range(n))
    for _ in range(n):
        new = [min([lead[i], *(lead[j] for j in np.flatnonzero(close[i]))]) for i in range(n)]
        if new == lead:
            break
        lead = new
    ids = [min((rows[j][0] for j in range(n) if lead[j] == lead[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return sorted(((rows[i][0], int(close[i].sum()), ids[i]) for i in range(n)), key=str)


def found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def made(seed, groups, singles, size=24):
    r = np.random.default_rng(seed)
    out = [r.normal(size=size) for _ in range(singles)]
    for count in groups:
        centre = r.normal(size=size)
        out += [centre + r.normal(size=size) * 0.08 for _ in range(count)]
    out = [v.astype(np.float32).tolist() for v in out]
    return [(i, out[k]) for i, k in enumerate(r.permutation(len(out)))]


@pytest.mark.parametrize("part, questions", [(8192, 16_384), (60, 50)])
def test_against_all_pairs(spark, monkeypatch, part, questions):
    """Also with crowded shards, built and asked in parts."""
    monkeypatch.setattr(E, "CENTRE_VECTORS", 100)
    monkeypatch.setattr(E, "PART_VECTORS", part)
    monkeypatch.setattr(E, "TASK_QUESTIONS", questions)
    rows = made(1, [2, 3, 5, 30, 90], 200)
    assert found(E.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_vectors_copies_and_extra_columns(spark, tmp_path):
    rows = made(2, [4], 5) + [
        (100, None), (101, []), (102, [0.0] * 24), (103, [float("nan")] * 24), (104, [1.0] * 23 + [None]), (105, [float("inf")] * 24),
        (106, [1e30] * 24), (107, [2e30] * 24), (108, [1e-30] * 24), (109, [1.0] * 23), (110, [1.0] * 23 + [-1.0]), (None, [1.0] * 24),
        (111, [-0.0] + [3.0] * 23), (112, [0.0] + [3.0] * 23), (113, [0.0] + [3.0] * 23), (113, [5.0] + [0.0] * 23), (None, [0.0] * 23 + [5.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("x")).withColumn("rid", F.lit(1)).withColumn("links", F.lit(2))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    result = E.op13_embeddings(spark, str(tmp_path))
    assert found(result) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in result.collect())


def test_empty_table(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_audit_widens_the_beam(spark, monkeypatch):
    seen = []
    plain = E.found_links
    monkeypatch.setattr(E, "found_links", lambda v, s, least, beam: seen.append(beam) or plain(v, s, least, beam))
    monkeypatch.setattr(E, "audit", lambda *a: (0, 1))
    E.near_vectors(spark.createDataFrame(made(3, [3], 10), SCHEMA), beam=300)
    assert seen == [300, 600, 1200]


def test_prune_keeps_the_nearest_and_drops_what_it_hides():
    x = E.unit(np.array([[1.0, 0, 0], [1, 0.1, 0], [1, 0.12, 0], [1, 0, 0.5], [-1, 0, 0]]))
    kept = E.prune(x, np.array([0]), np.array([[1, 2, 3, 4, 0, 1]]))[0]
    assert kept[kept >= 0].tolist() == [1, 3, 4]


def test_every_point_is_reached():
    x = E.unit(np.random.default_rng(5).normal(size=(400, 16)))
    lists = E.build(x)
    seen = np.zeros(len(x), bool)
    E._reached(lists, seen, E.medoids(x.astype(np.float32)))
    assert seen.all()
