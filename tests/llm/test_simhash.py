import random

import numpy as np
import pytest
import xxhash

from lakeassess.llm import simhash as S

from .conftest import long_text, words_of


def slow_simhash(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "a B c", "Äé Zz a a a a a a a", long_text(1), long_text(2, 500)])
def test_fingerprint_by_definition(text):
    assert S.simhash(text.encode()) == slow_simhash(text)


def all_groups(points, reach):
    groups = S.Groups(len(points))
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= reach)
        groups.join(np.full(len(near), i), near)
    return groups.lead


def clustered(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        point = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 1, 30])):
            out.add(point)
            for _ in range(r.randint(0, 3)):
                point ^= 1 << r.randrange(64)
    return np.array(sorted(out)[:n], np.uint64)


def test_tree_search_finds_every_link():
    points = clustered(3000, 1)
    assert (S.link(points, np.ones(len(points), bool), 4) == all_groups(points, 4)).all()


def test_routing_brings_every_close_pair_together_once():
    points = clustered(1500, 2)
    tree, leaves = S.upper_tree(points[::3], 5)
    at, leaf, home = S.route(tree, points, 4)
    assert np.bincount(at[home], minlength=len(points)).tolist() == [1] * len(points)
    lives = dict(zip(at[home].tolist(), leaf[home].tolist()))
    visits = set(zip(at.tolist(), leaf.tolist()))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist():
            if i < j:
                meetings = {(lives[i], "i")} if (j, lives[i]) in visits else set()
                meetings |= {(lives[j], "j")} if (i, lives[j]) in visits else set()
                assert len({leaf for leaf, _ in meetings}) == 1


@pytest.mark.parametrize("split", [False, True])
def test_links_of_a_table(spark, monkeypatch, split):
    if split:  # shards searched in parts and by several groups
        monkeypatch.setattr(S, "SHARD_POINTS", 40)
        monkeypatch.setattr(S, "GROUP_QUERIES", 60)
    points = clustered(700, 3)
    rows = [(int(p), i) for i, p in enumerate(points.view(np.int64))]
    links = S.near_links(spark.createDataFrame(rows, "fp bigint, id bigint").repartition(3))
    found = {r["v"]: r["m"] for r in S.components(links).collect()}
    assert [found.get(i, i) for i in range(len(points))] == all_groups(points, 4).tolist()


def test_long_chain_and_many_lists(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(100, 50), (100, 60), (60, 55), (50, 45)]
    found = {r["v"]: r["m"] for r in S.components(spark.createDataFrame(pairs, "v bigint, m bigint")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and found[100] == found[50] == 45 and found[60] == found[55] == 45


def test_documents(documents):
    text = long_text(4, 200)
    near = text.replace(text.split()[100], "changed")
    docs = documents([(7, text), (3, near), (3, near), (9, None), (8, " "), (None, text), (20, long_text(5)), (None, long_text(6))])
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == 8
    distance = (S.simhash(text.encode()) ^ S.simhash(near.encode())).bit_count()
    got = {(r["doc_id"] or -1, r["component_id"]) for r in rows}
    first = 3 if distance <= 4 else 7
    assert (8, 8) in got and (9, 8) in got and (3, 3) in got and (7, first) in got and (-1, first) in got and (-1, None) in got


def test_one_of_each_group(documents):
    text = long_text(4, 200)
    docs = documents([(7, text), (3, text), (3, text), (9, None), (None, text), (20, long_text(5))])
    left = sorted((r["doc_id"] or -1) for r in S.one_of_each_group(docs).collect())
    assert left == [-1, 3, 9, 20]


def test_empty_table(documents):
    assert S.near_duplicates(documents({})).collect() == []
