"""SimHash near-duplicates, linked exactly through vantage-point trees.

Distinct fingerprints are dealt to shards, the leaves of a vantage-point tree: a
node holds a fingerprint and a radius, and sends what lies within the radius to
one side, the rest to the other. A fingerprint also visits those shards that a
ball of ``max_distance`` around it may reach by the triangle inequality. To meet
every pair once, one lying outside a node's radius visits the inside, not the
other way round. In its shard each task builds a smaller tree over the
fingerprints at home there and searches it for all that live there or visit.

The upper tree is fitted to a bounded sample; which pairs are found does not
depend on it. A shard gives back one link per fingerprint to the smallest
document its group has there, a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored
from .words import blocks

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4

SAMPLE = 8192  # fingerprints the upper tree is fitted to
SHARD_POINTS = 262_144
LEAST_DEPTH = 5
GROUP_QUERIES = 1 << 18
LEAF = 128
CANDIDATES = 24
#: Ids given to groups of documents without an id.
NAMELESS = 1 << 62


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words, or of the whole text if it has fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")


def majority(values: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 for none."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(values), 65536):
        part = values[k : k + 65536].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0])


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint: the bits set in over half the shingles' hashes."""
    return majority(shingle_hashes(text, shingle, seed))


def add_simhash(df: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the signed fingerprint of every text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for _, _, data, offsets in blocks(batch.column("text")):
                raw, bounds = data.tobytes(), offsets.tolist()
                prints += [simhash(raw[a:b], shingle) for a, b in zip(bounds, bounds[1:])]
            fp = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


@dataclass
class Node:
    """Inner node (vantage point, radius, children), or a leaf with a number."""

    vantage: np.uint64 | None = None
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1


def _choose(points: np.ndarray, random: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point of the widest spread of distances, its median, and all distances."""
    best = None
    for at in random.choice(len(points), min(CANDIDATES, len(points)), replace=False):
        away = distance(points, points[at])
        if best is None or away.var() > best[2].var():
            best = (points[at], 0, away)
    vantage, _, away = best
    radius = int(np.median(away))
    if radius == away.max():
        radius -= 1
    return (vantage, radius, away) if (away <= radius).any() and radius >= 0 else None


def upper_tree(sample: np.ndarray, depth: int) -> tuple[Node, int]:
    """Tree over a sample, and its number of leaves."""
    random, leaves = np.random.default_rng(SEED), 0

    def build(points: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        chosen = _choose(points, random) if depth and len(points) > 1 else None
        if chosen is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        vantage, radius, away = chosen
        inside, outside = build(points[away <= radius], depth - 1), build(points[away > radius], depth - 1)
        return Node(vantage, radius, inside, outside)

    root = build(sample, depth)
    return root, leaves


def route(tree: Node, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point index, leaf, at home) for every leaf a point lives in or visits."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def go(node: Node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node.vantage is None:
            out.append((at, node.leaf, home))
            return
        away = distance(points[at], node.vantage)
        within = away <= node.radius
        inside = np.where(home, within | (away - reach <= node.radius), away - reach <= node.radius)
        outside = np.where(home, ~within, away + reach > node.radius)
        go(node.inside, at[inside], (home & within)[inside])
        go(node.outside, at[outside], (home & ~within)[outside])

    go(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return (
        np.concatenate([a for a, _, _ in out]),
        np.concatenate([np.full(len(a), leaf) for a, leaf, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


class Groups:
    """Disjoint sets over 0..n-1, each led by its smallest member."""

    def __init__(self, n: int):
        self.lead = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.lead[a], self.lead[b]
        apart = a != b
        if not apart.any():
            return
        pairs = np.unique(np.stack([np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])]), axis=1)
        lead = self.lead
        for high, low in pairs.T.tolist():
            while lead[high] != high:
                high = lead[high]
            while lead[low] != low:
                low = lead[low]
            if high != low:
                lead[max(high, low)] = min(high, low)
        while True:
            further = lead[lead]
            if (further == lead).all():
                break
            lead[:] = further


def link(points: np.ndarray, at_home: np.ndarray, reach: int) -> np.ndarray:
    """Leader of each fingerprint's group, links being pairs at most ``reach`` apart
    of which at least one is at home."""
    groups = Groups(len(points))
    close_pairs(points, np.flatnonzero(at_home), reach, groups.join)
    return groups.lead


def close_pairs(points: np.ndarray, home: np.ndarray, reach: int, found) -> None:
    """Call ``found`` with pairs of positions at most ``reach`` apart, the second at home."""
    random = np.random.default_rng(SEED)

    def search(members: np.ndarray, asking: np.ndarray) -> None:
        if not len(members) or not len(asking):
            return
        chosen = _choose(points[members], random) if len(members) > LEAF else None
        if chosen is None:
            step = max(1, (1 << 22) // len(members))
            for k in range(0, len(asking), step):
                some = asking[k : k + step]
                near = np.bitwise_count(points[some][:, None] ^ points[members][None, :]) <= reach
                q, p = np.nonzero(near)
                found(some[q], members[p])
            return
        vantage, radius, away = chosen
        far = distance(points[asking], vantage)
        search(members[away <= radius], asking[far - reach <= radius])
        search(members[away > radius], asking[far + reach > radius])

    search(home, np.arange(len(points)))


LINKS_SCHEMA = "v bigint, m bigint"


def near_links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (v, m), m < v, that connect all fingerprints at most ``max_distance`` apart.

    ``prints`` has distinct ``fp`` and an ``id`` for each; it is read three times.
    """
    total = prints.count()
    sample = prints.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    points = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    depth = max(LEAST_DEPTH, int(np.ceil(np.log2(max(total, 1) / SHARD_POINTS))))
    tree, leaves = upper_tree(points, depth)
    # Shards with many visitors are searched in several groups, and crowded ones
    # in parts; estimated from the sample, which only sets the size of tasks.
    scale = total / max(1, len(points))
    _, leaf, home = route(tree, points, max_distance)
    own = np.bincount(leaf[home], minlength=leaves) * scale
    all_ = np.bincount(leaf, minlength=leaves) * scale
    parts = np.maximum(1, np.ceil(own / SHARD_POINTS)).astype(np.int64)
    asks = np.maximum(1, np.ceil(all_ / GROUP_QUERIES)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts * asks)])
    groups = int(first[-1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            ids = batch.column("id").to_numpy()
            at, leaf, home = route(tree, fp, max_distance)
            # The part a fingerprint is searched in, and the group it asks with.
            part, ask = fp[at] % parts[leaf].astype(np.uint64), (fp[at] >> np.uint64(20)) % asks[leaf].astype(np.uint64)
            # As a member it joins every group of its part; as a question one group of every part.
            for k in range(int(asks.max())):
                some = home & (k < asks[leaf])
                place = first[leaf] + part.astype(np.int64) * asks[leaf] + k
                yield _rows(place[some], fp[at[some]], ids[at[some]], True)
            for k in range(int(parts.max())):
                some = k < parts[leaf]
                same = home & (part == k)  # there already as a member of the group it asks in
                place = first[leaf] + k * asks[leaf] + ask.astype(np.int64)
                some &= ~same
                yield _rows(place[some], fp[at[some]], ids[at[some]], False)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            places = batch.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if places[a] != place and held:
                        yield _links(held, max_distance)
                        held = []
                    place = places[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield _links(held, max_distance)

    return (
        prints.select("fp", "id")
        .mapInArrow(deal, "place int, fp bigint, id bigint, home boolean")
        .repartitionById(groups, F.col("place"))
        .sortWithinPartitions("place")
        .mapInArrow(search, LINKS_SCHEMA)
    )


def _rows(place: np.ndarray, fp: np.ndarray, ids: np.ndarray, home: bool) -> pa.RecordBatch:
    columns = [pa.array(place.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(ids), pa.array(np.full(len(fp), home))]
    return pa.RecordBatch.from_arrays(columns, ["place", "fp", "id", "home"])


def _links(held: list[pa.RecordBatch], reach: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")  # so that a group's leader has its smallest id
    ids = ids[order]
    points = table["fp"].to_numpy().view(np.uint64)[order]
    lead = link(points, table["home"].to_numpy()[order], reach)
    apart = np.flatnonzero(ids[lead] != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(ids[lead[apart]])], ["v", "m"])


def components(links: DataFrame) -> DataFrame:
    """(v, m): the smallest id reachable from every linked id but the smallest itself.

    First every id keeps its smallest neighbour, and its other links pass on to
    that neighbour, until each has one; ids fall with every step. What is left is
    a forest, whose paths are halved until they end at the root.
    """
    edges = stored(links.distinct(), "links")
    while True:
        lowest = edges.groupBy("v").agg(F.min("m").alias("low"))
        passed = (
            edges.join(lowest, "v")
            .where("m <> low")
            .select(F.col("m").alias("v"), F.col("low").alias("m"))
        )
        if passed.isEmpty():
            break
        edges = stored(lowest.select("v", F.col("low").alias("m")).unionByName(passed).distinct(), "links")
    while True:
        upper = edges.select(F.col("v").alias("m"), F.col("m").alias("top"))
        jumped = stored(edges.join(upper, "m", "left").select("v", F.coalesce("top", "m").alias("m"), F.col("top").isNotNull().alias("moved")), "links")
        edges = jumped.select("v", "m")
        if jumped.where("moved").isEmpty():
            return edges


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents link when their fingerprints differ in at most ``max_distance``
    bits; component_id is the smallest doc_id that links lead to. Null, empty and
    white texts have fingerprint zero and link like any other. Rows without a
    doc_id link others too; their component_id is null if they reach no id. Ids
    must be below 2^62.
    Repeated rows count once. An empty table gives an empty one.
    """
    prints = stored(add_simhash(docs), "simhash")
    nameless = F.lit(NAMELESS) + F.pmod(F.col("fp"), F.lit(NAMELESS))
    # Fingerprints that differ only in the two bits lost here must be linked anyway.
    if max_distance < 2:
        raise ValueError("max_distance must be at least 2")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("id", F.coalesce("id", nameless)), "distinct")
    roots = components(near_links(distinct, max_distance))
    groups = stored(
        distinct.join(roots, distinct["id"] == roots["v"], "left").select("fp", F.coalesce("m", "id").alias("component_id")),
        "groups",
    )
    return prints.join(groups, "fp").select(
        "doc_id", "fp", F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Keep the smallest doc_id of every group of near duplicates, all columns as they are.

    Of rows that repeat a doc_id one stays, the first by a hash of its text. A row
    without doc_id can't be told from others and stays.
    """
    return one_of_each(docs, near_duplicates(docs, max_distance))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``one_of_each_group`` for given groups (doc_id, component_id)."""
    going = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__goes")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    rest = named.join(going, named["doc_id"] == going["__goes"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = rest.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
