"""Near copies by Jaccard similarity of word shingles, checked exactly.

Texts of similarity 0.8 differ in about 10 of 64 SimHash bits. A ball that wide
crosses every median split, so vantage-point trees over the whole corpus would
compare all pairs. Documents are therefore dealt by bands of minimum hashes: two
meet if one of ``BANDS`` bands of ``ROWS`` minima is equal, which misses a pair of
similarity 0.8 once in about 600 cases and a closer one less often. Where they
meet, a vantage-point tree finds the pairs whose SimHashes over distinct shingles
are at most ``RADIUS`` bits apart, and each is checked by its shingles.

Equal shingle sets are one member. Bands that bring the same members together
count once. A crowded band is cut into slices, and each pair of slices is searched
by itself. Texts move only for documents that meet another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import NAMELESS, close_pairs, components, distance, majority, shingle_hashes
from .store import stored
from .words import blocks

SHINGLE = 5
LEAST = 0.8
BANDS = 17
ROWS = 5
#: Bits of 64; at similarity 0.8 the distance is 9.7 with a deviation of 2.9.
RADIUS = 24
SLICE = 512

_random = np.random.default_rng(5)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands(values: np.ndarray) -> list[int]:
    """A signed hash for each band of minima; of no shingles, that of nothing."""
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 4096):
        part = values[k : k + 4096, None] * _FACTORS + _SHIFTS
        lowest = np.minimum(lowest, part.min(axis=0))
    raw = lowest.astype("<u8").tobytes()
    step = 8 * ROWS
    return [_signed(xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k)) for k in range(BANDS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text, key, fp, bands): the key is a hash of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                raw, bounds = data.tobytes(), offsets.tolist()
                keys, prints, found = [], [], []
                for a, b in zip(bounds, bounds[1:]):
                    values = np.unique(shingle_hashes(raw[a:b], shingle))
                    keys.append(_signed(xxhash.xxh64_intdigest(values.tobytes())))
                    prints.append(_signed(majority(values)))
                    found.append(bands(values))
                part = batch.slice(start, end - start)
                columns = [part.column("doc_id"), part.column("text"), pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "key", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id bigint, text string, key bigint, fp bigint, bands array<bigint>")


def linked(points: np.ndarray, sets: list[np.ndarray], side: np.ndarray, across: bool, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of positions at least ``least`` similar that connect all such pairs,
    those of two sides only if ``across``."""
    closest: list[tuple[np.ndarray, np.ndarray]] = []

    def found(a: np.ndarray, b: np.ndarray) -> None:
        some = (side[a] != side[b]) if across else a > b
        a, b = a[some], b[some]
        size = np.array([len(s) for s in sets])
        some = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
        closest.append((a[some], b[some]))

    home = np.flatnonzero(side == side.min()) if across else np.arange(len(points))
    close_pairs(points, home, RADIUS, found)
    if not closest:
        return
    a, b = (np.concatenate(x) for x in zip(*closest))
    order = np.argsort(distance(points[a], points[b]), kind="stable")
    lead, members = list(range(len(points))), {}

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = i = lead[lead[i]]
        return i

    def shingles(i: int) -> frozenset:
        if i not in members:
            members[i] = frozenset(sets[i].tolist())
        return members[i]

    for i, j in zip(a[order].tolist(), b[order].tolist()):
        one, other = top(i), top(j)
        if one == other:
            continue
        x, y = shingles(i), shingles(j)
        both = len(x & y)
        if both >= least * (len(x) + len(y) - both):
            lead[one] = other
            yield i, j


def _links(meetings: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (v, m) found in every tile of ``meetings`` (bucket, low, high, side, id, fp, text)."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        sets = [np.unique(shingle_hashes((t or "").encode(), shingle)) for t in table["text"].to_pylist()]
        points = table["fp"].to_numpy().view(np.uint64)
        across = held[0].column("low")[0].as_py() != held[0].column("high")[0].as_py()
        pairs = [(max(x), min(x)) for i, j in linked(points, sets, side, across, least) if (x := (int(ids[i]), int(ids[j])))[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["v", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("bucket", "low", "high")])
            cuts = [0, *(np.flatnonzero((np.diff(places) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                here = tuple(places[:, a].tolist())
                if here != place and held:
                    yield found(held)
                    held = []
                place = here
                held.append(batch.slice(a, b - a))
        if held:
            yield found(held)

    tile = ["bucket", "low", "high"]
    return meetings.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "v bigint, m bigint")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of every document.

    Documents link when the Jaccard similarity of their shingle sets is at least
    ``least``; bands are set for 0.8 and more. Texts below ``shingle`` words are one
    shingle; null, empty and white texts link with each other. component_id is the
    smallest doc_id that links lead to, null if they reach none. Ids must be below
    2^62. An empty table gives an empty one.
    """
    prints = stored(_prints(docs, shingle), "prints")
    nameless = F.lit(NAMELESS) + F.pmod(F.col("key"), F.lit(NAMELESS))
    one = prints.groupBy("key").agg(F.min("doc_id").alias("own"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    distinct = stored(one.withColumn("id", F.coalesce("own", nameless)), "distinct")
    places = distinct.select("key", F.explode("bands").alias("bucket"))
    marks = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    crowds = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    chosen = stored(crowds.groupBy("n", "mark0", "mark1").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "crowds")
    members = stored(places.join(chosen, "bucket"), "members")
    met = distinct.join(members.select("key").distinct(), "key").select(F.col("key").alias("__key"), "own", "id", "fp")
    same = (prints["key"] == F.col("__key")) & prints["doc_id"].eqNullSafe(F.col("own"))
    texts = prints.select("key", "doc_id", "text").join(met, same).select("key", "id", "fp", "text").dropDuplicates(["key"])
    texts = stored(texts, "texts")
    slices = F.ceil(F.col("n") / F.lit(SLICE)).cast("int")
    dealt = (
        members.withColumn("slices", slices)
        .withColumn("side", F.pmod(F.xxhash64("key", "bucket"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "key")
    )
    links = _links(dealt.join(texts, "key").select("bucket", "low", "high", "side", "id", "fp", "text"), shingle, least)
    roots = components(links)
    groups = distinct.join(roots, distinct["id"] == roots["v"], "left").select("key", F.coalesce("m", "id").alias("component_id"))
    found = prints.select("doc_id", "key").join(stored(groups, "groups"), "key")
    return found.select("doc_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id"))
