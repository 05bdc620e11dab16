"""Near-duplicate embeddings through a robust-pruned flat graph.

Equal vectors are combined first. Cluster centres are fitted to a bounded sample;
every vector joins the shards of its nearest centres, so shards overlap. A shard
builds a graph whose lists are pruned robustly (a neighbour goes if a chosen one
is clearly nearer to it) and closed under reversal. The lists a vector got in its
shards are united. Each vector then asks in the shard of its nearest centre: a
greedy search from the shard's medoids, widened to everything in range as long as
something new is in range, and every pair is verified in double precision.

A bounded set of vectors is compared with all others; should fewer of their links
be found than ``LEAST_RECALL``, the search is repeated with wider beams. A crowded
shard is built in parts, and all parts are asked, so no task holds an unbounded
shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simhash import Groups, components
from .store import stored

LEAST_COSINE = 0.95
LEAST_RECALL = 0.97
#: Shards a vector joins, and vectors a centre has on average.
OVERLAP = 3
CENTRE_VECTORS = 1024
MOST_CENTRES = 1024
#: Vectors the centres are fitted to, and vectors audited.
SAMPLE = 16_384
AUDITED = 512
#: Most vectors of a part of a shard, and most questions of a task.
PART_VECTORS = 8192
TASK_QUESTIONS = 16_384
DEGREE = 24
CANDIDATES = 64
STRANGERS = 16
ALPHA = 1.2
MEDOIDS = 32
BEAM = 48
WIDEST_BEAM = 768
SEED = 42


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded by zeros, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return unit(out), sizes


def unit(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def fit_centres(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample."""
    random = np.random.default_rng(SEED)
    centres = x[random.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[k : k + 4096] @ centres.T).argmax(axis=1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """Centres of each vector, the nearest first."""
    width = max(x.shape[1], centres.shape[1])
    near = widened(x, width) @ widened(centres, width).T
    return np.argsort(-near, axis=1, kind="stable")[:, :count]


def prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robustly pruned lists: the nearest candidate stays, those go that lie ``alpha``
    times nearer to it than to the point itself, and so on. -1 fills up."""
    out = np.full((len(own), degree), -1, np.int64)
    for k in range(0, len(own), 256):
        points, some = own[k : k + 256], candidates[k : k + 256]
        cx = x[some]
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", cx, x[points])))
        gone = (some < 0) | (some == points[:, None])
        away = np.where(gone, np.inf, away)
        order = np.argsort(away, axis=1, kind="stable")
        some, away = np.take_along_axis(some, order, 1), np.take_along_axis(away, order, 1)
        cx = np.take_along_axis(cx, order[:, :, None], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(cx, cx.transpose(0, 2, 1))))
        alive, rows = np.isfinite(away), np.arange(len(points))
        # A candidate listed twice lies at no distance from itself and goes with the first.
        for d in range(degree):
            first = alive.argmax(axis=1)
            live = alive[rows, first]
            if not live.any():
                break
            out[k + rows[live], d] = some[rows[live], first[live]]
            alive &= alpha * between[rows, first] > away
            alive[rows, first] = False
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Neighbour lists of the points of one shard."""
    n, random = len(x), np.random.default_rng(SEED)
    x = x.astype(np.float32)
    if n < 2:
        return np.full((n, DEGREE), -1, np.int64)
    count, lists = min(CANDIDATES, n - 1), []
    for k in range(0, n, 512):
        near = x[k : k + 512] @ x.T
        near[np.arange(len(near)), k + np.arange(len(near))] = -2
        lists.append(np.argpartition(-near, count - 1, axis=1)[:, :count])
    points = np.arange(n)
    own = prune(x, points, np.concatenate([np.concatenate(lists), random.integers(0, n, (n, min(STRANGERS, n)))], axis=1))
    # Every edge is offered to its other end as well.
    p, q = np.repeat(points, DEGREE), own.ravel()
    p, q = p[q >= 0], q[q >= 0]
    edges = np.unique(np.concatenate([p * n + q, q * n + p]))
    p, q = edges // n, edges % n
    near = np.concatenate([np.einsum("ed,ed->e", x[p[k : k + 65536]], x[q[k : k + 65536]]) for k in range(0, len(p), 65536)])
    order = np.lexsort((-near, p))
    p, q = p[order], q[order]
    place = np.arange(len(p)) - np.searchsorted(p, p)
    both = np.full((n, int(min(place.max(initial=0) + 1, 3 * DEGREE))), -1, np.int64)
    some = place < both.shape[1]
    both[p[some], place[some]] = q[some]
    return connected(x, prune(x, points, both))


def _reached(lists: np.ndarray, seen: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Mark what can be reached from ``front``; returns all that was marked."""
    found = [front]
    seen[front] = True
    while len(front):
        front = np.unique(lists[front])
        front = front[(front >= 0) & ~seen[front]]
        seen[front] = True
        found.append(front)
    return np.concatenate(found)


def connected(x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Lists by which the medoids reach every point: pruning may have cut some off,
    of which the one nearest to a reached point is entered from there, and so on."""
    seen = np.zeros(len(x), bool)
    _reached(lists, seen, medoids(x))
    lost = np.flatnonzero(~seen)
    best, entry = np.full(len(lost), -3.0, np.float32), np.zeros(len(lost), np.int64)
    new, more = np.flatnonzero(seen), []
    while len(lost):
        for k in range(0, len(new), 2048):
            near = x[lost] @ x[new[k : k + 2048]].T
            at = near.argmax(axis=1)
            top = near[np.arange(len(lost)), at]
            entry, best = np.where(top > best, new[k + at], entry), np.maximum(top, best)
        i = int(best.argmax())
        more.append((entry[i], lost[i]))
        new = _reached(lists, seen, lost[i : i + 1])
        left = ~seen[lost]
        lost, best, entry = lost[left], best[left], entry[left]
    if not more:
        return lists
    ways = np.array(sorted(more))
    place = np.arange(len(ways)) - np.searchsorted(ways[:, 0], ways[:, 0])
    out = np.full((len(lists), lists.shape[1] + int(place.max()) + 1), -1, np.int64)
    out[:, : lists.shape[1]] = lists
    out[ways[:, 0], lists.shape[1] + place] = ways[:, 1]
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """Points nearest to the centres of the shard and of its inner clusters."""
    x = x.astype(np.float32)
    centres = fit_centres(x[: 4 * PART_VECTORS], min(MEDOIDS, len(x)), 3)
    return np.unique((np.concatenate([x.mean(axis=0, keepdims=True), centres]) @ x.T).argmax(axis=1))


def search(x: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, asking: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, point) of points found with at least the cosine ``least``, in blocks
    of questions; each pair verified in double precision."""
    x32, n, beam = x.astype(np.float32), len(x), min(beam, len(x))
    loose = least - 1e-4
    for k in range(0, len(asking), 256):
        q64 = asking[k : k + 256]
        q = q64.astype(np.float32)
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        done = np.zeros((len(q), n), bool)
        inside = np.zeros((len(q), n), bool)
        near = q @ x32[starts].T
        seen[:, starts] = True
        inside[:, starts] = near >= loose
        held, value = np.broadcast_to(starts, near.shape), near
        while True:
            order = np.argsort(-value, axis=1, kind="stable")[:, :beam]
            held, value = np.take_along_axis(held, order, 1), np.take_along_axis(value, order, 1)
            fresh = ~done[rows, held] & (value > -2)
            # The best few that were not expanded, for every question.
            rank = np.cumsum(fresh, axis=1)
            take = fresh & (rank <= 4)
            if not take.any():
                break
            at, col = np.nonzero(take)
            node = held[at, col]
            done[at, node] = True
            at, node = np.repeat(at, adjacent.shape[1]), adjacent[node].ravel()
            some = node >= 0
            at, node = _new(at[some], node[some], seen, n)
            sims = _cosines(q, x32, at, node)
            inside[at, node] = sims >= loose
            counts = np.bincount(at, minlength=len(q))
            place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            more = np.zeros((len(q), int(counts.max(initial=0))), np.int64)
            worth = np.full(more.shape, -3, np.float32)
            more[at, place], worth[at, place] = node, sims
            held, value = np.concatenate([held, more], axis=1), np.concatenate([value, worth], axis=1)
        while True:
            at, node = np.nonzero(inside & ~done)
            if not len(at):
                break
            for j in range(0, len(at), 1 << 16):
                a, u = at[j : j + (1 << 16)], node[j : j + (1 << 16)]
                done[a, u] = True
                a, u = np.repeat(a, adjacent.shape[1]), adjacent[u].ravel()
                a, u = _new(a[u >= 0], u[u >= 0], seen, n)
                inside[a, u] = _cosines(q, x32, a, u) >= loose
        at, node = np.nonzero(inside)
        if len(at):
            true = _cosines(q64, x, at, node) >= least
            yield k + at[true], node[true]


def _new(at: np.ndarray, node: np.ndarray, seen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    fresh = ~seen[at, node]
    pairs = np.unique(at[fresh] * n + node[fresh])
    at, node = pairs // n, pairs % n
    seen[at, node] = True
    return at, node


def _cosines(q: np.ndarray, x: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = [np.einsum("ed,ed->e", q[at[k : k + 65536]], x[node[k : k + 65536]]) for k in range(0, len(at), 65536)]
    return np.concatenate(out) if out else np.zeros(0, x.dtype)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Tables of consecutive rows of one place."""
    place, held = None, []
    for batch in batches:
        places = batch.column("place").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if places[a] != place and held:
                    yield place, pa.Table.from_batches(held)
                    held = []
                place = int(places[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield place, pa.Table.from_batches(held)


class Shards:
    """Centres, the parts of each shard, and where a vector builds and asks."""

    def __init__(self, centres: np.ndarray, overlap: int):
        self.centres, self.overlap = centres, min(overlap, len(centres))
        self.parts = np.ones(len(centres), np.int64)
        self.asks = np.ones(len(centres), np.int64)

    def sized(self, members: np.ndarray, questions: np.ndarray) -> None:
        self.parts = np.maximum(1, -(-members // PART_VECTORS))
        self.asks = np.maximum(1, -(-questions // TASK_QUESTIONS))
        self.first_part = np.concatenate([[0], np.cumsum(self.parts)])
        self.first_task = np.concatenate([[0], np.cumsum(self.parts * self.asks)])


def _scrambled(rid: np.ndarray) -> np.ndarray:
    return (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _counted(vectors: DataFrame, shards: Shards) -> tuple[np.ndarray, np.ndarray]:
    """Members and questions of each shard; a row per centre comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, questions = (np.zeros(len(shards.centres), np.int64) for _ in range(2))
        for batch in batches:
            near = nearest(matrix(batch.column("embedding"))[0], shards.centres, shards.overlap)
            np.add.at(members, near.ravel(), 1)
            np.add.at(questions, near[:, 0], 1)
        at = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(members[at]), pa.array(questions[at])], ["shard", "members", "questions"])

    rows = vectors.select("embedding").mapInArrow(run, "shard bigint, members bigint, questions bigint")
    members, questions = (np.zeros(len(shards.centres), np.int64) for _ in range(2))
    for r in rows.groupBy("shard").agg(F.sum("members"), F.sum("questions")).collect():
        members[r[0]], questions[r[0]] = r[1], r[2]
    return members, questions


def _dealt(vectors: DataFrame, shards: Shards, asking: bool) -> DataFrame:
    """Vectors in every place where they build; with ``asking``, in every task where
    they answer (``home`` false) or ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(matrix(batch.column("embedding"))[0], shards.centres, shards.overlap)
            spread = _scrambled(batch.column("rid").to_numpy())
            for c in range(near.shape[1]):
                shard = near[:, c]
                part = (spread % shards.parts[shard].astype(np.uint64)).astype(np.int64)
                if not asking:
                    yield _placed(batch, shards.first_part[shard] + part, False, slice(None))
                    continue
                for ask in range(int(shards.asks[shard].max(initial=1))):
                    some = np.flatnonzero(ask < shards.asks[shard])
                    place = shards.first_task[shard] + part * shards.asks[shard] + ask
                    yield _placed(batch, place[some], False, some)
            if asking:
                shard = near[:, 0]
                ask = ((spread >> np.uint64(16)) % shards.asks[shard].astype(np.uint64)).astype(np.int64)
                for part in range(int(shards.parts[shard].max(initial=1))):
                    some = np.flatnonzero(part < shards.parts[shard])
                    place = shards.first_task[shard] + part * shards.asks[shard] + ask
                    yield _placed(batch, place[some], True, some)

    names = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema]
    return vectors.mapInArrow(run, ", ".join(["place int", "asks boolean", *names]))


def _placed(batch: pa.RecordBatch, place: np.ndarray, asks: bool, some) -> pa.RecordBatch:
    if not isinstance(some, slice):
        batch = batch.take(pa.array(some))
    columns = [pa.array(place.astype(np.int32)), pa.array(np.full(len(place), asks)), *batch.columns]
    return pa.RecordBatch.from_arrays(columns, ["place", "asks", *batch.schema.names])


def united_lists(vectors: DataFrame, shards: Shards) -> DataFrame:
    """(rid, neighbours): the lists of every vector over all its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _places(batches):
            rid = table["rid"].to_numpy()
            order = np.argsort(rid)  # so that the search finds the same medoids
            table, rid = table.take(pa.array(order)), rid[order]
            lists = build(matrix(table["embedding"])[0])
            sizes = (lists >= 0).sum(axis=1)
            flat = rid[lists[lists >= 0]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))], ["rid", "neighbours"])

    places = int(shards.first_part[-1])
    dealt = _dealt(vectors.select("rid", "embedding"), shards, False).drop("asks")
    built = dealt.repartitionById(places, F.col("place")).sortWithinPartitions("place").mapInArrow(run, "rid bigint, neighbours array<bigint>")
    # As many lists as a vector has shards.
    return built.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


_FOUND = "rid bigint, leader bigint, links bigint"


def found_links(vectors: DataFrame, shards: Shards, least: float, beam: int) -> DataFrame:
    """(rid, leader, links): rows of a question in a task with the copies it found
    there, and of any vector linked there to a smaller ``leader``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _places(batches):
            asks = table["asks"].to_numpy()
            here, there = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
            rid = here["rid"].to_numpy()
            order = np.argsort(rid)
            here, rid = here.take(pa.array(order)), rid[order]
            asker = there["rid"].to_numpy()
            if not len(rid) or not len(asker):
                continue
            (x, sizes), (q, q_sizes) = matrix(here["embedding"]), matrix(there["embedding"])
            width = max(x.shape[1], q.shape[1])
            x, q = widened(x, width), widened(q, width)
            copies = here["copies"].to_numpy()
            lists = here["neighbours"].combine_chunks()
            adjacent = _local(rid, lists)
            both = np.union1d(rid, asker)
            groups, links = Groups(len(both)), np.zeros(len(asker), np.int64)
            for at, node in search(x, adjacent, medoids(x), q, least, beam):
                true = (asker[at] != rid[node]) & (q_sizes[at] == sizes[node])
                at, node = at[true], node[true]
                np.add.at(links, at, copies[node])
                groups.join(np.searchsorted(both, asker[at]), np.searchsorted(both, rid[node]))
            some = np.flatnonzero(links)
            apart = np.flatnonzero(groups.lead != np.arange(len(both)))
            who = np.concatenate([asker[some], both[apart]])
            leader = np.concatenate([asker[some], both[groups.lead[apart]]])
            number = np.concatenate([links[some], np.zeros(len(apart), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(leader), pa.array(number)], ["rid", "leader", "links"])

    dealt = _dealt(vectors, shards, True)
    # Who asks brings no list along.
    dealt = dealt.withColumn("neighbours", F.when(~F.col("asks"), F.col("neighbours")))
    return dealt.repartitionById(int(shards.first_task[-1]), F.col("place")).sortWithinPartitions("place").mapInArrow(run, _FOUND)


def _local(rid: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Lists as places in ``rid``; neighbours that are elsewhere are left out."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(rid, flat), len(rid) - 1)
    at = np.where(rid[at] == flat, at, -1) if len(flat) else at
    out = np.full((len(rid), int(max(1, sizes.max(initial=1)))), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = at
    return out


def audit(vectors: DataFrame, found: DataFrame, least: float = LEAST_COSINE, count: int = AUDITED) -> tuple[int, int]:
    """(links found, links there are) of ``count`` vectors chosen by hash, which are
    compared with all others."""
    asked = vectors.select("rid", "embedding").orderBy(F.xxhash64("rid")).limit(count)
    table = asked.toArrow()
    if not table.num_rows:
        return 0, 0
    rid, (q, q_sizes) = table["rid"].to_numpy(), matrix(table["embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = np.zeros(len(rid), np.int64)
        for batch in batches:
            x, sizes = matrix(batch.column("embedding"))
            width = max(x.shape[1], q.shape[1])
            same = (widened(q, width) @ widened(x, width).T >= least) & (q_sizes[:, None] == sizes[None, :])
            same &= rid[:, None] != batch.column("rid").to_numpy()[None, :]
            true += same @ batch.column("copies").to_numpy()
        some = np.flatnonzero(true)
        yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(true[some])], ["rid", "there"])

    there = vectors.select("rid", "embedding", "copies").mapInArrow(run, "rid bigint, there bigint").groupBy("rid").agg(F.sum("there").alias("there"))
    own = found.groupBy("rid").agg(F.sum("links").alias("links"))
    row = there.join(own, "rid", "left").agg(F.sum(F.coalesce("links", F.lit(0))), F.sum("there")).head()
    return row[0] or 0, row[1] or 0


def usable(embedding: str):
    """Whether a vector has a direction: no null, no infinite component, not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Rows link where the cosine of their vectors is at least ``least``; vectors of
    different lengths don't. Null, zero and non-finite vectors link with nothing.
    component_id is the smallest vec_id reachable, null if no row there has one; a
    row without vec_id is kept if so. Rows repeating a vec_id are rows of their own.
    An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", usable("embedding").alias("usable"))
    alike = rows.where("usable").groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("id"))
    alike = stored(alike.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    total = alike.count()
    sample = alike.select("embedding").orderBy(F.xxhash64("rid")).limit(SAMPLE).toArrow()
    if total:
        count = min(MOST_CENTRES, max(1, total // CENTRE_VECTORS))
        shards = Shards(fit_centres(matrix(sample["embedding"])[0], count), OVERLAP)
        shards.sized(*_counted(alike, shards))
        lists = stored(united_lists(alike, shards), "lists")
        answering = alike.select("rid", "embedding", "copies").join(lists, "rid")
        while True:
            found = stored(found_links(answering, shards, least, beam), "found")
            got, there = audit(alike, found, least)
            if got >= LEAST_RECALL * there or beam >= WIDEST_BEAM:
                break
            beam *= 2
    else:
        found = vectors.sparkSession.createDataFrame([], _FOUND)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.where("leader < rid").select(F.col("rid").alias("v"), F.col("leader").alias("m")))
    own = alike.join(links, "rid", "left").join(roots, F.col("rid") == F.col("v"), "left")
    own = stored(own.select("embedding", "copies", "id", "links", F.coalesce("m", "rid").alias("root")), "own")
    lowest = own.groupBy("root").agg(F.min("id").alias("component_id"))
    known = own.join(lowest, "root").select(
        F.col("embedding").alias("__vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    good = rows.where("usable").join(known, F.col("embedding") == F.col("__vector")).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
