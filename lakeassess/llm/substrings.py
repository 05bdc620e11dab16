"""Repeated word passages by level-wise doubling of windows.

A window can only be repeated if the shorter windows in it are. The search starts
with short windows, finds which are repeated, and extends these alone to twice
their length, until the full length is reached (its last step may be shorter than
a doubling) or none is left. ``longest_repeats`` goes on doubling beyond it.

Not every short window is looked at: each full window chooses its seed, the one
of smallest rank, by its own words, and at every level the window of that length
around the seed. Equal full windows choose equally at every level, so none is
lost. What is repeated at a level is marked in a bit set of bounded size, and the
next level hashes only windows whose choice is marked. A bit may stand for
several windows, which lets some through that are not repeated; the next level
then counts exactly.

The last level decides by 96 bits: two hashes from words hashed apart. Only a first
hash that stands for several windows takes the second one along to the documents.

Which hashes are repeated is found from packed runs: a task sorts its hashes,
keeps one entry per hash with the range of its doc_ids, and sends each range of
hashes as one row of differences. A hash that is everywhere so gives one entry
per task. The number of ranges follows the bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .store import partitions, stored
from .words import Words, blocks, mix, span_hashes, window_hashes, window_starts

WINDOW = 13
SEED = 4
#: Bits for each window found twice, and the most bits of all (128 MB).
BITS_PER_SEED = 16
MOST_BITS = 1 << 30
_CELL = 1 << 16
#: Hashes a task holds before it packs them.
HELD = 2_000_000
#: Text whose hashes one range of the shuffle should hold, in bytes.
PART_TEXT = 128 << 20
#: Start of the second hash of a word.
_SALT = 0x5851F42D4C957F2D


def _lengths(size: int) -> list[int]:
    """Window lengths of the levels up to the full one."""
    out = [min(SEED, size)]
    while out[-1] < size:
        out.append(min(2 * out[-1], size))
    return out


def _chosen(rank: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Leftmost place of the smallest of the ``span`` ranks from each position, by doubling."""
    place, width = np.arange(len(rank)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(rank[right] < rank[left], right, left)

    while width * 2 <= span:
        place = better(place[: len(place) - width], place[width:])
        width *= 2
    return better(place[at], place[at + span - width])


def _around(place: np.ndarray, at: np.ndarray, size: int, length: int) -> np.ndarray:
    """Start of the window of ``length`` words at the seed in each full window: the
    seed begins it, or ends it where it would reach beyond the full window."""
    seed = min(SEED, size)
    start = np.where(place + length <= at + size, place, place + seed - length)
    return np.clip(start, at, at + size - length)


def _level(words: Words, size: int, length: int, before: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of a level's windows of ``length`` words.

    They lie in full windows of ``size`` words whose choice at the level ``before``
    is marked. A length below ``size`` gives the choices, once each.
    """
    hashes, at = words.hashes(), window_starts(words, max(size, length))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seed = min(SEED, size)
    place = _chosen(mix(window_hashes(hashes, seed)), at, size - seed + 1)
    if bits is not None:
        some = np.flatnonzero(_is_marked(bits, window_hashes(hashes, before)[_around(place, at, size, before)]))
        at, place = at[some], place[some]
    if length < size:
        at = np.unique(_around(place, at, size, length))
    return at, window_hashes(hashes, length)[at]


def _second(words: Words, at: np.ndarray, length: int) -> np.ndarray:
    """Further hash of the windows at some positions; words outside them are not hashed."""
    if not len(at):
        return np.zeros(0, np.uint64)
    n = len(words.start)
    inside = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1))[:n] > 0
    hashes = np.zeros(n, np.uint64)
    hashes[inside] = span_hashes(words.data, words.start[inside], words.end[inside], _SALT)
    return window_hashes(hashes, length)[at] >> np.uint64(32)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _windows_of(batches: Iterator[pa.RecordBatch], size: int, length: int, before: int, bits: np.ndarray | None) -> Iterator[tuple]:
    """(doc_ids, text, position, hash, second hash) of a level's windows in each block.

    The second hash is zero at levels that only narrow the search.
    """
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for start, end, data, offsets in blocks(batch.column("text")):
            words = Words(data, offsets)
            at, window = _level(words, size, length, before, bits)
            text = np.searchsorted(words.first, at, side="right") - 1
            second = _second(words, at, length) if length >= size else np.zeros(len(at), np.uint64)
            yield ids[start:end], text, at - words.first[text], window, second


def _is_marked(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    slot = seeds & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bytes(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest takes; one byte says how many."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unbytes(raw: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    width = raw[at]
    out = np.zeros((count, 8), np.uint8)
    end = at + 1 + count * width
    out[:, :width] = np.frombuffer(raw[at + 1 : end], np.uint8).reshape(count, width)
    return out.reshape(-1).view("<u8"), end


def _merged(hashes: np.ndarray, second: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per pair of hashes, in order, with the range of its doc_ids."""
    order = np.lexsort((second, hashes)) if second.any() else np.argsort(hashes, kind="stable")
    hashes, second, low, high = hashes[order], second[order], low[order], high[order]
    if not len(hashes):
        return hashes, second, low, high
    starts = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])))
    return hashes[starts], second[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)


def _packed(hashes: np.ndarray, second: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (part, run) of merged entries; a part is a range of hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    numbers, runs = [], []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            base = low[a:b].min()
            raw = np.array([b - a, base], "<i8").tobytes()
            raw += _bytes(np.diff(hashes[a:b], prepend=np.uint64(0))) + _bytes(second[a:b])
            # Few hashes are in several documents of a task.
            more = high[a:b] - low[a:b]
            raw += _bytes((low[a:b] - base).view(np.uint64)) + np.packbits(more > 0).tobytes()
            raw += _bytes(more[more > 0].view(np.uint64))
            numbers.append(part[a])
            runs.append(raw)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(runs, pa.binary())], ["part", "run"])


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    count, base = np.frombuffer(raw[:16], "<i8").tolist()
    steps, at = _unbytes(raw, 16, count)
    second, at = _unbytes(raw, at, count)
    low, at = _unbytes(raw, at, count)
    low = low.view(np.int64) + base
    end = at + (count + 7) // 8
    several = np.flatnonzero(np.unpackbits(np.frombuffer(raw[at:end], np.uint8), count=count))
    more, _ = _unbytes(raw, end, len(several))
    high = low.copy()
    high[several] += more.view(np.int64)
    return np.cumsum(steps, dtype=np.uint64), second, low, high


def _parts(docs: DataFrame) -> int:
    """Ranges of hashes: one per ``PART_TEXT`` bytes of text, and no fewer than shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // PART_TEXT))


def _repeated(docs: DataFrame, size: int, length: int, before: int, marked, parts: int) -> DataFrame:
    """(h, g, lowest): hash of a level's windows found in more than one document, with
    the smallest doc_id; the second hash too where the first stands for several windows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for ids, text, _, window, second in _windows_of(batches, size, length, before, marked.value if marked else None):
            held.append((window, second, ids[text]))
            if sum(len(h) for h, _, _ in held) > HELD:
                yield _entries(held, parts)
                held = []
        if held:
            yield _entries(held, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is one part.
        runs = [_unpacked(raw.as_py()) for batch in batches for raw in batch.column("run")]
        if runs:
            hashes, second, low, high = _merged(*(np.concatenate(x) for x in zip(*runs)))
            next_same = np.append(hashes[1:] == hashes[:-1], False)
            unsure = next_same | np.append(False, next_same[:-1])
            some = low < high
            g = pa.array(second[some].view(np.int64), mask=~unsure[some])
            yield pa.RecordBatch.from_arrays([_signed(hashes[some]), g, pa.array(low[some])], ["h", "g", "lowest"])

    packed = docs.mapInArrow(pack, "part int, run binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(merge, "h bigint, g bigint, lowest bigint")


def _entries(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    hashes, second, ids = (np.concatenate(x) for x in zip(*held))
    return _packed(*_merged(hashes, second, ids, ids), parts)


def _occurrences(docs: DataFrame, size: int, length: int, before: int, marked) -> DataFrame:
    """(h, g, doc_id, at) of all windows of a level; g is their second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text, at, window, second in _windows_of(batches, size, length, before, marked.value if marked else None):
            columns = [_signed(window), _signed(second), pa.array(ids[text]), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "g", "doc_id", "at"])

    return docs.mapInArrow(run, "h bigint, g bigint, doc_id bigint, at int")


def _marks(found: DataFrame):
    """Bit set of a table of hashes as a broadcast of at most ``MOST_BITS`` bits."""
    size = 1 << int(found.count() * BITS_PER_SEED).bit_length()
    size = min(max(size, _CELL), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("h").to_numpy().view(np.uint64) & np.uint64(size - 1)
            cell = (slot // np.uint64(_CELL)).astype(np.int64)
            for c in np.unique(cell).tolist():
                some = (slot[cell == c] % np.uint64(_CELL)).astype(np.int64)
                bits = cells.setdefault(c, np.zeros(_CELL, bool))
                bits[some] = True
        for c, bits in cells.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["cell", "bits"])

    cell = F.col("h").bitwiseAND(F.lit(size - 1)) / F.lit(_CELL)
    parts = found.select("h").repartition(F.floor(cell)).mapInArrow(run, "cell bigint, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in parts.collect():
        bits[row["cell"] * _CELL // 8 :][: _CELL // 8] |= np.frombuffer(row["bits"], np.uint8)
    return found.sparkSession.sparkContext.broadcast(bits)


def _prepared(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, text); rows without id or text have no windows."""
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _narrowed(docs: DataFrame, size: int, parts: int) -> tuple[int, object]:
    """Length of the level below the full one and its marks, by doubling from the seeds.

    (0, None) where the full window is no longer than a seed.
    """
    before, marked = 0, None
    for length in _lengths(size)[:-1]:
        found = stored(_repeated(docs, size, length, before, marked, parts), "level")
        if marked is not None:
            marked.unpersist()
        before, marked = length, _marks(found)
    return before, marked


def earlier_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, h, g): hashes of each document's windows that a smaller doc_id has too.

    Where g is not null, only windows with that second hash are meant.
    """
    rows = _prepared(docs)
    parts = _parts(rows)
    before, marked = _narrowed(rows, size, parts)
    repeated = stored(_repeated(rows, size, size, before, marked, parts), "repeated")
    windows = _occurrences(rows, size, size, before, marked).select("h", "doc_id")
    # Nothing but the scan and a file is joined, so a hot window's partition can be split.
    return windows.join(repeated, "h").where("lowest < doc_id").select("doc_id", "h", "g")


def longest_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, at, length): repeated windows at every doubled length.

    Starts with the windows of ``size`` words found in several documents. A window
    of twice the length is looked at only where both its halves are repeated; the
    search ends with the first length that has no repeat. Rows of one doc_id with
    different texts are not told apart here.
    """
    rows, keys, length = _prepared(docs), ["doc_id", "at"], size
    parts = _parts(rows)
    before, marked = _narrowed(rows, size, parts)
    level, found = None, None
    while True:
        # The first ``size`` words of a longer window choose for it.
        windows = _occurrences(rows, size, length, before, marked)
        if level is not None:
            second = level.withColumn("at", F.col("at") - F.lit(length // 2))
            windows = windows.join(level, keys, "left_semi").join(second, keys, "left_semi")
        repeated = stored(_repeated(rows, size, length, before, marked, parts), "repeated")
        same = repeated.select(F.col("h").alias("__h"), F.col("g").alias("__g"))
        meant = (F.col("h") == F.col("__h")) & (F.col("__g").isNull() | (F.col("__g") == F.col("g")))
        level = stored(windows.join(same, meant, "left_semi").select(*keys).distinct(), "level")
        here = level.withColumn("length", F.lit(length))
        found = here if found is None else found.unionByName(here)
        if level.isEmpty():
            return found
        length *= 2


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Add n_words, n_removed and kept_text: words covered by earlier windows go.

    Kept words are joined by one space. Windows are judged on the input. Null
    text has no words. Rows without doc_id are kept whole and remove nothing;
    rows of one doc_id don't count as earlier than each other. Columns with the
    new names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "__earlier", "__unsure", "__key")
    lists = (F.collect_set(F.when(F.col("g").isNull(), F.col("h"))), F.collect_set(F.when(F.col("g").isNotNull(), F.struct("h", "g"))))
    earlier = earlier_windows(docs, size).groupBy("doc_id").agg(lists[0].alias("__earlier"), lists[1].alias("__unsure"))
    joined = docs.join(earlier.withColumnRenamed("doc_id", "__key"), F.col("doc_id") == F.col("__key"), "left").drop("__key")
    names = docs.columns
    added = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    schema = StructType([*docs.schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                part = batch.slice(start, end - start)
                yield _kept(part, names, schema.names, data, offsets, size)

    return joined.mapInArrow(run, schema)


def _meant(words: Words, at: np.ndarray, window: np.ndarray, sure: np.ndarray, unsure: list[dict], size: int) -> np.ndarray:
    """Positions of one text whose window is among the sure hashes or the unsure pairs."""
    hit = np.isin(window, sure)
    if unsure:
        pairs = {(p["h"], p["g"]) for p in unsure}
        own = zip(window.view(np.int64).tolist(), _second(words, at, size).tolist())
        hit |= np.fromiter((pair in pairs for pair in own), bool, len(at))
    return at[hit]


def _kept(part: pa.RecordBatch, names: list[str], out: list[str], data: np.ndarray, offsets: np.ndarray, size: int) -> pa.RecordBatch:
    words, lists, unsure, raw = Words(data, offsets), part.column("__earlier"), part.column("__unsure"), data.tobytes()
    at = window_starts(words, size)
    window = window_hashes(words.hashes(), size)[at]
    from_text = np.searchsorted(at, words.first)
    removed, kept = [], []
    for i in range(part.num_rows):
        own = raw[offsets[i] : offsets[i + 1]].split()
        sure = lists[i].values
        if sure is not None:
            some = slice(from_text[i], from_text[i + 1])
            here = _meant(words, at[some], window[some], sure.to_numpy().view(np.uint64), unsure[i].as_py(), size) - words.first[i]
            steps = np.zeros(len(own) + 1, np.int32)
            np.add.at(steps, here, 1)
            np.add.at(steps, here + size, -1)
            stays = (np.cumsum(steps[:-1]) == 0).tolist()
            removed.append(len(own) - sum(stays))
            own = [w for w, s in zip(own, stays) if s]
        else:
            removed.append(0)
        kept.append(b" ".join(own).decode())
    columns = [part.column(n) for n in names] + [pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, out)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
