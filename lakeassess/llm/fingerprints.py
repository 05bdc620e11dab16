"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle is hashed once. The top bits of the hash choose a bin, the rest is
its value; a bin keeps its smallest value. An empty bin takes the value of a bin
drawn by a hash of (bin, attempt), attempts going on until a filled one is met.
Bins are then hashed with their number and only the lowest ``bits`` bits stored. Two different values agree
in those by chance with probability ``2**-bits``, which ``likeness`` corrects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .store import partitions, range_bounds, range_of
from .words import Words, blocks, joined, mix, shingles

BINS = 512  # a power of two
BITS = 4  # 1, 2, 4 or 8
SHINGLE = 5

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(data: np.ndarray, offsets: np.ndarray, size: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Densified bin minima (texts x bins), and which texts have any word."""
    text, value = shingles(Words(data, offsets), size)
    shift = np.uint64(64 - bins.bit_length() + 1)
    table = np.full((len(offsets) - 1) * bins, _EMPTY, dtype=np.uint64)
    low = value & ((np.uint64(1) << shift) - np.uint64(1))
    np.minimum.at(table, text * bins + (value >> shift).astype(np.int64), low)
    table = table.reshape(-1, bins)
    filled = table != _EMPTY
    some = filled.any(axis=1)
    single = np.flatnonzero(filled.sum(axis=1) == 1)
    table[single] = table[single].min(axis=1, keepdims=True)
    known = table.copy()
    row, bin_ = np.nonzero((table == _EMPTY) & some[:, None])
    numbers, attempt = np.arange(bins, dtype=np.uint64), 0
    while len(row):
        attempt += 1
        drawn = (mix(numbers + np.uint64(attempt * 0x1000003)) >> shift).astype(np.int64)
        value = known[row, drawn[bin_]]
        hit = value != _EMPTY
        table[row[hit], bin_[hit]] = value[hit]
        row, bin_ = row[~hit], bin_[~hit]
    return table, some


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprint of every text of a block; empty where a text has no word."""
    table, some = signatures(data, offsets, size, bins)
    # A value copied to several bins must not agree by chance in all of them at once.
    table = mix(table ^ (np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    low = (table & np.uint64((1 << bits) - 1)).astype(np.uint8)
    packed = np.zeros((len(low), bins * bits // 8), np.uint8)
    for k in range(8 // bits):
        packed |= low[:, k :: 8 // bits] << np.uint8(8 - bits * (k + 1))
    return [row.tobytes() if any_ else b"" for row, any_ in zip(packed, some)]


def likeness(a: list[bytes], b: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated share of common shingles of each pair, 0 to 1.

    Two texts without words are alike (1); one without and one with are not (0).
    """
    out = np.array([float(not x and not y) for x, y in zip(a, b)])
    both = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
    if both:
        left = np.frombuffer(b"".join(a[i] for i in both), np.uint8).reshape(len(both), -1)
        right = np.frombuffer(b"".join(b[i] for i in both), np.uint8).reshape(len(both), -1)
        differ, part = left ^ right, np.uint8((1 << bits) - 1)
        equal = sum(((differ >> np.uint8(s)) & part == 0).sum(axis=1) for s in range(0, 8, bits))
        share, chance = equal / (left.shape[1] * 8 // bits), 0.5**bits
        out[both] = np.clip((share - chance) / (1 - chance), 0, 1)
    return out


def add_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add the hexadecimal fingerprint of a text column; no shuffle.

    Null and empty texts, and texts of white space alone, get an empty string.
    A column that already has that name is replaced. Equal texts get equal
    fingerprints; order and repeats of rows don't matter.
    """
    schema = StructType([f for f in df.schema if f.name != name] + [StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [p.hex() for _, _, *b in blocks(batch.column(text)) for p in fingerprints(*b, size, bins, bits)]
            columns = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.string())], [f.name for f in schema])

    return df.mapInArrow(run, schema)


EDITED_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, border) in ranges of doc_id, each sorted descending in its partition.

    After its own rows, a range has the rows its successor range begins with,
    marked as border; the lowest range is followed by the highest. So every row's
    successor is the row after it, and texts move in one shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", partitions(spark))
    count = len(bounds) + 1
    rows = rows.withColumn("part", range_of(F.col("doc_id"), bounds))
    # One row per range, so at most as many as partitions.
    tops = {r[0]: r[1] for r in rows.groupBy("part").agg(F.max("doc_id")).collect()}
    order = sorted(tops, reverse=True)
    before = {part: order[i - 1] for i, part in enumerate(order)}
    tops_list = F.expr("array(" + ",".join("NULL" if tops.get(p) is None else f"{tops[p]}L" for p in range(count)) + ")").cast("array<bigint>")
    before_list = F.expr("array(" + ",".join(str(before.get(p, p)) for p in range(count)) + ")")
    place = F.struct(F.col("part"), F.lit(False).alias("border"))
    also = F.struct(F.element_at(before_list, F.col("part") + 1).alias("part"), F.lit(True).alias("border"))
    is_top = F.col("doc_id").eqNullSafe(F.element_at(tops_list, F.col("part") + 1))
    places = F.when(is_top, F.array(place, also)).otherwise(F.array(place))
    return (
        rows.select("doc_id", "text", F.explode(places).alias("place"))
        .select("doc_id", "text", "place.*")
        .repartitionById(count, F.col("part"))
        .sortWithinPartitions("border", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
        .select("doc_id", "text", "border")
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair every row with the next one, across batches, and compare fingerprints."""
    # The last row seen, not yet paired: (doc_id, text, fingerprint).
    held: tuple | None = None
    over = False
    for batch in batches:
        ids, border = batch.column("doc_id").to_pylist(), batch.column("border").to_pylist()
        for start, end, data, offsets in blocks(batch.column("text")):
            if over:
                break
            own = fingerprints(data, offsets)
            raw = data.tobytes()
            rows = [
                (ids[start + i], raw[offsets[i] : offsets[i + 1]].decode(), own[i]) for i in range(end - start)
            ]
            # Only the first border row counts.
            cut = next((i + 1 for i in range(end - start) if border[start + i]), None)
            over = cut is not None
            rows = ([held] if held else []) + rows[:cut]
            held = rows[-1]
            if len(rows) > 1:
                yield _compare(rows)
        if over:
            break


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    edited = []
    for (_, text, _), (_, following, _) in zip(rows, rows[1:]):
        moved = len(text) // 3
        edited.append((text[: len(text) - moved] + following[:moved]).encode())
    prints = fingerprints(*joined(edited))
    own, nexts = [r[2] for r in rows[:-1]], [r[2] for r in rows[1:]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows[:-1]], pa.int64()),
            pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([p.hex() for p in own]),
            pa.array([p.hex() for p in prints]),
            pa.array(likeness(own, prints)),
            pa.array(likeness(own, nexts)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness.

    The edited text has its last third of code points replaced by as many from
    the start of the next document (all of it, if shorter), in descending
    doc_id; the lowest is followed by the highest. Null doc_ids come last, equal
    ones in the order of a hash of their text, so repeated rows follow each
    other. A lone document follows itself. Null text counts as empty.
    """
    return in_descending_order(docs).mapInArrow(_edited, EDITED_SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
