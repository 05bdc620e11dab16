"""Packing token pieces into windows by minimum bin slack.

Documents longer than a window are cut into full windows and a rest. Only the
number of pieces of each length matters for a plan, so it is made from a
histogram of at most ``window`` lengths: the longest piece left opens a window,
a subset-sum over a bitset of reachable fillings picks the multiset of remaining
lengths that comes closest to the capacity, and the window is repeated as often
as the counts allow. Pieces are then numbered within their length, and the number
says which window, and where in it. No piece list ever reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .store import stored
from .tokens import encoder

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
NUMBERED_ROWS = 1_000_000
LEAST_BUCKETS = 64

PIECES_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids of every text, its end id included.

    Null and empty texts are one piece, the end id. ``keep_ids`` adds the ids.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the vocabulary
    schema = PIECES_SCHEMA + (", ids array<int>" if keep_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(sent.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, flat, offsets in to_ids(batch.column("text")):
                rows: list[list] = [[] for _ in names]
                for i in range(end - first):
                    own = np.append(flat[offsets[i] : offsets[i + 1]], end_id).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        values = [ids[first + i], start, len(piece), zlib.crc32(piece.tobytes()), len(own)]
                        for column, value in zip(rows, values + [piece.astype(np.int32)] * keep_ids):
                            column.append(value)
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Fill:
    """``times`` windows that each hold the lengths of ``counts`` as often as it says."""

    counts: dict[int, int]
    times: int


def _closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of the available lengths whose sum comes closest to ``room`` from below."""
    reach, within = 1, (1 << (room + 1)) - 1
    steps = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & within
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[Fill]:
    """Fills that use up a histogram of lengths, each window as full as possible."""
    counts = {length: n for length, n in histogram.items() if n}
    if any(length > window for length in counts):
        raise ValueError("A piece is longer than the window")
    fills = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        chosen = _closest({k: v for k, v in rest.items() if v}, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in chosen.items())
        fills.append(Fill(chosen, times))
        for length, n in chosen.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return fills


def _numbered(pieces: DataFrame, total: int) -> DataFrame:
    """Number the pieces of each length from 0, without gaps.

    Pieces of one length are spread over buckets by a hash, numbered there, and
    shifted by the sizes of the buckets before, so a common length is never in
    one task.
    """
    buckets = LEAST_BUCKETS + total // NUMBERED_ROWS
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        spread.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = spread.withColumn("number", F.row_number().over(own) - 1)
    return ranked.join(shift, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("shift")).drop("bucket", "shift")


def place_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of a table of pieces.

    Pieces keep all their columns but clashing ``sequence_id`` and ``offset``.
    Rows that are equal are different pieces. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    fills = plan_windows(histogram, window)
    # Runs of numbers of one length: where they begin and how they map to windows.
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for fill in fills:
        offset = 0
        for length, n in sorted(fill.counts.items(), reverse=True):
            first = used.get(length, 0)
            runs.append((length, first, n, sequence, offset))
            used[length] = first + n * fill.times
            offset += length * n
        sequence += fill.times
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    bases = np.flatnonzero(np.diff(table[:, 0], prepend=-1) != 0)

    numbered = _numbered(pieces, sum(histogram.values()))
    schema = numbered.drop("number").schema.add("sequence_id", LongType()).add("offset", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = table[bases, 0]
        for batch in batches:
            length, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            # Runs of a length lie together, sorted by first number.
            of_length = np.searchsorted(lengths, length)
            low, high = bases[of_length], np.append(bases, len(table))[of_length + 1]
            while (high - low > 1).any():
                middle = (low + high) // 2
                right = (table[np.minimum(middle, len(table) - 1), 1] <= number) & (high - low > 1)
                low, high = np.where(right, middle, low), np.where(right | (high - low <= 1), high, middle)
            each, since = table[low, 2], number - table[low, 1]
            columns = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array(table[low, 3] + since // each),
                    pa.array(table[low, 4] + since % each * length),
                ],
                schema.names,
            )

    return numbered.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed windows themselves, from placed pieces that kept their ids."""
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Where every piece of every document goes.

    Sequences hold at most 2048 ids; a sequence that is not full is padded by its
    reader, unless its length is a power of two. Repeated doc_ids are separate
    documents.
    """
    return place_pieces(stored(token_pieces(docs, tokenizer_path), "pieces"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))
