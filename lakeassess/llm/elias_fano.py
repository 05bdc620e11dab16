"""Token id files whose document boundaries are Elias-Fano coded.

A file holds consecutive documents in ascending doc_id: their ids one after the
other, and two rising sequences, the ends of the documents and their doc_ids. A
rising sequence keeps the low bits of each number as they are and the high bits
in unary, about two bits more per number than the least possible; every 64th
set bit's place lets ``select`` find any number without reading those before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .store import partitions, range_bounds, range_of, shared_path, stored
from .tokens import encoder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
FILE_IDS = 4_000_000
SAMPLED = 64

# Fixed values of the file format: mark; range, ids before in the range, documents,
# ids, documents without doc_id, lowest doc_id, bytes per id.
MARK = b"EFTOKEN1"
_HEADER = struct.Struct("<iqqqqqi")
_LENGTHS = struct.Struct("<qqqqi")


class EliasFano:
    """A sequence of rising numbers, readable at any place."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.places = count, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, int(values[-1] + np.uint64(1)) // n).bit_length() - 1
        low_bits = max(0, low_bits)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts[None, :] & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLED].astype(np.uint32))

    def _low(self, i: int) -> int:
        first, bits = i * self.low_bits, self.low_bits
        raw = int.from_bytes(self.low[first // 8 : (first + bits + 7) // 8].tobytes(), "little")
        return (raw >> (first % 8)) & ((1 << bits) - 1)

    def select(self, i: int) -> int:
        """Number ``i``: from the place of a set bit before, count on to its own."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.places[i // SAMPLED]), i % SAMPLED
        byte = place // 8
        value = int(self.high[byte]) >> (place % 8) << (place % 8)
        while left >= value.bit_count():
            left -= value.bit_count()
            byte += 1
            value = int(self.high[byte])
        for _ in range(left):
            value &= value - 1
        one = byte * 8 + (value & -value).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All numbers, as int64."""
        if not self.count:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)) << self.low_bits
        bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
        return high + bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def to_bytes(self) -> bytes:
        head = _LENGTHS.pack(self.count, len(self.low), len(self.high), len(self.places), self.low_bits)
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        count, low, high, places, low_bits = _LENGTHS.unpack_from(raw, at)
        at += _LENGTHS.size
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (places, "<u4")):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(count, low_bits, *parts), at


@dataclass(frozen=True)
class TokenFile:
    """One file: range of documents, ids before it in that range, ids, boundaries, doc_ids."""

    part: int
    before: int
    ids: np.ndarray
    ends: EliasFano
    nameless: int
    lowest: int
    names: EliasFano

    @classmethod
    def of(cls, part: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> TokenFile:
        """Documents sorted by doc_id, those without first."""
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        lowest = int(known[0]) if len(known) else 0
        names = EliasFano.of((known - lowest).view(np.uint64))
        return cls(part, before, ids, EliasFano.of(np.cumsum(lengths)), len(doc_ids) - len(known), lowest, names)

    def to_bytes(self) -> bytes:
        width = 2 if not len(self.ids) or int(self.ids.max()) < 1 << 16 else 4
        head = _HEADER.pack(self.part, self.before, self.ends.count, len(self.ids), self.nameless, self.lowest, width)
        return MARK + head + self.ends.to_bytes() + self.names.to_bytes() + self.ids.astype(f"<u{width}").tobytes()

    @classmethod
    def from_bytes(cls, content: bytes) -> TokenFile:
        raw = memoryview(content)
        if bytes(raw[: len(MARK)]) != MARK:
            raise ValueError("Not a token file")
        part, before, _, count, nameless, lowest, width = _HEADER.unpack_from(raw, len(MARK))
        ends, at = EliasFano.from_bytes(raw, len(MARK) + _HEADER.size)
        names, at = EliasFano.from_bytes(raw, at)
        return cls(part, before, np.frombuffer(raw, f"<u{width}", count, at), ends, nameless, lowest, names)

    def __len__(self) -> int:
        return self.ends.count

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + (self.names.values() + self.lowest).tolist()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encode texts and write token files under ``path``, documents in ascending doc_id.

    Texts are encoded where they are read; their ids, two bytes each where the
    vocabulary allows, are dealt to ranges of doc_id and sorted there. A range becomes one
    or more files of about ``file_ids`` ids, a longer document one of its own.
    Null and empty texts have the end id alone. Null doc_ids come first; rows of
    one doc_id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = range_bounds(rows, "doc_id", partitions(spark))
    rows = rows.withColumns({"part": range_of(F.col("doc_id"), bounds), "tie": F.xxhash64("text")})
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    sent = spark.sparkContext.broadcast(definition)  # as large as the vocabulary
    width = "<u2" if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(sent.value)
        for batch in batches:
            for first, end, flat, offsets in to_ids(batch.column("text")):
                flat = flat.astype(width)
                raw = [flat[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                part = batch.slice(first, end - first)
                columns = [part.column(n) for n in ("doc_id", "part", "tie")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())], ["doc_id", "part", "tie", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, size, part = 0, 0, None
        held: tuple[list, list, list] = ([], [], [])

        def file() -> pa.RecordBatch:
            ids = np.concatenate(held[2])
            raw = TokenFile.of(part, before, held[0], held[1], ids).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                part = batch.column("part")[0].as_py()
                ids = np.append(np.frombuffer(raw.as_buffer(), width), np.array([end_id], width))
                held[0].append(doc_id)
                held[1].append(len(ids))
                held[2].append(ids)
                size += len(ids)
                if size >= file_ids:
                    yield file()
                    before, size, held = before + size, 0, ([], [], [])
        if held[0]:
            yield file()

    files = (
        rows.mapInArrow(encode, "doc_id bigint, part int, tie bigint, ids binary")
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
        .mapInArrow(run, "value binary")
    )
    # The sink puts the separator behind the row, so the file ends with one zero byte.
    values = files.select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with ``ids`` the ids themselves."""
    schema = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile.from_bytes(content.as_py())
                ends = np.fromiter((file.ends.select(i) for i in range(len(file))), np.int64, len(file))
                starts = np.concatenate([[0], ends[:-1]])
                own = [file.ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [
                    pa.array(np.full(len(file), file.part, np.int32)),
                    pa.array(file.doc_ids(), pa.int64()),
                    pa.array(starts + file.before),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = stored(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema), "token-rows")
    # One total per range, so at most as many as shuffle partitions.
    totals = {r[0]: r[1] for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect()}
    before, base = 0, []
    for part in range(max(totals, default=-1) + 1):
        base.append(before)
        before += totals.get(part, 0)
    if not base:
        return rows.drop("part")
    bases = F.expr("array(" + ",".join(f"{b}L" for b in base) + ")")
    return rows.withColumn("start", F.col("start") + F.element_at(bases, F.col("part") + 1)).drop("part")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path)
