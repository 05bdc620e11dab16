"""Byte-level BPE by merge replay over a whole block's distinct words.

All distinct words of a block lie in one array of symbols with links to their
neighbours. An inverted index leads from a rank to the positions of the pairs
that merge into it. The smallest rank left is taken each time, all its
occurrences in all words are merged at once, and only the pairs next to them are
looked up again. Words don't touch each other, so each sees its own merges in
rank order.

A merge may create a pair of a smaller rank while the same word has further
occurrences of the present one. Those words are then replayed one merge at a
time, which is what rank order means for a single word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .chunks import ChunkEncoder, gather
from .words import joined

RANKS = "byte_bpe_multi_50k.tiktoken"

DECODED_ROWS = 256

_NONE = np.int64(1 << 40)
_SHIFT = 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) }


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank each pair merges into, or a number above all ranks."""
        keys = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def one_word(self, word: bytes) -> list[int]:
        """Merge the leftmost pair of the smallest rank until none is left."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            ranks = [self.pairs.get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best]
        return ids

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and their offsets."""
        data, bounds = joined(words)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word_of = np.repeat(np.arange(len(words)), np.diff(bounds))
        symbol = np.append(self.byte_ids[data], 0)
        alive = np.ones(n, bool)
        # Position n stands for "no neighbour".
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        last = np.flatnonzero(np.diff(word_of, append=-1) != 0)
        first = np.flatnonzero(np.diff(word_of, prepend=-1) != 0)
        after[last], before[first] = n, n
        rank = np.full(n + 1, _NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.rank_of(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        odd: set[int] = set()

        def enter(positions: np.ndarray) -> None:
            found = rank[positions]
            positions, found = positions[found != _NONE], found[found != _NONE]
            if not len(positions):
                return
            order = found.argsort(kind="stable")
            positions, found = positions[order], found[order]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
            for r, a, b in zip(found[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(waiting, r)
                index[r].append(positions[a:b])

        enter(inner)
        while waiting:
            r = heapq.heappop(waiting)
            parts = index.pop(r)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
            at = _leftmost(at, after)
            right = after[at]
            beyond = after[right]
            symbol[at] = r
            alive[right] = False
            rank[right] = _NONE
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            left = before[at]
            touched = np.concatenate([at, left[left < n]])
            follower = after[touched]
            rank[touched] = np.where(follower < n, self.rank_of(symbol[touched], symbol[follower]), _NONE)
            low = touched[rank[touched] < r]
            if len(low):
                odd.update(word_of[low].tolist())
            enter(touched)
        ids, offsets = symbol[:n][alive], np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word_of[alive], minlength=len(words)), out=offsets[1:])
        if odd:
            runs = [ids[offsets[i] : offsets[i + 1]] for i in range(len(words))]
            for i in odd:
                runs[i] = np.array(self.one_word(words[i]), np.int64)
            ids, offsets = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])
        return ids.astype(np.int32), offsets


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs keep the leftmost: every other one of each chain."""
    linked = np.zeros(len(at), bool)
    linked[1:] = after[at[:-1]] == at[1:]
    if not linked.any():
        return at
    run_start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - run_start) % 2 == 0]


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str) -> ChunkEncoder:
    """Encoder for a rank file's content; kept by the worker between tasks."""
    find, replay = regex.compile(pattern).findall, MergeReplay(read_ranks(raw))

    def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers: dict[str, int] = {}
        pieces: list[int] = []
        ends = [0]
        for text in texts:
            pieces += [numbers.setdefault(p, len(numbers)) for p in find(text)]
            ends.append(len(pieces))
        flat, offsets = replay([p.encode() for p in numbers])
        values, bounds = gather(flat, offsets, np.array(pieces, np.int64))
        return values, np.concatenate([[0], bounds])[ends].astype(np.int64)

    return ChunkEncoder(encode)


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in id order, and their offsets. Ids without a token are empty."""
    ranks = read_ranks(raw)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return joined(tokens)


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema if f.name != name] + [StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the token ids of a text column; no shuffle.

    The driver reads the rank file, whose size does not depend on the data, and
    sends it to the executors. Null and empty texts get an empty list. A column
    that already has the new name is replaced; equal texts get equal ids.
    """
    schema = _with(df, name, ArrayType(IntegerType(), False))
    with open(ranks_path, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(sent.value, pattern)
        for batch in batches:
            for start, end, flat, ends in to_ids(batch.column(text)):
                part = batch.slice(start, end - start)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                columns = [part.column(f.name) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, lists], [f.name for f in schema])
        to_ids.release()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the bytes that a column of token ids stands for; null counts as no ids."""
    schema = _with(df, name, BinaryType())
    with open(ranks_path, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, offsets = vocabulary(sent.value)
        for batch in (b.slice(at, DECODED_ROWS) for b in batches for at in range(0, b.num_rows, DECODED_ROWS)):
            lists = batch.column(ids)
            values = []
            for i in range(len(lists)):
                numbers = lists[i].values
                values.append(gather(data, offsets, numbers.to_numpy())[0].tobytes() if numbers is not None else b"")
            columns = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], [f.name for f in schema])

    return df.mapInArrow(run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path).drop("text")
    return decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
