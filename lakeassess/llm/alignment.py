"""Align the tokens of two tokenizers, and count which ids end together.

Spans given by the libraries are coarse cuts: the tokenizers library tells the
characters of each token, sentencepiece's protocol message the bytes (the
installed release names it ``proto`` and has retired ``immutable_proto``). Tokens
that share a character, and bytes standing for themselves, are refined with the
bytes their ids decode to. A text whose bytes either side does not give back has
no tokens.

Chunks of text repeat, so each is aligned once (``chunks.py`` says where a text
may be cut). Documents are worked through in blocks: a block lists its id pairs
once, with their number, and keeps each document as a row of chunk numbers. Pairs
are then counted over the corpus, and the counts go back to the blocks, not to
every occurrence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Index, gather, texts_of
from .store import stored
from .words import blocks

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
#: Text of a block of documents, in bytes; a longer document is a block.
BLOCK_TEXT = 8 << 20
#: Chunks and links known at most before a worker starts anew.
KNOWN = 400_000
KNOWN_LINKS = 4_000_000
CHUNKS_PER_CALL = 2000
#: Signs cut off a word.
SIGNS = ".,!#*$%&"
#: Marks no text can hold: a part that follows a letter, and a text taken whole.
_SIGNED, _WHOLE = "\ud801", "\ud800"
#: Stands in front of parts that are encoded together.
_CARRIER = " a"
_ID_BITS = 24


def _byte_alphabet() -> dict[str, int]:
    """Byte of every character of the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _First:
    """The tokenizers library: ids, byte ends by character offsets."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        vocabulary = self.tokenizer.get_vocab()
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            known = [alphabet.get(c) for c in entry]
            self.entries[i] = entry.encode() if None in known else bytes(known)
        self.sizes = np.array([len(e) for e in self.entries], np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the byte behind each token."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        width = 1 + (letters > 0x7F).astype(np.int64) + (letters > 0x7FF) + (letters > 0xFFFF)
        coarse = np.concatenate([[0], np.cumsum(width)])[offsets[:, 1]]
        # Tokens that share a character with the one before or behind are told by their bytes.
        shared = np.zeros(len(ids), bool)
        touch = offsets[1:, 0] < offsets[:-1, 1]
        shared[1:] |= touch
        shared[:-1] |= touch
        return ids, np.where(shared, np.cumsum(self.sizes[ids]), coarse)


class _Second:
    """sentencepiece: ids, byte ends by the protocol message's spans."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.fallback = np.array([bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) for p in pieces])
        self.entries = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, self.fallback)]
        self.sizes = np.array([len(e) for e in self.entries], np.int64)
        #: A text may be encoded in parts if no piece reaches over their borders.
        borders = ((x, y) for p in pieces for x, y in zip(p, p[1:]))
        self.cuts = not any(y == "▁" != x or y in SIGNS and x.isalpha() for x, y in borders) and "\n" not in "".join(pieces)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``_First.spans``, for a text that starts with the space this library adds."""
        pieces = self.processor.encode(text[1:], return_type="proto", num_threads=1).pieces
        ids = np.fromiter((p.id for p in pieces), np.int64, len(pieces))
        coarse = np.fromiter((p.end for p in pieces), np.int64, len(pieces)) + 1
        # Byte pieces share a character; its span is told for the last of them only.
        return ids, np.where(self.fallback[ids], np.cumsum(self.sizes[ids]), coarse)


def _joined(entries: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(entries.__getitem__, ids.tolist()))


def _runs(ids: np.ndarray, last: np.ndarray) -> list[str]:
    """Ids between consecutive places, joined by commas."""
    names, ends = list(map(str, ids.tolist())), (last + 1).tolist()
    return [names[x] if y - x == 1 else ",".join(names[x:y]) for x, y in zip([0, *ends], ends)]


class Aligner:
    """Aligns whole blocks of texts through a table of known parts, kept by a worker.

    A text is cut into chunks, and a chunk into parts: a word, and the signs behind
    it. Neither tokenizer joins a letter to a sign, which is looked up in the
    vocabulary. Many parts are encoded as one text, so long as a cut lies between
    any two; where one does not, or the bytes differ, they are taken in halves.
    """

    def __init__(self, first: _First, second: _Second):
        self.first, self.second = first, second
        self.clear()

    def clear(self) -> None:
        self.chunks, self.parts = Index(), Index()
        self.of_chunk, self.chunk_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.loose = np.zeros(0, bool)
        self.pairs: dict[int, int] = {}
        self.codes: list[int] = []
        self.groups: list[str] = []
        self.good, self.counts = np.zeros(0, bool), np.zeros((0, 3), np.int64)
        self.links, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.chunks) > KNOWN or self.ends[-1] > KNOWN_LINKS

    def _together(self, texts: list[str], real: list[bool]) -> tuple | None:
        """(good, counts, groups, codes) of the real ones of neighbouring texts, or None."""
        text = "".join(texts)
        raw = text.encode()
        (a, ends_a), (b, ends_b) = self.first.spans(text), self.second.spans(text)
        if _joined(self.first.entries, a) != raw or _joined(self.second.entries, b) != raw:
            return None
        bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
        cuts, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        of_text = np.searchsorted(cuts, bounds, side="right")
        if not np.array_equal(cuts[of_text[1:] - 1], bounds[1:]):
            return None
        counts = np.stack([np.diff(np.searchsorted(e, bounds, side="right")) for e in (ends_a, ends_b, cuts)], axis=1)
        groups = [f"{x}|{y}" for x, y in zip(_runs(a, at_a), _runs(b, at_b))]
        groups = [";".join(groups[x:y]) for x, y, r in zip(of_text.tolist(), of_text[1:].tolist(), real) if r]
        kept = np.array(real)
        codes = ((a[at_a] << _ID_BITS) | b[at_b])[np.repeat(kept, counts[:, 2])]
        return np.ones(len(groups), bool), counts[kept], groups, codes

    def _aligned(self, parts: list[str]) -> list[tuple]:
        """Results of ``_together`` that cover all parts."""
        texts, real = [_CARRIER], [False]
        for part in parts:
            if part[0] == _SIGNED:
                texts += (_CARRIER, part[1:])
                real += (False, True)
            else:
                texts.append(part)
                real.append(True)
        found = self._together(texts, real)
        if found:
            return [found]
        if len(parts) == 1:
            found = self._together(parts, [True]) if parts[0][0] == " " else None
            return [found or (np.zeros(1, bool), np.zeros((1, 3), np.int64), [""], np.zeros(0, np.int64))]
        half = len(parts) // 2
        return self._aligned(parts[:half]) + self._aligned(parts[half:])

    def _add(self, parts: list[str], alone: bool = False) -> None:
        if alone:
            found = [self._together(parts, [True]) or (np.zeros(1, bool), np.zeros((1, 3), np.int64), [""], np.zeros(0, np.int64))]
        else:
            found = self._aligned(parts)
        good, counts, groups, codes = zip(*found)
        pairs, codes = self.pairs, np.concatenate(codes).tolist()
        for code in codes:
            if code not in pairs:
                pairs[code] = len(pairs)
                self.codes.append(code)
        links = np.fromiter(map(pairs.__getitem__, codes), np.int32, len(codes))
        counts = np.concatenate(counts)
        self.links = np.concatenate([self.links, links])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts[:, 2])])
        self.counts = np.concatenate([self.counts, counts])
        self.good = np.concatenate([self.good, *good])
        for own in groups:
            self.groups += own

    def _learn(self) -> None:
        """Cut new chunks into parts and align the new ones of these."""
        new, self.chunks.new = self.chunks.new, []
        if not new:
            return
        names, sizes = [], []
        for chunk in new:
            word = chunk.rstrip(SIGNS)
            if word is not chunk and word[-1:].isalpha():
                names += (word, _SIGNED + chunk[len(word) :])
                sizes.append(2)
            else:
                names.append(chunk)
                sizes.append(1)
        numbers = np.fromiter(map(self.parts.__getitem__, names), np.int64, len(names))
        self.of_chunk = np.concatenate([self.of_chunk, numbers])
        self.chunk_ends = np.concatenate([self.chunk_ends, self.chunk_ends[-1] + np.cumsum(sizes)])
        self.loose = np.concatenate([self.loose, np.array([not c or c[-1].isspace() for c in new], bool)])
        parts, self.parts.new = self.parts.new, []
        texts = [p if p[:1] in ("\n", _SIGNED) else " " + p for p in parts]
        # One that ends in white space, or holds the sign for it, is taken alone.
        odd = [p[-1:].isspace() or "▁" in p for p in texts]
        at = 0
        while at < len(texts):
            end = at + 1
            while not odd[at] and end < min(len(texts), at + CHUNKS_PER_CALL) and not odd[end]:
                end += 1
            self._add(texts[at:end])
            at = end

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Part numbers of each text; none for an empty one or one whose bytes don't come back.

        The table is emptied first if it is full.
        """
        if self.full():
            self.clear()
        chunks: list[str] = []
        ends = []
        for text in texts:
            if text:
                chunks += text.replace("\n", " \n").split(" ") if self.second.cuts else [text]
            ends.append(len(chunks))
        numbers = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        self._learn()
        flat, part_ends = gather(self.of_chunk, self.chunk_ends, numbers)
        part_ends = np.concatenate([[0], part_ends])
        loose, bad = self.loose[numbers], ~self.good[flat]
        runs = []
        for text, x, y in zip(texts, [0, *ends], ends):
            own = slice(part_ends[x], part_ends[y])
            # White space at a border may be one token with what follows.
            if x < y and (loose[x : y - 1].any() or text[0] == "\n" or text[-1] == " "):
                number = self.parts[_WHOLE + text]
                if self.parts.new:
                    self.parts.new = []
                    self._add([" " + text], alone=True)
                runs.append(np.array([number] if self.good[number] else [], np.int64))
            else:
                runs.append(flat[own] if not bad[own].any() else flat[:0])
        return runs


@lru_cache(maxsize=1)
def aligner(definition: str, model: bytes) -> Aligner:
    return Aligner(_First(definition), _Second(model))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = (
    "block bigint, kind int, at int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
    " groups_sha256 string, seq binary, codes array<bigint>, counts array<bigint>, links binary, ends binary"
)
_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_KIND_COUNTS, _KIND_TABLE, _KIND_DOCUMENT = range(3)


def _schema(fields: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (p.split() for p in fields.split(","))])


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in two or four bytes each, said by the first byte."""
    width = 2 if not len(numbers) or int(numbers.max()) < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _block_rows(own: Aligner, block: int, doc_ids: list, runs: list[np.ndarray]) -> pa.RecordBatch:
    """One row with the block's pairs and chunks, and a row per document."""
    lengths = np.array([len(r) for r in runs])
    flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    chunks, seq, times = np.unique(flat, return_inverse=True, return_counts=True)
    links, ends = gather(own.links, own.ends, chunks)
    pairs, links = np.unique(links, return_inverse=True)
    counts = np.bincount(links, np.repeat(times, np.diff(np.concatenate([[0], ends]))), len(pairs)).astype(np.int64) if len(links) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    totals = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(own.counts[flat], axis=0)])
    per_doc = np.diff(totals[bounds], axis=0)
    rows = [{"block": block, "kind": _KIND_TABLE, "codes": [own.codes[p] for p in pairs], "counts": counts.tolist(), "links": _narrow(links), "ends": ends.astype("<i8").tobytes()}]
    groups = own.groups
    for i, doc_id in enumerate(doc_ids):
        a, b, n = per_doc[i].tolist()
        digest = hashlib.sha256(";".join(map(groups.__getitem__, runs[i].tolist())).encode()).hexdigest() if lengths[i] else ""
        rows.append({"block": block, "kind": _KIND_DOCUMENT, "doc_id": doc_id, "n_a": a, "n_b": b, "n_groups": n, "n_links": n, "groups_sha256": digest, "seq": _narrow(seq[bounds[i] : bounds[i + 1]])})
    return pa.RecordBatch.from_pylist(rows, _schema(_BLOCK))


def align_blocks(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """Aligned blocks of (doc_id, text)."""
    with open(first_path, encoding="utf-8") as file, open(second_path, "rb") as other:
        sent = docs.sparkSession.sparkContext.broadcast((file.read(), other.read()))  # as large as the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sent.value)
        number, size, ids, runs = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for start, end, data, offsets in blocks(batch.column("text")):
                if runs and (size + len(data) > BLOCK_TEXT or own.full()):
                    yield _block_rows(own, number, ids, runs)
                    number, size, ids, runs = number + 1, 0, [], []
                # The table is emptied between blocks only, when nothing points into it.
                runs += own.numbers(texts_of(data, offsets))
                ids += doc_ids[start:end]
                size += len(data)
        if runs:
            yield _block_rows(own, number, ids, runs)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCK)


def pair_counts(blocks_: DataFrame) -> DataFrame:
    """(code, total, best): links of every id pair over the corpus, and whether no
    other pair of its second id has more."""
    each = blocks_.where(F.col("kind") == _KIND_TABLE).select(F.explode(F.arrays_zip("codes", "counts")).alias("p"))
    totals = each.groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.counts").alias("total"))
    # A second id has at most as many partners as the first vocabulary has ids.
    second = Window.partitionBy(F.col("code").bitwiseAND(F.lit((1 << _ID_BITS) - 1)))
    return totals.select("code", "total", (F.col("total") == F.max("total").over(second)).alias("best"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block come as counts by place, its table, its documents."""
    totals: list[np.ndarray] = []
    bests: list[np.ndarray] = []
    sums = best_links = np.zeros(0, np.int64)
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            part = batch.slice(x, y - x)
            if kinds[x] == _KIND_COUNTS:
                totals.append(part.column("total").to_numpy())
                bests.append(part.column("best").to_numpy(zero_copy_only=False))
            elif kinds[x] == _KIND_TABLE:
                for i in range(part.num_rows):  # several, where blocks have no links
                    links, ends = _wide(part.column("links")[i].as_py()), np.frombuffer(part.column("ends")[i].as_py(), "<i8")
                    edges = np.concatenate([[0], ends])
                    values = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (totals, bests)]
                    sums, best_links = (np.diff(np.concatenate([[0], np.cumsum(v[links])])[edges]) for v in values)
                    totals, bests = [], []
            else:
                runs = [_wide(raw.as_py()) for raw in part.column("seq")]
                found = [pa.array([int(v[r].sum()) for r in runs], pa.int64()) for v in (best_links, sums)]
                columns = [part.column(n) for n in ("doc_id", *_COUNTS)] + found + [part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, schema=_schema(_ALIGNED))


def align(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose bytes either tokenizer does not give
    back, have no tokens: zeros, and an empty groups_sha256. Rows repeating a
    doc_id, or without one, each count. An empty table gives an empty result.
    """
    found = stored(align_blocks(docs, first_path, second_path), "aligned")
    counts = stored(pair_counts(found), "pairs")
    table = found.where(F.col("kind") == _KIND_TABLE)
    places = table.select("block", F.posexplode("codes").alias("at", "code"))
    back = places.join(counts, "code").select("block", F.lit(_KIND_COUNTS).alias("kind"), "at", "total", "best")
    rest = found.drop("codes", "counts").withColumn("at", F.lit(None).cast("int"))
    both = rest.unionByName(back, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(_summed, _ALIGNED)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path(FIRST), public_tokenizers.path(SECOND))
