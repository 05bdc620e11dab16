"""Encode texts by their distinct chunks between spaces and line ends.

Words repeat, so a text is cut before its spaces and line ends, each distinct
chunk is encoded once, and token ids are gathered for whole blocks. A cut is safe
unless the chunk before it ends in white space (or is empty): a run of white
space may then be one token. Such texts are encoded whole. The table of known
chunks is emptied when it exceeds a limit, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import blocks

KNOWN_CHUNKS = 300_000
BLOCKS_TOGETHER = 6

# Texts to (flat ids, offsets).
Encode = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]


class Index(dict):
    """Numbers keys in the order they first appear, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def gather(flat: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the wanted runs of ``flat``; returns values and the end of each run."""
    starts = offsets[wanted]
    counts = offsets[wanted + 1] - starts
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts - ends + counts, counts)
    return flat[at], ends


class ChunkEncoder:
    def __init__(self, encode: Encode, known: int = KNOWN_CHUNKS, forget: Callable[[], None] | None = None):
        self.encode, self.known, self.forget = encode, known, forget
        self._clear()

    def release(self) -> None:
        """Forget all chunks at the end of a task, so that an idle worker holds no memory."""
        self._clear()
        if self.forget:
            self.forget()

    def _clear(self) -> None:
        self.index = Index()
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.open = np.zeros(0, bool)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        # A key that opens its text starts with a mark no text can hold; one that
        # starts with a line end had no space before it.
        texts = [c[1:] if c[:1] == "\ud800" else c if c[:1] == "\n" else " " + c for c in new]
        flat, offsets = self.encode(texts)
        self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        self.flat = np.concatenate([self.flat, flat])
        self.open = np.concatenate([self.open, np.array([t[-1:].isspace() or not t for t in texts], bool)])

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, and the end of each text's chunks."""
        chunks: list[str] = []
        ends = []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ")
            parts[0] = "\ud800" + parts[0]
            chunks += parts
            ends.append(len(chunks))
        numbers = np.fromiter(map(self.index.__getitem__, chunks), np.int32, len(chunks))
        return numbers, np.array(ends, np.int64)

    def _ids(self, block: tuple, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, bounds = gather(self.flat, self.offsets, numbers)
        offsets = np.concatenate([[0], bounds[ends - 1]])
        loose = self.open[numbers]
        loose[ends - 1] = False  # nothing is cut after the last chunk
        whole = np.flatnonzero(np.add.reduceat(loose, np.concatenate([[0], ends[:-1]])))
        if len(whole):
            texts = texts_of(*block)
            again, again_offsets = self.encode([texts[i] for i in whole])
            runs = [flat[offsets[i] : offsets[i + 1]] for i in range(len(ends))]
            for k, i in enumerate(whole):
                runs[i] = again[again_offsets[k] : again_offsets[k + 1]]
            flat = np.concatenate(runs)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        return flat, offsets

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, flat int32 ids, offsets) for every block of a text column.

        New chunks of a few blocks are encoded together.
        """
        found: list[tuple] = []
        for block in blocks(column):
            if len(found) == BLOCKS_TOGETHER:
                yield from self._finish(found)
                found = []
            if not found and len(self.index) > self.known:
                self._clear()
            found.append((*block, *self._numbers(texts_of(*block[2:]))))
        yield from self._finish(found)

    def _finish(self, found: list[tuple]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        self._learn()
        for start, end, data, offsets, numbers, ends in found:
            yield start, end, *self._ids((data, offsets), numbers, ends)


class DistinctChunkEncoder(ChunkEncoder):
    """Looks up each distinct chunk of a few blocks once. Takes less time and more memory,
    which replaying merges (``bpe``) has no room for."""

    def _numbers_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, and the end of each text's chunks.

        Arrow cuts the texts and finds the distinct chunks, so that each is looked up once.
        """
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        at, ends, chunks = bounds[:-1], bounds[1:], lists.values
        first = np.zeros(len(chunks), bool)
        first[at] = True
        coded = pc.if_else(pa.array(first), pa.scalar(None, chunks.type), chunks).dictionary_encode()
        distinct = coded.dictionary
        # No chunk holds a space, so one text of all is cut again.
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(" ", distinct.type))[0].as_py()
        keys = text.split(" ") if len(distinct) else []
        known = np.fromiter(map(self.index.__getitem__, keys), np.int32, len(keys))
        numbers = np.empty(len(chunks), np.int32)
        numbers[~first] = known[coded.indices.drop_null().to_numpy()]
        numbers[at] = [self.index["\ud800" + c] for c in chunks.take(pa.array(at)).to_pylist()]
        return numbers, ends

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, flat int32 ids, offsets) for every block of a text column.

        Chunks of a few blocks are looked up, and new ones encoded, together.
        """
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        found: list[tuple] = []
        for block in blocks(column):
            if len(found) == BLOCKS_TOGETHER:
                yield from self._finish_of(column, found)
                found = []
            found.append(block)
        if found:
            yield from self._finish_of(column, found)

    def _finish_of(self, column: pa.Array, found: list[tuple]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        if len(self.index) > self.known:
            self._clear()
        top = found[0][0]
        numbers, ends = self._numbers_of(column.slice(top, found[-1][1] - top))
        self._learn()
        bounds = np.concatenate([[0], ends])
        for start, end, *block in found:
            low, high = bounds[start - top], bounds[end - top]
            yield start, end, *self._ids(block, numbers[low:high], ends[start - top : end - top] - low)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    bounds = offsets.tolist()
    return [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])]
