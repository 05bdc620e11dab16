"""Words and their hashes over whole Arrow batches, in numpy.

A word is a run of bytes other than space and 0x09-0x0D. A batch is worked
through in blocks of a few megabytes, so memory follows the block size or the
longest single text, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 4096

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Longer spans are hashed by the library.
LONG_SPAN = 4096


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into (first row, end row, bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, len(column))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a list of texts."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of every span of bytes: eight bytes at a time, mixed into what came before.

    Each step is a bijection of what it mixes in, so there are no families of equal
    hashes as a polynomial has them. Very long spans are hashed one by one. Another
    ``salt`` gives another hash.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _STEP + (_BASE ^ np.uint64(salt)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(sizes <= LONG_SPAN)
    at, left = starts[live], sizes[live]
    while len(live):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] ^ (lane * _STEP))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), salt)
    return out


class Words:
    """Word spans of a block: ``start``, ``end``, and ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~space[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive values from each position, text borders ignored."""
    n = max(0, len(hashes) - size + 1)
    total = hashes[:n].copy()
    for j in range(1, size):
        total *= _STEP
        total += hashes[j : n + j]
    return mix(total + np.uint64(size))


def window_starts(words: Words, size: int) -> np.ndarray:
    """Positions where a whole window lies in one text."""
    text = words.text_of()
    n = max(0, len(text) - size + 1)
    return np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every window of ``size`` words.

    A text with fewer words has one shingle, its whole word sequence; a text
    without words has none.
    """
    hashes, text = words.hashes(), words.text_of()
    at = window_starts(words, size)
    texts, values = [text[at]], [window_hashes(hashes, size)[at]]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    for count in np.unique(words.count[short]):
        some = short[words.count[short] == count]
        total = hashes[words.first[some]].copy()
        for j in range(1, count):
            total = total * _STEP + hashes[words.first[some] + j]
        texts.append(some)
        values.append(mix(total + np.uint64(count)))
    return np.concatenate(texts), np.concatenate(values)
