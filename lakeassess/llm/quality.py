"""Quality rules: base counts, and a chain model that labels lines.

Every line with a word is content or boilerplate. A linear-chain conditional
random field scores each line by its shape and each pair of neighbours by their
labels; Viterbi decoding picks the best sequence of labels. A document stays if
enough of its words are in content lines.

The model is fitted here, by the likelihood of the labels, to a bounded sample of
documents labelled good or bad that pass the base rules, each line taking its
document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .words import Words, blocks, mix, span_hashes, window_hashes, window_starts

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
#: Share of a document's words that must be in content lines.
MIN_CONTENT = 0.5
#: Most labelled documents of each kind the model is fitted to.
SAMPLE_GOOD = 3000
SAMPLE_BAD = 1500

_STEPS = 250
_RATE = 0.1
_PENALTY = 1e-3
_CHAIN = 64  # longest chain in fitting; longer documents are cut into several


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_SHOUT = _table("!?")
_STOP = _table(".!?:;")
_PIPE = _table("|")

N_FEATURES = 12


@dataclass
class Lines:
    """Lines with a word: features, number of words, and first line of each text."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _seen_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which have any equal."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    earlier, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order], any_[order] = same[:-1], same[:-1] | same[1:]
    return earlier, any_


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], Lines]:
    """Base counts of every text of a block, and its lines."""
    words = Words(data, offsets)
    text, low, high = words.text_of(), offsets[:-1], offsets[1:]
    letters = np.zeros(len(data), bool)
    letters[:] = (data & 0xC0) != 0x80  # one per code point

    # Words in repeated windows.
    at = window_starts(words, REPEAT_WINDOW)
    keys = mix(window_hashes(words.hashes(), REPEAT_WINDOW)[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = at[_seen_before(keys)[1]]
    steps = np.zeros(len(text) + 1, np.int64)
    steps[again] += 1
    np.add.at(steps, again + REPEAT_WINDOW, -1)
    repeated = np.cumsum(steps[:-1]) > 0

    # Lines that have a word.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([low[high > low], breaks[breaks + 1 < len(data)] + 1]))
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A), ends - 1, ends) if len(starts) else ends
    line_word = np.searchsorted(words.start, np.append(starts, len(data)))
    n_words = np.diff(line_word)
    some = np.flatnonzero(n_words > 0)
    starts, ends, n_words = starts[some], ends[some], n_words[some]
    line_text = text[line_word[some]] if len(some) else np.zeros(0, np.int64)
    line_keys = span_hashes(data, starts, ends) + line_text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    duplicate, _ = _seen_before(mix(line_keys))

    counts = {
        "n_words": words.count.astype(np.int64),
        "word_chars": _sums(letters, words.start, words.end),
        "n_symbols": _sums(SYMBOLS[data], low, high),
        "n_dup_lines": np.bincount(line_text[duplicate], minlength=len(low)),
        "n_repeat_words": np.bincount(text[repeated], minlength=len(low)),
    }
    counts["word_chars"] = np.bincount(text, counts["word_chars"], minlength=len(low)).astype(np.int64)

    size = np.maximum(_sums(letters, starts, ends), 1)
    upper, lower = _sums(_UPPER[data], starts, ends), _sums(_LOWER[data], starts, ends)
    line_of_word = np.repeat(np.arange(len(some)), n_words)
    repeats = np.bincount(line_of_word, repeated, minlength=len(some)) if len(some) else np.zeros(0)
    last = data[np.maximum(ends - 1, 0)] if len(some) else np.zeros(0, np.uint8)
    symbols = _sums(SYMBOLS[data], starts, ends)
    features = np.stack(
        [
            np.ones(len(some)),
            n_words <= 3,
            n_words >= 20,
            np.minimum(symbols / size * 5, 1),
            np.minimum(symbols / np.maximum(n_words, 1), 1),
            upper / np.maximum(upper + lower, 1),
            np.minimum(_sums(_SHOUT[data], starts, ends) / np.maximum(n_words, 1), 1),
            np.minimum(_sums(_PIPE[data], starts, ends) / np.maximum(n_words, 1) * 2, 1),
            _sums(_DIGIT[data], starts, ends) / size,
            duplicate,
            repeats / np.maximum(n_words, 1),
            _STOP[last],
        ],
        axis=1,
    ).astype(np.float64)
    first = np.searchsorted(line_text, np.arange(len(low) + 1))
    return counts, Lines(features, n_words, first)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many in windows that repeat."""
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


@dataclass(frozen=True)
class LineModel:
    """Weights of a line's features for content, and of label pairs (from, to)."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2

    @property
    def parameters(self) -> np.ndarray:
        return np.concatenate([self.weights, self.moves.ravel()])


def viterbi(model: LineModel, lines: Lines) -> np.ndarray:
    """Best label of every line, 1 for content; content wins ties. All texts step together."""
    count = np.diff(lines.first)
    score = lines.features @ model.weights
    order = np.argsort(-count, kind="stable")
    count, first = count[order], lines.first[:-1][order]
    came = np.zeros((2, len(score)), bool)  # best label before, for either label
    best = np.zeros((2, len(count)))
    move, longest = model.moves, int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        k = active[t]
        at = first[:k] + t
        if t == 0:
            best[1, :k] = score[at]
            continue
        zero, one = best[0, :k].copy(), best[1, :k].copy()
        for label in (0, 1):
            a, b = zero + move[0, label], one + move[1, label]
            came[label, at] = b >= a
            best[label, :k] = np.maximum(a, b) + (score[at] if label else 0)
    labels = np.zeros(len(score), bool)
    now = best[1] >= best[0]
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        ongoing = count[:k] > t + 1
        before = np.where(now[:k], came[1, np.minimum(at + 1, len(score) - 1)], came[0, np.minimum(at + 1, len(score) - 1)])
        now[:k] = np.where(ongoing, before, now[:k])
        labels[at] = now[:k]
    return labels


def fit(chains: list[np.ndarray], labels: list[int]) -> LineModel | None:
    """Fit a model to line features of whole documents by gradient ascent; None without both labels."""
    if len(set(labels)) < 2:
        return None
    parts, marks = [], []
    for chain, label in zip(chains, labels):
        for k in range(0, len(chain), _CHAIN):
            parts.append(chain[k : k + _CHAIN])
            marks.append(label)
    order = np.argsort([-len(p) for p in parts], kind="stable")
    size = np.array([len(parts[i]) for i in order])
    y = np.array([marks[i] for i in order])
    longest = int(size[0])
    active = [int((size > t).sum()) for t in range(longest)]
    x = [np.stack([parts[i][t] for i in order[: active[t]]]) for t in range(longest)]
    # Both kinds of documents weigh the same.
    share = np.where(y == 1, 0.5 / (y * size).sum(), 0.5 / ((1 - y) * size).sum())
    w, m = np.zeros(N_FEATURES), np.zeros((2, 2))
    moment, square = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, _STEPS + 1):
        scores = [xt @ w for xt in x]
        forward = [np.stack([np.zeros(len(scores[0])), scores[0]])]
        for t in range(1, longest):
            f = forward[-1][:, : active[t]]
            nxt = np.stack([np.logaddexp(f[0] + m[0, j], f[1] + m[1, j]) for j in (0, 1)])
            nxt[1] += scores[t]
            forward.append(nxt)
        gw, gm = np.zeros(N_FEATURES), np.zeros((2, 2))
        back = np.zeros((2, len(y)))
        total = np.zeros(len(y))
        for t in range(longest):
            ends = np.flatnonzero(size[: active[t]] == t + 1)
            total[ends] = np.logaddexp(*forward[t][:, ends])
        for t in range(longest - 1, -1, -1):
            k = active[t]
            here = np.exp(forward[t][1] + back[1, :k] - total[:k])
            gw += ((y[:k] - here) * share[:k]) @ x[t]
            if t:
                into = back[:, :k].copy()
                into[1] += scores[t]
                for i in (0, 1):
                    for j in (0, 1):
                        pair = np.exp(forward[t - 1][i, :k] + m[i, j] + into[j] - total[:k])
                        gm[i, j] += (((y[:k] == i) & (i == j)) - pair) @ share[:k]
                back[:, :k] = np.stack([np.logaddexp(m[i, 0] + into[0], m[i, 1] + into[1]) for i in (0, 1)])
        gradient = np.concatenate([gw, gm.ravel()]) - _PENALTY * np.concatenate([w, m.ravel()])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        change = _RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-12)
        w, m = w + change[:N_FEATURES], m + change[N_FEATURES:].reshape(2, 2)
    return LineModel(w, m)


def fit_lines(docs: DataFrame, labels: DataFrame, good: int = SAMPLE_GOOD, bad: int = SAMPLE_BAD) -> LineModel | None:
    """Fit the model to at most ``good`` + ``bad`` labelled documents.

    They are chosen by a hash of doc_id. Of several labels of a document the
    lowest counts; other values than 0 and 1, and null, are no labels.
    """
    named = labels.where("quality in (0, 1) and doc_id is not null")
    each = named.groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = [
        row
        for label, n in ((1, good), (0, bad))
        for row in each.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    ]
    if not chosen:
        return None
    spark = docs.sparkSession
    few = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "__id bigint, label int")
    rows = docs.join(F.broadcast(few), docs["doc_id"] == few["__id"]).select("__id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                counts, lines = measure(data, offsets)
                bounds = pa.array(lines.first * N_FEATURES, pa.int32())
                values = pa.ListArray.from_arrays(bounds, pa.array(lines.features.ravel()))
                part = batch.slice(start, end - start)
                # The verdict only matters where the base rules pass.
                passed = pa.array(~base_failed(counts))
                found = pa.RecordBatch.from_arrays([part.column("__id"), part.column("label"), values], ["id", "label", "x"])
                yield found.filter(passed)

    found = rows.mapInArrow(run, "id bigint, label int, x array<double>").toArrow().sort_by([("id", "ascending")])
    chains, marks = [], []
    for label, x in zip(found["label"].to_pylist(), found["x"]):
        values = x.values.to_numpy().reshape(-1, N_FEATURES)
        if len(values):
            chains.append(values)
            marks.append(label)
    return fit(chains, marks)


ADDED = [
    *(StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    StructField("content_share", DoubleType()),
    StructField("base_failed", BooleanType()),
    StructField("kept", BooleanType()),
]


def judge(docs: DataFrame, model: LineModel | None, min_content: float = MIN_CONTENT) -> DataFrame:
    """Add base counts, content_share, base_failed and kept; no shuffle.

    Null and empty texts count as no words and fail. Without a model only the base
    rules reject. Columns with the new names are replaced; repeated rows get equal
    results.
    """
    added = [f.name for f in ADDED]
    docs = docs.drop(*added)
    names, schema = docs.columns, StructType([*docs.schema, *ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                counts, lines = measure(data, offsets)
                n = counts["n_words"]
                if model is None:
                    share = np.where(n > 0, 1.0, 0.0)
                else:
                    content = np.where(viterbi(model, lines), lines.words, 0)
                    share = _sums(content, lines.first[:-1], lines.first[1:]) / np.maximum(n, 1)
                failed = base_failed(counts)
                kept = ~failed & (share >= min_content)
                part = batch.slice(start, end - start)
                columns = [part.column(c) for c in names]
                columns += [pa.array(counts[c], pa.int64()) for c in added[:5]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(share), pa.array(failed), pa.array(kept)], schema.names)

    return docs.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit_lines(docs, labels)).drop("text")
