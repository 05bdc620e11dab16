"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positive examples; other text is unlabelled, a
mixture with a known share of toxic documents. The risk of a classifier is
estimated from both: the loss of positives, weighted by that share, and the loss
of the unlabelled as negatives less what positives contribute to it. Where that
difference falls below zero, which only overfitting explains, the step goes up
its gradient instead of down.

A document is the set of its words, lower-cased in ASCII, cut at signs. The words
whose share among positives differs most surely from that among the unlabelled
are the classifier's inputs.

All text that may be learned from is the unlabelled side, however much there is:
word shares are counted by Spark over every document, and documents that differ in
frequent words are dealt by hash into shards of bounded size. One classifier is
fitted to each shard and all positives; the model is the mean of them, weighted by
their documents. Only confirmed examples are bounded in number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .store import stored
from .words import Words, blocks

#: Most confirmed toxic documents the classifiers are fitted to.
SAMPLE_TOXIC = 4000
#: Unlabelled documents of one shard, about.
SHARD = 16_384
#: Inputs, and how sure the difference of a word's shares must be, in deviations.
MOST_WORDS = 512
LEAST_Z = 5.0
#: Least share of the documents of either kind that has the word.
LEAST_SHARE = 0.02

STEPS = 400
RATE = 0.05
PENALTY = 1e-4
DECIDES = 0.3

_CUTS = np.ones(256, bool)
_CUTS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = False
_CUTS[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word hash) of all words of a block, repeats included."""
    words = Words(_LOWER[data], offsets, _CUTS)
    return words.text_of(), words.hashes()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class WordModel:
    """Sorted word hashes, their weights, and the bias. Scores are probabilities."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.full(len(offsets) - 1, self.bias)
        if len(self.words):
            text, word = word_sets(data, offsets)
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == word)
            pairs = np.unique(text[hit] * len(self.words) + at[hit])
            np.add.at(sums, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return _sigmoid(sums)


def surest(p: np.ndarray, u: np.ndarray, n: int, m: int) -> np.ndarray:
    """Ascending positions of the words whose document shares, p of n positives and u of
    m unlabelled, differ most surely."""
    n, m = max(n, 1), max(m, 1)
    both = (p + u) / (n + m)
    z = np.abs(p / n - u / m) / np.sqrt(np.maximum(both * (1 - both) * (1 / n + 1 / m), 1e-12))
    best = np.argsort(-z, kind="stable")[:MOST_WORDS]
    return np.sort(best[z[best] >= LEAST_Z])


def choose_words(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Sorted hashes of the surest words of word sets held in memory."""

    def counts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)

    # Copies of one text say no more than one of them.
    positive = list({s.tobytes(): s for s in positive}.values())
    unlabelled = list({s.tobytes(): s for s in unlabelled}.values())
    (pw, pn), (uw, un) = counts(positive), counts(unlabelled)
    words = np.union1d(pw, uw)
    p, u = np.zeros(len(words)), np.zeros(len(words))
    p[np.searchsorted(words, pw)] = pn
    u[np.searchsorted(words, uw)] = un
    frequent = (p >= LEAST_SHARE * len(positive)) & (p > 0) | (u >= LEAST_SHARE * len(unlabelled))
    words, p, u = words[frequent], p[frequent], u[frequent]
    return words[surest(p, u, len(positive), len(unlabelled))]


def _inputs(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(words)), np.float32)
    for i, own in enumerate(sets):
        x[i, np.flatnonzero(np.isin(words, own))] = 1
    return x


def risk_gradient(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, bias: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The two parts of the risk (of positives, and of negatives by the corrected
    estimate) and the direction of a step for weights and bias: the gradient of their
    sum, or, where the second part is below zero, against its own gradient."""
    near = w.astype(np.float32)
    sp, su = _sigmoid((xp @ near).astype(float) + bias), _sigmoid((xu @ near).astype(float) + bias)
    # Logistic loss of a negative is -log(1 - s); its slope in the margin is s.
    as_positive = -prior * np.log(np.maximum(sp, 1e-12)).mean()
    as_negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
    down_w = xu.T @ su.astype(np.float32) / len(su) - prior * (xp.T @ sp.astype(np.float32)) / len(sp)
    down_b = su.mean() - prior * sp.mean()
    if as_negative < 0:
        return as_positive, as_negative, -down_w, -down_b
    return as_positive, as_negative, down_w + prior * (xp.T @ (sp - 1).astype(np.float32)) / len(sp), down_b + prior * (sp - 1).mean()


def fit_inputs(xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier by the non-negative risk estimator."""
    w, bias = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        _, _, gw, gb = risk_gradient(xp, xu, w, bias, prior)
        gradient = np.append(gw + PENALTY * w, gb)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, bias = w - change[:-1], bias - float(change[-1])
    return w, bias


def fit_unlabelled(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> WordModel:
    """Fit one classifier to word sets held in memory."""
    words = choose_words(positive, unlabelled)
    return WordModel(words, *fit_inputs(_inputs(positive, words), _inputs(unlabelled, words), prior))


def frequent_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the words in at least LEAST_SHARE of all texts, or of the
    ``positive`` ones. Counted over every row, combined by block and before the shuffle;
    at most the mean number of words of a text over LEAST_SHARE come back, of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("positive").to_numpy(zero_copy_only=False)
            for start, end, data, offsets in blocks(batch.column("text")):
                text, word = word_sets(data, offsets)
                found, at = np.unique(word, return_inverse=True)
                # Each word once a text.
                pairs = np.unique(text * len(found) + at)
                of, own = pairs % max(len(found), 1), marks[start:end][pairs // max(len(found), 1)]
                n, p = np.bincount(of, minlength=len(found)), np.bincount(of, own, len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n), pa.array(p)], ["word", "n", "p"])

    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("positive"), F.lit(0))).head()
    counted = rows.mapInArrow(run, "word bigint, n bigint, p bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    frequent = counted.where((F.col("n") >= LEAST_SHARE * total[0]) | ((F.col("p") > 0) & (F.col("p") >= LEAST_SHARE * total[1])))
    return np.sort(np.array([r[0] for r in frequent.select("word").collect()], np.int64).view(np.uint64))


def distinct_inputs(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """(bits, positive): which of the words a text has, once for all texts that have the
    same, and whether a positive one is among them. Combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                text, word = word_sets(data, offsets)
                at = np.minimum(np.searchsorted(words, word), len(words) - 1)
                hit = words[at] == word
                for low in range(0, end - start, 1024):
                    high = min(low + 1024, end - start)
                    x = np.zeros((high - low, len(words)), bool)
                    own = hit & (text >= low) & (text < high)
                    x[text[own] - low, at[own]] = True
                    bits = pa.array([b.tobytes() for b in np.packbits(x, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([bits, batch.column("positive").slice(start + low, high - low)], ["bits", "positive"])

    return rows.mapInArrow(run, "bits binary, positive int").groupBy("bits").agg(F.max("positive").alias("positive"))


def _unpacked(bits: pa.Array, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1)
    return np.unpackbits(raw, axis=1, count=width)


def _column_counts(inputs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many positive inputs, and how many of all, have each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _unpacked(batch.column("bits"), width), batch.column("positive").to_numpy() > 0
            sums = [x[own].sum(axis=0, dtype=np.int64), x.sum(axis=0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, sums)], ["at", "p", "u"])

    found = inputs.mapInArrow(run, "at bigint, p bigint, u bigint").groupBy("at").agg(F.sum("p"), F.sum("u")).collect()
    p, u = np.zeros(width), np.zeros(width)
    for at, positives, everyone in found:
        p[at], u[at] = positives, everyone
    return p, u


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, shard: int = SHARD) -> WordModel | None:
    """Fit to at most ``toxic`` confirmed documents, chosen by a hash of doc_id, and to
    all documents as the unlabelled side, in shards of about ``shard``.

    The share of toxic documents is that among all labelled ones. A document
    labelled both ways counts as toxic; null labels are none. Texts with the same
    frequent words count once; null and empty texts have none. Without a confirmed
    example there is no model. The driver gets frequent words, their counts, the bits
    of the confirmed examples, and one mean weight a word.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).head()[0]
    if not share:
        return None
    prior = min(max(float(share), 1e-4), 1 - 1e-4)
    confirmed = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic).select(F.col("doc_id").alias("__id"))
    marked = docs.select("doc_id", "text").join(F.broadcast(confirmed), F.col("doc_id") == F.col("__id"), "left")
    rows = marked.select("text", F.col("__id").isNotNull().cast("int").alias("positive"))

    words = frequent_words(rows)
    if not len(words):
        return None
    width = len(words)
    inputs = stored(distinct_inputs(rows, words), "inputs")
    positive = inputs.where("positive = 1").select("bits").toArrow()["bits"]
    if not len(positive):
        return None
    n = inputs.count()
    chosen = surest(*_column_counts(inputs, width), len(positive), n)
    xp = _unpacked(positive, width)[:, chosen].astype(np.float32)

    def run(table: pa.Table) -> pa.Table:
        x = _unpacked(table["bits"], width)[:, chosen].astype(np.float32)
        w, bias = fit_inputs(xp, x, prior)
        weights = np.append(w, bias)
        return pa.table({"at": np.arange(len(weights)), "weight": weights * len(x), "rows": np.full(len(weights), len(x))})

    dealt = inputs.select("bits", F.pmod(F.xxhash64("bits"), F.lit(max(1, round(n / shard)))).alias("shard"))
    fitted = dealt.groupBy("shard").applyInArrow(run, "at bigint, weight double, rows bigint")
    mean = fitted.groupBy("at").agg((F.sum("weight") / F.sum("rows")).alias("weight")).orderBy("at").collect()
    return WordModel(words[chosen], np.array([r["weight"] for r in mean[:-1]]), mean[-1]["weight"])


def score_toxicity(docs: DataFrame, model: WordModel | None, name: str = "score") -> DataFrame:
    """Add a score from 0 to 1 for every whole text; no shuffle.

    Null and empty texts have no words and get the bias's score; without a model
    every score is 0. A column of that name is replaced.
    """
    docs = docs.drop(name)
    names, schema = docs.columns, StructType([*docs.schema, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in blocks(batch.column("text")):
                part = batch.slice(start, end - start)
                scores = model.scores(data, offsets) if model is not None else np.zeros(end - start)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores)], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    model = fit_toxicity(docs.where(~held_out()), labels)
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DECIDES).cast("int").alias("predicted")
    )
