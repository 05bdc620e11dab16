import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from lakeassess.llm.quality import N_FEATURES, Lines, LineModel, fit, fit_lines, judge, measure, op10_quality, viterbi
from lakeassess.llm.words import joined

from .conftest import long_text, mirrored_words, words_of

SF_DIR = "/root/testdata/sf0.01"


def slow_counts(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = [False] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            again[i : i + 8] = [True] * 8
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), sum(again)


def odd_texts():
    r = random.Random(4)
    letters = "aé😀 \n\t#|<\x0b"
    texts = [None, "", "\n", " \n \n", "one", "a\n", "\na", "a b\na b\n a b\n\na b", "x " * 40, long_text(1, 30) + "\n" + long_text(1, 30)]
    return texts + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300)]


def test_base_counts():
    texts = odd_texts()
    counts, lines = measure(*joined([(t or "").encode() for t in texts]))
    got = list(zip(*(counts[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [slow_counts(t) for t in texts]
    assert len(lines.features) == lines.first[-1] and np.isfinite(lines.features).all()
    assert np.add.reduceat(np.append(lines.words, 0), lines.first[:-1])[np.diff(lines.first) > 0].tolist() == [
        n for n, k in zip(counts["n_words"], np.diff(lines.first)) if k
    ]


def test_viterbi_finds_the_best_labels():
    r = np.random.default_rng(1)
    for _ in range(20):
        counts = r.integers(0, 6, 5)
        lines = Lines(r.normal(size=(counts.sum(), N_FEATURES)), np.ones(counts.sum(), int), np.concatenate([[0], np.cumsum(counts)]))
        model = LineModel(r.normal(size=N_FEATURES), r.normal(size=(2, 2)))
        found = viterbi(model, lines)
        for a, b in zip(lines.first, lines.first[1:]):
            score = lines.features[a:b] @ model.weights

            def total(labels, score=score):
                return sum(s for s, y in zip(score, labels) if y) + sum(model.moves[x, y] for x, y in zip(labels, labels[1:]))

            best = max(total(x) for x in itertools.product((0, 1), repeat=b - a))
            assert total(found[a:b].astype(int).tolist()) == pytest.approx(best)


def test_fit_separates_and_needs_both_labels():
    r = np.random.default_rng(2)
    good = [np.column_stack([np.ones(n), r.normal(1, 0.3, (n, N_FEATURES - 1))]) for n in r.integers(1, 100, 40)]
    bad = [np.column_stack([np.ones(n), r.normal(-1, 0.3, (n, N_FEATURES - 1))]) for n in r.integers(1, 9, 40)]
    model = fit(good + bad, [1] * 40 + [0] * 40)
    for chains, label in ((good, 1), (bad, 0)):
        for chain in chains:
            lines = Lines(chain, np.ones(len(chain), int), np.array([0, len(chain)]))
            assert (viterbi(model, lines) == label).mean() > 0.9
    assert fit(good, [1] * 40) is None and fit([], []) is None


def test_judge_without_model_and_clashing_columns(documents):
    docs = documents([(1, None), (2, ""), (3, long_text(1, 30)), (3, long_text(1, 30)), (None, "x " * 40)])
    docs = docs.withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    rows = {r["doc_id"]: r for r in judge(docs, None).collect()}
    assert not rows[1]["kept"] and rows[1]["base_failed"] and rows[1]["content_share"] == 0
    assert rows[3]["kept"] and not rows[3]["base_failed"]
    assert rows[None]["base_failed"]


def test_labels_without_use_give_no_model(spark, documents):
    docs = documents({1: long_text(1, 30)})
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 7, 0)], "doc_id bigint, quality int, toxic int")
    assert fit_lines(docs, labels) is None
    assert judge(documents({}), None).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_good_documents_stay_and_bad_ones_go(spark):
    rows = op10_quality(spark, SF_DIR).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    passed = [r for r in rows if not r["base_failed"] and r["doc_id"] in labels]
    good = [r["kept"] for r in passed if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in passed if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_mirrored_lines_are_different():
    one, other = mirrored_words()
    counts, _ = measure(*joined([f"{one}\n{other}\n{one}".encode()]))
    assert counts["n_dup_lines"].tolist() == [1]
