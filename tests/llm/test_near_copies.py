import random

import corpus_pipeline
from lakeassess.llm import near_copies as N

from .conftest import long_text


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(text, n, seed):
    words = text.split()
    for k, at in enumerate(random.Random(seed).sample(range(len(words)), n)):
        words[at] = f"new{seed}x{k}"
    return " ".join(words)


def brute(texts):
    lead = {i: i for i in texts}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                lead[b] = a
    return {i: top(i) for i in texts}


def many():
    texts = {}
    for k in range(60):
        base = long_text(k, 25 + 5 * k)
        texts[2 * k] = base
        texts[2 * k + 1] = changed(base, max(1, len(base.split()) // (45 if k % 3 else 12)), k)
    return texts


def test_stage_drops_copies_of_similarity_four_fifths(spark, documents):
    base = long_text(4, 200)
    texts = {1: base, 2: changed(base, 4, 1), 3: changed(base, 12, 2), 4: long_text(5, 200)}
    assert similarity(texts[1], texts[2]) >= 0.8 > similarity(texts[1], texts[3])
    left = corpus_pipeline.near_duplicates(spark, documents(texts), "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_groups_by_brute_force(documents):
    texts = many()
    wanted = brute(texts)
    assert sum(i != m for i, m in wanted.items()) > 20
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(documents(texts)).collect()} == wanted


def test_crowded_bands_are_searched_in_slices(documents, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 8)
    base = long_text(9, 150)
    texts = {i: changed(base, i % 5, i) for i in range(1, 41)}
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(documents(texts)).collect()} == brute(texts)


def test_rows_without_id_or_words(documents):
    text = long_text(4, 100)
    docs = documents([(7, text), (3, text), (3, text), (9, None), (8, " "), (None, text), (None, long_text(6)), (5, "a b"), (6, "A  b")])
    rows = [(r["doc_id"] or -1, r["component_id"]) for r in N.near_copies(docs).collect()]
    assert sorted(rows, key=str) == sorted([(7, 3), (3, 3), (3, 3), (9, 8), (8, 8), (-1, 3), (-1, None), (5, 5), (6, 5)], key=str)


def test_empty_table(documents):
    assert N.near_copies(documents({})).collect() == []
