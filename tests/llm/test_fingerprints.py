import hashlib

import numpy as np
import pytest

from lakeassess.llm.fingerprints import add_fingerprints, edited_documents, fingerprints, likeness
from lakeassess.llm.words import joined

from .conftest import long_text


def prints(*texts):
    return fingerprints(*joined([t.encode() for t in texts]))


def jaccard(a, b):
    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def test_equal_texts_equal_fingerprints():
    a, b, c = prints(long_text(1), long_text(1), long_text(2))
    assert a == b != c


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_likeness_follows_the_true_share(share):
    words = long_text(3, 2000).split()
    cut = int(len(words) * share)
    a, b = " ".join(words), " ".join(words[:cut] + long_text(4, 2000).split()[cut:])
    got = likeness(prints(a), prints(b))[0]
    assert abs(got - jaccard(a, b)) < 0.07


def test_short_and_empty_texts():
    one, other, empty, white = prints("a b", "a c", "", " \n")
    assert empty == white == b""
    assert likeness([one, one, empty, empty], [one, other, empty, one]).tolist()[0] == 1
    got = likeness([one, one, empty, empty], [one, other, empty, one])
    assert got[1] < 0.2 and got[2] == 1 and got[3] == 0


def test_bits_and_bins_are_parameters():
    a, b = (fingerprints(*joined([long_text(s, 300).encode()]), bins=64, bits=8)[0] for s in (1, 2))
    assert len(a) == 64 and likeness([a], [a], bits=8)[0] == 1 and likeness([a], [b], bits=8)[0] < 0.2


def test_column_is_replaced_and_rows_stay(documents):
    docs = documents([(1, None), (2, ""), (3, long_text(1)), (3, long_text(1))]).withColumnRenamed("lang", "fingerprint")
    rows = add_fingerprints(docs).collect()
    assert len(rows) == 4
    found = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert found[1] == found[2] == "" and len(found[3]) == 512


def expected(texts):
    ids = sorted(texts, reverse=True)
    out = {}
    for i, k in enumerate(ids):
        text, following = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        moved = len(text) // 3
        out[k] = (len(text), text[: len(text) - moved] + following[:moved])
    return out


def test_edited_documents_pair_across_partitions(spark, documents):
    texts = {i: long_text(i, 5 + i) + " é😀" for i in range(0, 60, 3)} | {1: None, 2: "", 100: "x"}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = edited_documents(documents(texts).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    wanted = expected(texts)
    assert len(rows) == len(texts)
    for r in rows:
        n, edited = wanted[r["doc_id"]]
        assert r["n_chars"] == n
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == prints(edited)[0].hex()


def test_edited_edge_tables(documents):
    assert edited_documents(documents({})).collect() == []
    lone = edited_documents(documents({7: "abc def"})).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1
    repeated = edited_documents(documents([(1, "a b c"), (1, "a b c"), (None, "z")])).collect()
    assert len(repeated) == 3 and np.isfinite([r["near_edited"] for r in repeated]).all()
