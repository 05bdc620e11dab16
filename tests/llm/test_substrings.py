import hashlib

import numpy as np
import pytest

from lakeassess.llm import substrings as S

from .conftest import long_text, mirrored_words, words_of


def brute(texts, size=13):
    """(n_words, n_removed, kept) of each (doc_id, text), from all windows."""
    lowest = {}
    for i, text in texts:
        w = words_of(text)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                lowest[key] = min(i, lowest.get(key, i))
    out = []
    for i, text in texts:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if i is not None and lowest[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def cases():
    passage, other = long_text(1, 60), long_text(2, 60)
    return [
        (5, long_text(3, 40) + "\n" + passage + " " + long_text(4, 30)),
        (2, passage),
        (9, long_text(5, 20) + " " + passage + " \t" + other),
        (7, other),
        (8, " ".join(passage.split()[10:22])),  # twelve words: no window
        (10, " ".join(passage.split()[10:23])),  # thirteen: one
        (11, passage + " " + passage),
        (3, "a a a a a a a a a a a a a a a a a a a a"),
        (4, "a a a a a a a a a a a a a a"),
        (12, None),
        (13, ""),
        (14, passage.upper()),
        (None, passage),
        (9, other),
        (2, passage),
    ]


@pytest.mark.parametrize("files", [1, 5])
def test_against_all_windows(documents, files):
    texts = cases()
    docs = documents(texts).repartition(files).withColumnRenamed("lang", "n_words")
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in S.remove_repeats(docs).collect()))
    assert got == sorted((i or -1, *row) for (i, _), row in zip(texts, brute(texts)))


@pytest.mark.parametrize("size", [1, 4, 6])
def test_other_window_sizes(documents, size):
    texts = [(i, " ".join(long_text(i % 3, 12).split()[i % 4 :])) for i in range(9)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in S.remove_repeats(documents(texts), size).collect()}
    assert [got[i] for i, _ in texts] == brute(texts, size)


def test_a_full_bit_set_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(S, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(S, "BITS_PER_SEED", 1)
    monkeypatch.setattr(S, "HELD", 10)
    texts = cases()
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in S.remove_repeats(documents(texts)).collect())
    assert got == sorted((i or -1, row[1]) for (i, _), row in zip(texts, brute(texts)))


def test_runs_come_back():
    r = np.random.default_rng(1)
    hashes = np.sort(r.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    low = r.integers(-50, 50, 500)
    second = r.integers(0, 1 << 62, 500).astype(np.uint64)
    batch = S._packed(hashes, second, low, low + r.integers(0, 3, 500), 7)
    parts = [S._unpacked(x.as_py()) for x in batch.column("run")]
    assert np.concatenate([p[0] for p in parts]).tolist() == hashes.tolist()
    assert np.concatenate([p[1] for p in parts]).tolist() == second.tolist()
    assert np.concatenate([p[2] for p in parts]).tolist() == low.tolist()
    assert batch.column("part").to_pylist() == sorted(set(batch.column("part").to_pylist()))


def test_longest_repeats_double(documents):
    passage = long_text(1, 60)
    docs = documents({1: passage, 2: long_text(2, 9) + " " + passage, 3: " ".join(passage.split()[:20])})
    rows = S.longest_repeats(docs)
    found = {}
    for r in rows.collect():
        found.setdefault((r["doc_id"], r["length"]), set()).add(r["at"])
    assert found[1, 13] == set(range(48)) and found[1, 26] == set(range(35)) and found[1, 52] == set(range(9))
    assert found[2, 52] == set(range(9, 18)) and found[3, 13] == set(range(8)) and (3, 26) not in found
    assert max(length for _, length in found) == 52


def test_empty_table(documents):
    assert S.remove_repeats(documents({})).collect() == []


def test_query(spark, tmp_path, documents):
    documents({1: long_text(1), 2: long_text(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in S.op9_substrings(spark, str(tmp_path)).collect()}
    assert rows[1]["n_removed"] == 0 and rows[2]["n_removed"] == rows[2]["n_words"] == 60
    assert rows[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_mirrored_words_are_different(spark, documents):
    one, other = mirrored_words()
    shared = " ".join(f"w{i}" for i in range(12))
    rows = S.remove_repeats(documents({1: f"{shared} {one}", 2: f"{shared} {other}", 3: f"{shared} {one}"})).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {1: 0, 2: 0, 3: 13}


def test_equal_windows_choose_equally_at_every_level():
    passage = long_text(1, 13)
    texts = [f"{long_text(k, k)} {passage} {long_text(9, 7)}".encode() for k in range(1, 30)]
    for length in S._lengths(13):
        chosen = []
        for k, text in enumerate(texts, 1):
            words = S.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            at, hashes = S._level(words, 13, length, 0, None)
            chosen.append({h for a, h in zip(at.tolist(), hashes.tolist()) if k <= a <= k + 13 - length})
        assert set.intersection(*chosen)


def test_windows_of_one_hash_are_told_apart(documents, monkeypatch):
    # One first hash for all full windows: the second one decides.
    texts = cases()
    plain, widest = S.window_hashes, S._lengths(13)[-1]
    words = [w for _, t in texts for w in words_of(t)]
    assert len(words) > 100

    def same(hashes, size):
        found = plain(hashes, size)
        return found & np.uint64(1) if size == widest and not same.second else found

    same.second = False
    second = S._second

    def apart(words, at, length):
        same.second = True
        try:
            return second(words, at, length)
        finally:
            same.second = False

    found = []
    monkeypatch.setattr(S, "window_hashes", same)
    monkeypatch.setattr(S, "_second", apart)
    blocks = [(i, t.encode()) for i, t in texts if i is not None and t]
    for i, text in blocks:
        w = S.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        at, h = S._level(w, 13, 13, 0, None)
        found += [(i, x, y) for x, y in zip(h.tolist(), apart(w, at, 13).tolist())]
    lowest = {}
    for i, h, g in found:
        lowest[h, g] = min(i, lowest.get((h, g), i))
    wanted = {(i, t): row for (i, t), row in zip(texts, brute(texts))}
    for i, text in blocks:
        w = S.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        at, h = S._level(w, 13, 13, 0, None)
        unsure = [{"h": a, "g": b} for j, a, b in found if j == i and lowest[a, b] < i]
        here = S._meant(w, at, h, np.zeros(0, np.uint64), unsure, 13)
        gone = {p for a in here.tolist() for p in range(a, a + 13)}
        assert len(gone) == wanted[i, text.decode()][1]


def test_each_level_has_fewer_windows(documents):
    # Common short runs of words end the search at the first levels.
    lines = [" ".join(f"{w} {w}a {w}b {w}c {w}d" for w in long_text(k, 12).split()) for k in range(6)]
    rows = S._prepared(documents(dict(enumerate([*lines, long_text(77, 60), long_text(77, 60)[5:]]))))
    before, marked = S._narrowed(rows, 13, 3)
    assert before == 8
    wide = S._occurrences(rows, 13, 13, 0, None).count()
    assert 0 < S._occurrences(rows, 13, 13, before, marked).count() < wide


def test_entries_of_one_hash_stay_apart_by_the_second():
    hashes, second = np.array([3, 3, 3, 1], np.uint64), np.array([9, 8, 9, 9], np.uint64)
    ids = np.array([4, 5, 6, 7])
    got = S._merged(hashes, second, ids, ids)
    assert [x.tolist() for x in got] == [[1, 3, 3], [9, 8, 9], [7, 5, 4], [7, 5, 6]]
    text = long_text(1, 40).encode()
    words = S.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    at = np.arange(5, 20)
    again = S._second(words, at, 13)
    assert len(set(again.tolist())) == 15 and not set(again.tolist()) & set(S.window_hashes(words.hashes(), 13).tolist())
