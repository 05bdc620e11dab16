import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeassess.llm.packing import TOKENIZER, pack_documents, place_pieces, plan_windows, sequences, token_pieces

from .conftest import long_text

PATH = public_tokenizers.path(TOKENIZER)
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint"


def test_plan_uses_every_piece_and_fills_windows():
    r = random.Random(1)
    histogram = dict(Counter(r.randint(1, 64) for _ in range(5000)))
    fills = plan_windows(histogram, 64)
    used = Counter()
    for fill in fills:
        assert sum(k * n for k, n in fill.counts.items()) <= 64
        for length, n in fill.counts.items():
            used[length] += n * fill.times
    assert used == histogram
    slack = sum((64 - sum(k * n for k, n in f.counts.items())) * f.times for f in fills)
    assert slack < 0.01 * sum(k * n for k, n in histogram.items())


def test_each_window_is_the_closest_possible():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.randint(1, 30) for _ in range(7)]
        fill = plan_windows(dict(Counter(lengths)), 31)[0]
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        best = max(s for s in sums if s <= 31 - max(lengths))
        assert sum(k * n for k, n in fill.counts.items()) == max(lengths) + best


def test_a_piece_longer_than_the_window_is_an_error():
    with pytest.raises(ValueError):
        plan_windows({65: 1}, 64)


def check_layout(rows, window):
    by = defaultdict(list)
    for row in rows:
        by[row["sequence_id"]].append((row["offset"], row["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_place_repeated_and_nameless_pieces(spark):
    r = random.Random(3)
    rows = [(i % 5 or None, 0, 7 if i % 3 else r.randint(1, 64), 1, 1, 99) for i in range(400)]
    placed = place_pieces(spark.createDataFrame(rows, PIECES).repartition(3), 64).collect()
    assert len(placed) == 400
    assert Counter(p["length"] for p in placed) == Counter(row[2] for row in rows)
    check_layout(placed, 64)


def test_documents_round_trip(documents):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {1: None, 2: "", 3: "short text", 4: long_text(1, 3000), 5: long_text(2, 900), 6: "short text"}
    wanted = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    placed = place_pieces(token_pieces(documents(texts), PATH, keep_ids=True))
    rows = placed.collect()
    check_layout(rows, 2048)
    windows = {r["sequence_id"]: r["ids"] for r in sequences(placed).collect()}
    found = defaultdict(dict)
    for r in rows:
        ids = windows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(wanted[r["doc_id"]])
        found[r["doc_id"]][r["start"]] = ids
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in found.items()} == wanted


def test_empty_table(documents):
    assert pack_documents(documents({}), PATH).collect() == []
