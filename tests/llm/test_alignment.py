"""Alignment against the libraries' whole encodings and plain byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeassess.llm import alignment as A

FIRST, SECOND = P.path(A.FIRST), P.path(A.SECOND)


def byte_level():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def brute(texts):
    """The contract's columns of {doc_id: text}, by whole texts and decoded bytes."""
    one = Tokenizer.from_file(FIRST)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters = byte_level()

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = {}, Counter()
    for doc_id, text in texts.items():
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [piece(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found[doc_id] = ([], [], [], [])
            continue
        ends = []
        for side in (bytes_a, bytes_b):
            at, own = 0, []
            for x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        cuts = [e for e in ends[0] if e in set(ends[1])]
        links, groups, i, j = [], [], 0, 0
        for cut in cuts:
            x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        found[doc_id] = (a, b, groups, links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return {
        d: (len(a), len(b), len(g), len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for d, (a, b, g, ls) in found.items()
    }


ODD = [
    None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a\nb", "a \n b", "\na", "a\n\nb", "tab\tt", "\ta b", "x \t y",
    "a▁b", "naïve café", "日本語 の文", "₪₪ ₪", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "İstanbul İ",
    "<|endoftext|> x", "<s> </s><unk>", "\x00 a", "a\r\nb", "　x   y", "don't we'll it's", "1234 56,7 0.5%", "é ö", "① ﬁ", "word " * 50, "﻿bom", "a" * 300, "  lead", "trail  ", "x  y   z", "नमस्ते สวัสดี",
]


def made(seed, n):
    r = random.Random(seed)
    parts = ["the", "token", "été", " ", "\n", "\t", "₪", "\U0001f600", "42", ".", ",", "'s", "日本", "Zx9q", "▁", "-", " ", "ing"]
    return ["".join(r.choice(parts) + (" " if r.random() < 0.5 else "") for _ in range(r.randint(1, 25))) for _ in range(n)]


def run(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r["doc_id"]: tuple(r[n] for n in names) for r in A.align(rows, FIRST, SECOND).collect()}


def test_odd_and_made_texts(spark):
    texts = dict(enumerate(ODD + made(1, 600)))
    want, found = brute(texts), run(spark, texts)
    for d in texts:
        assert found[d] == want[d], repr(texts[d])


def test_small_blocks_and_forgetting_change_nothing(spark, monkeypatch):
    texts = dict(enumerate(ODD + made(2, 200)))
    own = A.aligner(open(FIRST, encoding="utf-8").read(), open(SECOND, "rb").read())
    want = brute(texts)
    monkeypatch.setattr(A, "KNOWN", 40)
    rows = []
    for k in range(0, len(texts), 7):
        part = [texts[d] or "" for d in range(k, min(k + 7, len(texts)))]
        runs = own.numbers(part)
        rows += A._block_rows(own, k, list(range(k, k + len(part))), runs).to_pylist()[1:]
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in rows} == {d: (*w[:3], w[6]) for d, w in want.items()}
    own.clear()


def test_query_repeated_ids_and_clashing_columns(spark, tmp_path):
    docs = [(1, "one two three"), (1, "one two three"), (None, "two ₪"), (2, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("block", F.lit("x")).withColumn("n_a", F.lit(9)).withColumn("code", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = A.op12_alignment(spark, str(tmp_path)).collect()
    want = brute({0: "one two three", 1: "one two three", 2: "two ₪", 3: ""})
    assert sorted((r["count_sum"], r["groups_sha256"]) for r in found) == sorted((w[5], w[6]) for w in want.values())
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "2", "None"]


def test_very_long_text_and_empty_table(spark):
    text = " ".join(f"w{i % 5000} é{i % 7}" for i in range(200_000))
    assert run(spark, {7: text})[7][0] > 400_000
    assert run(spark, {3: "z" * 20_000 + " " * 20_000})[3][0] > 0
    assert A.align(spark.createDataFrame([], "doc_id bigint, text string"), FIRST, SECOND).collect() == []
