import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from lakeassess.llm import bpe, chunks, tokens

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Words whose normalized form ends in a mark, and strings of special tokens.
SPECIAL = [
    "BELEDİYESİ. İ! aİ,", "É. e\u0301. e\u0301, i\u0307!", "x<|endoftext|>y <|endoftext|>. <|endoftext|>",
    "<|startoftext|> a<|startoftext|>!!", "İstanbul İ.İ, Σ. ΑΣ! ß. ŉ.",
]


def odd_texts():
    r = random.Random(5)
    letters = " \n\taabée'sth10,.  "
    texts = ["", " ", "  ", "a  b   c \n \n x ", "\n \nB", "x  y  \t z", "a" * 500, "あい \U0001f600 's don't <|endoftext|>", "\r\n A\nB \nC ½²"]
    return texts + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(800)]


def ids_of(encoder, texts):
    return [flat[o[i] : o[i + 1]].tolist() for _, _, flat, o in encoder(pa.array(texts)) for i in range(len(o) - 1)]


def test_same_ids_as_the_library(reference):
    with open(PATH, "rb") as file:
        encoder = bpe.encoder(file.read(), public_tokenizers.PATTERN)
    texts = odd_texts()
    assert ids_of(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_merge_that_makes_a_lower_rank():
    # After "bc" (rank 300) merges, "a"+"bc" has a lower rank than the second "bc".
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 299, b"bc": 300}
    replay = bpe.MergeReplay(ranks)
    ids, offsets = replay([b"abcbc", b"bc", b"bcbcbc"])
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[299, 300], [300], [300, 300, 300]]
    assert replay.one_word(b"abcbc") == [299, 300]


def test_overlapping_pairs_merge_from_the_left():
    replay = bpe.MergeReplay({bytes([i]): i for i in range(256)} | {b"aa": 256})
    for n in range(1, 8):
        assert replay([b"a" * n])[0].tolist() == [256] * (n // 2) + [97] * (n % 2)


def test_encode_and_decode_documents(documents, reference):
    texts = {1: None, 2: "", 3: "héllo wörld\n\n x", 4: "héllo wörld\n\n x"}
    docs = documents(texts).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    rows = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for i, text in texts.items():
        assert rows[i]["ids"] == reference.encode_ordinary(text or "")
        assert bytes(rows[i]["decoded"]) == (text or "").encode()


def test_query_digests(spark, tmp_path, documents, reference):
    documents({1: "one two", 2: None}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in bpe.op2_byte_bpe(spark, str(tmp_path)).collect()}
    ids = ",".join(map(str, reference.encode_ordinary("one two")))
    assert rows[1]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_tokenizers_ids(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        definition = file.read()
    tokenizer = Tokenizer.from_str(definition)
    texts = odd_texts() + SPECIAL
    wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(tokens.encoder(definition), texts) == wanted


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_go_to_the_model_alone(name, monkeypatch):
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        definition = file.read()
    tokenizer, handed = Tokenizer.from_str(definition), []

    class Watched:
        def __getattr__(self, attribute):
            return getattr(tokenizer, attribute)

        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", type("Fake", (), {"from_str": staticmethod(lambda _: Watched())}))
    r, letters = random.Random(5), [c for c in map(chr, range(0x180)) if c.isalpha() and c not in "ªµºİ"]
    words = ["".join(r.choices(letters, k=r.randint(1, 20))) for _ in range(300)] + ["".join(letters), "I", "ŉ", "ſs", "Straße", "ŀl"]
    texts = [" ".join(words[i : i + 9]) + "\n" + words[i] for i in range(0, len(words), 9)] + words
    assert ids_of(tokens.encoder.__wrapped__(definition), texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not handed


@pytest.mark.parametrize("change", ["added token", "cut at capitals"])
def test_words_a_tokenizer_cuts_are_not_asked_of_its_model(change):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = Tokenizer.from_str(file.read())
    if change == "added token":
        tokenizer.add_tokens(["kind"])
    else:
        cut = pre_tokenizers.Split(Regex("[A-Z]"), "merged_with_next")
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([cut, tokenizer.pre_tokenizer])
    texts = ["an unkindly MacDonald", "kind\nkindness mankind"]
    assert ids_of(tokens.encoder.__wrapped__(tokenizer.to_str()), texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_repeated_chunks_are_looked_up_once(monkeypatch):
    looked = []

    class Watched(chunks.Index):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    monkeypatch.setattr(chunks, "Index", Watched)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    texts = ["", "one", "one two\ntwo one  one", " two one two\none", "two"] * 50
    wanted = [e.ids for e in Tokenizer.from_str(definition).encode_batch(texts, add_special_tokens=False)]
    assert ids_of(tokens.encoder.__wrapped__(definition), texts) == wanted
    inner = [key for key in looked if not key.startswith("\ud800")]
    assert len(inner) == len(set(inner))
