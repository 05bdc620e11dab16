import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeassess.llm.elias_fano import TOKENIZER, EliasFano, TokenFile, read_tokens, write_tokens
from lakeassess.llm.store import shared_path

from .conftest import long_text

PATH = public_tokenizers.path(TOKENIZER)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
@pytest.mark.parametrize("top", [1, 10, 10**6, 2**45])
def test_numbers_come_back(n, top):
    r = random.Random(n)
    values = sorted(r.randrange(top) for _ in range(n))
    coded = EliasFano.of(np.array(values, np.uint64))
    read, _ = EliasFano.from_bytes(memoryview(coded.to_bytes()), 0)
    assert read.values().tolist() == values
    assert [read.select(i) for i in range(n)] == values
    with pytest.raises(IndexError):
        read.select(n)


def test_space_is_near_the_least():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20_000))
    bits = len(EliasFano.of(values).to_bytes()) * 8 / len(values)
    assert bits < np.log2(values[-1] / len(values)) + 3


def test_file_round_trip_with_wide_ids():
    file = TokenFile.of(3, 10, [None, -5, 7, 7], [1, 2, 0, 3], np.array([1, 2, 3, 70000, 5, 6]))
    read = TokenFile.from_bytes(file.to_bytes() + b"\0")
    assert (read.part, read.before, len(read), read.doc_ids()) == (3, 10, 4, [None, -5, 7, 7])
    assert [read.document(i).tolist() for i in range(4)] == [[1], [2, 3], [], [70000, 5, 6]]
    with pytest.raises(ValueError):
        TokenFile.from_bytes(b"something else, long enough to be a header of a token file")


@pytest.mark.parametrize("file_ids", [50, 1 << 20])
def test_documents_in_order(spark, documents, file_ids):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [(i * 7 - 20, long_text(i, 5 + i)) for i in range(40)] + [(None, "abc"), (1000, None), (1001, ""), (1001, "")]
    path = shared_path(spark, "test-tokens")
    docs = documents(texts)
    write_tokens(docs.repartition(4), path, PATH, file_ids=file_ids)
    rows = sorted(read_tokens(spark, path, ids=True).collect(), key=lambda r: r["start"])
    texts.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    assert [r["doc_id"] for r in rows] == [t[0] for t in texts]
    at = 0
    for row, (_, text) in zip(rows, texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert row["ids"] == ids and row["start"] == at and row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark, documents):
    path = shared_path(spark, "test-tokens")
    write_tokens(documents({}), path, PATH)
    assert read_tokens(spark, path).collect() == []
