import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from lakeassess.llm.store import ship

    ship(spark)


@pytest.fixture()
def documents(spark):
    """Documents from {doc_id: text} or from (doc_id, text) pairs."""

    def make(texts):
        rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA)

    return make


def words_of(text):
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def long_text(seed, n=60):
    """Words without meaning, the same for a seed."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def mirrored_words():
    """Two words of 1,024 letters, a sequence and its complement, that polynomial hashes
    modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
