import os

import pytest

import corpus_pipeline
from lakeassess.llm.registry import QUERIES, SQL

from .conftest import long_text

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES) and set(corpus_pipeline.QUERIES) == {"pipeline"}


@pytest.fixture()
def folder(spark, tmp_path, documents):
    clean = {i: "\n".join(long_text(100 * i + k, 25).capitalize() + "." for k in range(6)) for i in range(1, 9)}
    texts = dict(clean)
    texts[20] = clean[1]
    texts[21] = clean[2].rsplit(" ", 1)[0] + " end."
    texts[22] = "\n".join(long_text(5000 + k, 25).capitalize() + "." for k in range(4)) + "\n" + clean[3].split("\n")[2]
    texts[23] = clean[4].replace("\n", " token = 0123456789abcdef0123456789abcdef\n", 1).replace("a", "e") + long_text(7000, 40)
    texts[24], texts[25], texts[26] = None, "", "too short"
    docs = documents([*texts.items(), (1, clean[1]), (None, long_text(9000, 40) + ".")])
    docs.withColumnRenamed("n_chars", "kept").selectExpr("doc_id", "text", "lang", "source", "kept as n_chars", "kept").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, 1, 0) for i in clean]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts


def test_every_stage(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) for name, rows in seen.items()}
    assert ids["quality"] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 20, 21, 22, 23]
    assert 20 not in ids["near_duplicates"] and ids["near_duplicates"].count(1) == 1
    assert {2, 3, 4, 5, 6, 7, 8, 22, 23} <= set(ids["near_duplicates"])
    text = {r["doc_id"]: r["text"] for r in seen["substrings"]}
    assert text[1] == texts[1] and texts[3].split("\n")[2] not in text[22] and text[22] in " ".join(texts[22].split())
    cleaned = {r["doc_id"]: r for r in seen["secrets"]}
    assert "[SECRET]" in cleaned[23]["text"] and "0123456789abcdef" not in cleaned[23]["text"]
    assert cleaned[1]["text"] == texts[1] and cleaned[23]["n_chars"] == len(cleaned[23]["text"])
    assert sorted(set(ids["packing"])) == sorted(set(ids["secrets"]))


def test_empty_documents(spark, tmp_path, documents):
    documents({}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert 0 < len({r["doc_id"] for r in rows}) < 200
    assert sum(labels.get(i) == 1 for i in {r["doc_id"] for r in rows}) > 0.8 * sum(labels.values())
