import os
import zlib

import numpy as np
import pytest

from lakeassess.llm.toxicity import (
    WordModel,
    fit_toxicity,
    fit_unlabelled,
    frequent_words,
    op8_toxicity,
    risk_gradient,
    score_toxicity,
    word_sets,
)
from lakeassess.llm.words import joined

from .conftest import long_text

SF_DIR = "/root/testdata/sf0.01"


def sets(texts):
    out = []
    for t in texts:
        _, words = word_sets(*joined([t.encode()]))
        out.append(np.unique(words))
    return out


def test_words_are_cut_at_signs_and_lower_cased():
    a, b = sets(["Fool, FOOL! fool", "fool"])
    assert a.tolist() == b.tolist()
    assert len(sets(["é-x é"])[0]) == 2


def test_learns_from_positives_and_unlabelled_alone():
    clean = [long_text(i, 60) for i in range(400)]
    toxic = [long_text(1000 + i, 60) + (" fool" if i % 2 else " clown, fool") for i in range(120)]
    model = fit_unlabelled(sets(toxic[:60]), sets(clean[:300] + toxic[60:90]), 0.1)
    scores = model.scores(*joined([t.encode() for t in clean[300:] + toxic[90:]]))
    assert (scores[:100] < 0.3).all() and (scores[100:] > 0.5).all()


def test_risk_and_gradient_against_differences():
    r = np.random.default_rng(3)
    # More of the inputs among positives: with weights above zero they fall apart.
    xp, xu = (r.random((n, 5)) < share for n, share in ((30, 0.8), (200, 0.2)))
    xp, xu = xp.astype(np.float32), xu.astype(np.float32)
    signs = set()
    for prior, mean in ((0.1, 0.0), (0.6, 2.0), (0.9, 2.0)):
        w, bias = r.normal(mean, 0.5, size=5), float(r.normal(-mean, 0.5))

        def parts(w, bias):
            # Written out: loss of positives, and of unlabelled less positives, as negatives.
            sp, su = (1 / (1 + np.exp(-(x.astype(float) @ w + bias))) for x in (xp, xu))
            return np.array([-prior * np.log(sp).mean(), -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()])

        plus, minus, gw, gb = risk_gradient(xp, xu, w, bias, prior)
        assert np.allclose([plus, minus], parts(w, bias), rtol=1e-4, atol=1e-5)
        signs.add(minus < 0)
        for k in range(6):
            e = np.eye(6)[k] * 1e-5
            slope = (parts(w + e[:5], bias + e[5]) - parts(w - e[:5], bias - e[5])) / 2e-5
            wanted = -slope[1] if minus < 0 else slope.sum()
            assert abs([*gw, gb][k] - wanted) < 1e-4
    assert signs == {True, False}


def test_frequent_words_count_each_document_once(spark):
    rows = [("fool fool fool", 1)] + [(f"word{i} common", 0) for i in range(150)] + [(None, 0), ("", 0)]
    found = frequent_words(spark.createDataFrame(rows, "text string, positive int").repartition(3))
    assert found.tolist() == sorted(np.concatenate(sets(["fool", "common"])).tolist())


def test_all_unlabelled_text_in_shards(spark, documents):
    clean = {i: long_text(i, 40) for i in range(500)}
    toxic = {1000 + i: long_text(2000 + i, 40) + (" fool" if i % 2 else " clown, fool") for i in range(80)}
    labels = spark.createDataFrame([(i, 0) for i in range(300)] + [(1000 + i, 1) for i in range(40)], "doc_id bigint, toxic int")
    docs = documents({**clean, **toxic, 5000: None, 5001: ""})
    for shard in (100, 16_384):
        model = fit_toxicity(docs, labels, shard=shard)
        scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
        assert all(scores[i] > 0.5 for i in range(1040, 1080)) and all(scores[i] < 0.3 for i in [*range(300, 500), 5000, 5001])


def test_edge_texts_and_columns(documents):
    model = WordModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    docs = documents([(1, None), (2, ""), (None, "x"), (2, "")]).withColumnRenamed("lang", "score")
    assert [r["score"] for r in score_toxicity(docs, model).collect()] == [0.5] * 4
    assert [r["score"] for r in score_toxicity(docs, None).collect()] == [0.0] * 4
    assert score_toxicity(documents({}), model).collect() == []


def test_no_confirmed_example_no_model(spark, documents):
    labels = "doc_id bigint, toxic int"
    assert fit_toxicity(documents({1: "a"}), spark.createDataFrame([(1, 0), (2, None)], labels)) is None
    assert fit_toxicity(documents({1: "a"}), spark.createDataFrame([], labels)) is None


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in op8_toxicity(spark, SF_DIR).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in labels]
    toxic = [p for y, p in held if y]
    assert np.mean([p for y, p in held if not y]) < 0.05
    # About a tenth of the labels are noise.
    assert np.mean(toxic) > 0.55
