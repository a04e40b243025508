"""The classifier: held-out accuracy, independence of a document's neighbours, edge cases."""

import numpy as np
import pytest

from corvane.llm.quality import ByteNet, classify, fit, joined, train
from tests.llm.test_rows import edge_docs


def made(n, seed=1):
    random = np.random.default_rng(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    texts, labels = [], []
    for i in range(n):
        body = [words[k] for k in random.integers(0, 5, random.integers(1, 200))]
        bad = i % 4 == 0
        texts.append(((" $$$ " if bad else " ").join(body)).encode() + (b" $$$" if bad else b""))
        labels.append(int(not bad))
    return texts, labels


def test_held_out_accuracy():
    net = fit(*made(400), epochs=4)
    texts, labels = made(200, seed=2)
    score = net.score(*joined(texts))
    assert (((score >= 0.3) == labels).mean()) >= 0.97 and ((score >= 0) & (score <= 1)).all()


def test_brute_force_and_neighbours():
    net = ByteNet.new(6, 4, 16, 3)
    texts = [b"", b"a", b"abcdefghijklmnop", b"x" * 31, b"y" * 32, b"z" * 100]
    together = net.score(*joined(texts))
    assert together.tolist() == [net.score(*joined([t]))[0] for t in texts]
    text = texts[-1] + b""
    held = []
    chunks = -(-(len(text) + 5) // 16)
    for c in range(chunks):
        best = np.full(4, -1e4, np.float32)
        for i in range(c * 16, min(len(text), c * 16 + 16)):
            total = sum((net.filters[j, text[i + j]] for j in range(6) if i + j < len(text)), np.zeros(4, np.float32))
            best = np.maximum(best, total)
        held.append(np.maximum(best + net.bias, 0))
    logit = np.concatenate([np.max(held, axis=0), np.mean(held, axis=0)]) @ net.top + net.shift
    assert together[-1] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)


def test_query_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, epochs=1, least_steps=1).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    again = classify(docs.repartition(3), labels, epochs=1, least_steps=1).toPandas()
    assert sorted(got.score) == sorted(again.score)
    assert classify(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert classify(docs.limit(0), labels).count() == 0
    short = train(docs, labels, most_bytes=1, epochs=1, least_steps=1)
    assert short is not None  # one document at least


def test_held_out_rows_of_the_labels(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    ranks = got.score.rank()
    good = got.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert len(got) > 100 and auc >= 0.95 and ((got.predicted == 1) == good).mean() >= 0.9
