"""The pipeline against a brute-force version of each stage's decision."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from corvane.llm.mixing import mix_by_source
from corvane.llm.quality import quality_score, train
from tests.llm.test_rows import edge_docs, norm

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "digest", "run", "h", "rank"]


def corpus(spark, tmp_path):
    pick = random.Random(12)
    vocabulary = [f"wort{i}" for i in range(900)]
    rows, near_of = [], {}
    for i in range(120):
        words = pick.choices(vocabulary, k=pick.choice([40, 200]))
        rows.append((i, " ".join(words) if i % 6 else " ".join(w + " $$$" for w in words), f"s{i % 4}"))
    for i in range(120, 140):  # exact copies but for white space
        rows.append((i, rows[i - 119][1].replace(" ", "\n"), "s9"))
    for i in range(140, 160):  # near copies: one word of 200 differs
        of = next(r for r in rows[(i - 139) :] if len(r[1].split()) == 200 and "$" not in r[1] and r[0] not in near_of.values())
        words = of[1].split(" ")
        words[100] = "anders"
        rows.append((i, " ".join(words), None))
        near_of[i] = of[0]
    rows += [(160, None, "s1"), (None, "wort1 wort2 wort3", "s1"), (161, "wort5 " * 3000, "s2"), (7, "wort8 wort9 eine andere zeile", "s3")]
    docs = edge_docs(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int("$" not in r[1]), 0) for r in rows[:120]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, near_of


def test_stages(spark, tmp_path):
    rows, near_of = corpus(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == COLUMNS
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept.append(spark.read.parquet(path))
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    raw, good, exact, near, mixed = map(key, kept)
    net = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = docs.select("doc_id", "text", quality_score(spark, net, cp.text_or_empty()).alias("p")).collect()
    assert good == Counter((r.doc_id, r.text) for r in scores if r.p >= 0.3)
    assert not any("$$$" in (t or "") for _, t in good) and sum(good.values()) >= sum("$$$" not in (t or "") for _, t in raw.elements()) - 2
    best = {}
    for d, t in good:
        n = norm(t)
        if n not in best or (d is not None, -(d or 0)) > (best[n][0] is not None, -(best[n][0] or 0)):
            best[n] = (d, t)
    assert set(exact) == set(best.values()) and set(exact.values()) == {1}
    ids = {d for d, _ in exact}
    dropped = set(exact) - set(near)
    assert {d for d, _ in dropped} == {i for i, of in near_of.items() if i in ids and of in ids} and not set(near) - set(exact)
    plan = {(r.doc_id, r.size): r.times for r in mix_by_source(kept[3]).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert mixed == Counter({(d, t): plan[d, size(t)] for d, t in near if plan[d, size(t)]})
    pieces = cp.STAGES[-1][1](spark, kept[-1], sf).toPandas()
    whole = pieces[pieces.start == 0]
    assert Counter(None if d != d else int(d) for d in whole.doc_id) == Counter({d: n for d, n in Counter(d for d, _ in mixed.elements()).items()})
    assert (pieces.groupby("sequence_id").length.sum().iloc[:-1] == 2048).all()


def test_run_and_repeated_rows(spark, tmp_path):
    corpus(spark, tmp_path)
    again = spark.read.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "b").mkdir()
    again.unionByName(again).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(tmp_path / "b/labels.parquet"))
    a, b = (cp.run(spark, str(p)).toPandas() for p in (tmp_path, tmp_path / "b"))
    assert a.length.sum() == pytest.approx(b.length.sum(), rel=0.02)


def test_empty_tables(spark, tmp_path):
    edge_docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS and out.count() == 0


def test_planted_near_copies(spark):
    """Of near copies with an exact similarity of 0.8 or more, at least 0.9 are joined to their original, and no others."""
    pick = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    rows, of = [], {}
    for i in range(150):
        words = pick.choices(vocabulary, k=pick.choice([30, 120, 400]))
        rows.append((2 * i, " ".join(words), "s"))
        other = list(words)
        for _ in range(max(1, round(len(words) * pick.choice([0.005, 0.01, 0.02, 0.05])))):
            other[pick.randrange(len(other))] = pick.choice(vocabulary)
        a, b = shingles(words), shingles(other)
        rows.append((2 * i + 1, " ".join(other), "s"))
        of[2 * i + 1] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in cp.near(spark, edge_docs(spark, rows), "").collect()}
    near = [d for d, j in of.items() if j >= 0.8]
    assert len(near) >= 40 and sum(d not in kept for d in near) >= 0.9 * len(near)
    assert all(d in kept for d, j in of.items() if j < 0.8) and all(2 * i in kept for i in range(150))
