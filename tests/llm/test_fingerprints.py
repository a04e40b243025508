"""Sketches against exact shingle sets, and successors against a sorted list."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import fingerprints as fp
from tests.llm.test_rows import edge_docs

MASK = 2**64 - 1


def chained(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - 2**64 if seed >> 63 else seed


def brute_sketch(text):
    words = text.lower().split(" ") if text.strip() else []
    words = [w for w in words if w]
    if not words:
        return []
    shingles = {chained(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {chained([" ".join(words)])}
    return sorted(h for h in shingles if h < fp.LIMIT)


def rows_of(n, seed=2):
    pick = random.Random(seed)
    words = [f"word{i}" for i in range(50)]
    return [(i * 37 % 1009, " ".join(pick.choices(words, k=pick.choice([0, 1, 4, 5, 30, 3000]))), "s") for i in range(n)]


@pytest.mark.parametrize("per_bucket", [1, 4, 2048])
def test_brute_force(spark, per_bucket):
    rows = rows_of(60)
    got = {r.doc_id: r for r in fp.fingerprint(edge_docs(spark, rows), per_bucket).collect()}
    ordered = sorted(rows)
    assert len(got) == 60
    for (d, text, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h & MASK:016x}" for h in brute_sketch(text))
        assert r.edited_fingerprint == "".join(f"{h & MASK:016x}" for h in brute_sketch(edited))


def exact(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y), len(x & y) / len(x)


def test_likeness_containment_and_merging(spark):
    pick = random.Random(9)
    long = [f"v{pick.randrange(10**6)}" for _ in range(12_000)]
    cases = [(" ".join(long), " ".join(long[:6000])), (" ".join(long[:700]), " ".join(long)), (" ".join(long[:100]), " ".join(long[:90])), (" ".join(long[:300]), " ".join(long[150:450]))]
    df = spark.createDataFrame([(i, a, b, a + " | | | | " + b) for i, (a, b) in enumerate(cases)], "i int, a string, b string, both string")
    for c in ("a", "b", "both"):
        df = fp.with_sketch(df, c, f"s_{c}")
    a, b = F.col("s_a"), F.col("s_b")
    got = df.select("i", fp.likeness(a, b).alias("likeness"), fp.containment(a, b).alias("inside"), fp.likeness(fp.merged(a, b), F.col("s_both")).alias("union")).orderBy("i").collect()
    for r, (x, y) in zip(got, cases):
        j, c = exact(x, y)
        assert r.likeness == pytest.approx(j, abs=0.15) and r.inside == pytest.approx(c, abs=0.2) and r.union > 0.85


def test_edges(spark):
    docs = edge_docs(spark)
    got = fp.fingerprint(docs).collect()
    assert len(got) == docs.count()
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert [r.near_next for r in got if r.doc_id == 3] == [1.0]  # two empty texts
    alone = fp.fingerprint(edge_docs(spark, [(7, "a b c d e f", None)])).collect()
    assert [(r.near_next, r.n_chars) for r in alone] == [(1.0, 11)]
    assert fp.fingerprint(edge_docs(spark, [])).count() == 0
    nulls = fp.fingerprint(edge_docs(spark, [(None, f"t{i}", None) for i in range(9)])).collect()
    assert len(nulls) == 9


def test_no_python_in_the_plan(spark):
    plan = fp.fingerprint(edge_docs(spark, rows_of(5)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_far_and_repeated_identifiers(spark):
    pick = random.Random(5)
    text = lambda: " ".join(pick.choices([f"w{i}" for i in range(99)], k=30))
    rows = [(i, text(), "s") for i in range(400)] + [(2**60, text(), "s"), (-(2**61), text(), "s")] + [(77, text(), "s") for _ in range(300)] + [(None, text(), None) for _ in range(200)]
    docs = edge_docs(spark, rows)
    dealt, window = fp.with_successor(docs.select("doc_id", "text"), 16)
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert max(sizes) <= 100  # neither the far identifiers nor the repeated one gathers rows
    led = dealt.withColumn("next", F.lead("text").over(window)).where("not sentinel").collect()
    assert len(led) == len(rows) and all(r["next"] is not None for r in led)
    after = {}
    for r in led:
        after.setdefault(r["text"], []).append(r["next"])
    chain, seen = led[0]["text"], 0
    while after.get(chain):  # successors make one ring through all rows
        chain, seen = after[chain].pop(), seen + 1
    assert seen == len(rows)
    ids = {t: d for d, t, _ in rows}
    order = [ids[r["next"]] for r in led if r["doc_id"] == 76]
    assert order == [77]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "b", 1, 2, 3)], "doc_id long, text string, h int, bucket int, sketch int")
    assert fp.fingerprint(docs).count() == 2
