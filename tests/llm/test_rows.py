"""Exact dedup, sharding and mixing against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from corvane.llm import exact_dedup as ed
from corvane.llm.exact_dedup import exact_dedup, keep_one
from corvane.llm import mixing as mx
from corvane.llm.mixing import choose, fill, min_cost_flow, mix_by_source, mixed, share_targets
from corvane.llm.sharding import shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int, h double, rank string"


def edge_docs(spark, rows=None):
    rows = rows if rows is not None else [
        (1, "a  b", "s1"), (2, "a b", "s1"), (3, None, "s2"), (4, "", None), (5, "a\tb\n", "s1"), (5, "a\tb\n", "s1"), (None, "a b ", "s1"),
        (None, "x", None), (9, "x", "s2"), (10, "é" * 50_000 + " z", "s3"), (11, "b " * 30_000, "s1"), (2, "a b", "s1"), (12, "tie", "S"), (13, "tie", "s"),
    ]
    return spark.createDataFrame([(d, t, "en", s, 0, "x", 1, 0.5, "r") for d, t, s in rows], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("memtable", [3, 50_000])
def test_exact_dedup_brute_force(spark, memtable):
    docs = edge_docs(spark)
    got = [tuple(r) for r in exact_dedup(docs, memtable).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    want = {hashlib.sha256(k.encode()).hexdigest(): (min((x for x in v if x is not None), default=None), v) for k, v in groups.items()}
    assert len(got) == docs.count()
    for sha, (keep, ids) in want.items():
        own = [g for g in got if g[4] == sha]
        assert sorted(str(g[0]) for g in own) == sorted(map(str, ids))
        assert {g[1] for g in own} == {keep} and {g[2] for g in own} == {len(ids)}
        assert [g[0] for g in own if g[3]] == [keep]


def test_exact_dedup_resolves_digest_clashes_by_bytes(spark, monkeypatch):
    docs = edge_docs(spark, [(1, "a", "s"), (2, "b", "s"), (3, "b", "s"), (4, "c", "s")])
    from pyspark.sql import functions as F

    monkeypatch.setattr(ed, "digest_of", lambda norm: F.unhex(F.sha2(F.lit("same"), 256)))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    assert got == {1: (1, 1, True), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True)}


def test_keep_one(spark):
    docs = edge_docs(spark)
    assert keep_one(docs, exact_dedup(docs)).count() == len({norm(r.text) for r in docs.collect()})


@pytest.mark.parametrize("f", [exact_dedup, shard, mix_by_source])
def test_empty_table(spark, f):
    assert f(edge_docs(spark, [])).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shard_law(spark, shards):
    rows = [(i, "w" * (i % 7), "abc"[min(2, i % 6)]) for i in range(500)]
    docs = edge_docs(spark, rows)
    got = shard(docs, shards, per_bucket=16).toPandas()
    assert sorted(got.doc_id) == list(range(500))
    sizes = got.groupby("shard").size()
    assert len(sizes) == shards and sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    text = {d: t for d, t, _ in rows}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got.itertuples(index=False))
    source = {d: s for d, _, s in rows}
    share = got.assign(source=got.doc_id.map(source)).groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert ((share.max() - share.min()) <= 2).all()  # every shard matches the mixture


def test_shard_edges(spark):
    got = shard(edge_docs(spark)).toPandas()
    assert len(got) == 14 and got.groupby("shard").size().max() == 1 and got[got.doc_id == 3]["size"].tolist() == [8]


def test_targets_reshare_the_excess():
    assert share_targets([10, 10, 980], [5, 2, 1]) == [30.0, 30.0, 940.0]
    assert share_targets([0, 5], [5, 2]) == [0.0, 5.0]
    assert share_targets([], []) == []


def test_flow_prefers_first_copies():
    flows = min_cost_flow([(frozenset("a"), 10), (frozenset("ab"), 10), (frozenset("b"), 5)], {"a": 15, "b": 10})
    assert sum(f.get("a", 0) for f in flows) == 15 and sum(f.get("b", 0) for f in flows) == 10
    assert sum(flows[0].values()) == 10 and sum(flows[1].values()) == 10 and sum(flows[2].values()) == 5


def test_fill_is_exact():
    assert sum(s for s, t in zip([7, 5, 4], fill([7, 5, 4], 9)) if t) == 9
    assert fill([], 3) == [] and fill([5], 3) == [False]


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "abcdefghij"[i % 10] if i % 3 else "a") for i in range(900)] + [(1000, None, None), (1001, "x y", None), (1001, "x y", None)]
    got = mix_by_source(edge_docs(spark, rows)).toPandas()
    assert len(got) == 903 and (got.taken <= 3 * got["size"]).all()
    by = got.assign(source=got.doc_id.map({d: s for d, _, s in rows}).fillna("~")).groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all()
    weights = [[5, 2, 1][i % 3] for i in range(len(by))]
    assert by.target.tolist() == pytest.approx(share_targets(by["size"].tolist(), weights))
    assert ((by.taken - by.target).abs() <= 2 + 0.01 * by.target).all()
    again = mix_by_source(edge_docs(spark, rows[::-1])).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def brute_choice(order, room, tail):
    """The rows (key, size) that a prefix of `room` words takes: whole rows in order, then the best of those around its end."""
    at, left = 0, room
    while at < len(order) and order[at][1] <= left:
        left, at = left - order[at][1], at + 1
    back = min(tail // 2, at)
    around = order[at - back : at + tail]
    left += sum(s for _, s in order[at - back : at])
    sums = {0: ()}
    for i, (_, s) in enumerate(around):
        for total, picked in list(sums.items()):
            if total + s <= left and total + s not in sums:
                sums[total + s] = (*picked, i)
    return at - back, max(sums)


@pytest.mark.parametrize("per_bucket", [10, 1000, 100_000])
def test_choice_in_buckets_of_any_size(spark, per_bucket):
    from pyspark.sql import functions as F

    rows = [(i if i % 4 else None, " w" * (1 + i * 37 % 90), "ab"[i % 3 == 0]) for i in range(3000)] + [(7, " w w w", "a")] * 1500
    out, plan = mx.mix(edge_docs(spark, rows).repartition(5), F.array(mx.source_key()), mx.repeating_weights, per_bucket=per_bucket, few=100)
    got = out.toPandas()
    assert len(got) == 4500
    taken = (got.times * got["size"]).groupby(got.pattern).sum()
    for pattern, members, _ in plan["flows"]:
        assert taken[pattern] == round(plan["targets"][members[0]])
    assert got.groupby("pattern").times.agg(lambda t: t.max() - t.min()).max() <= 1


def test_choice_equals_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(i, " w" * (1 + i * 37 % 90), "ab"[i % 3 == 0]) for i in range(700)]
    docs = edge_docs(spark, rows)
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(29), mx.content_hash(docs)).alias("h")).collect()}
    out, plan = mx.mix(docs, F.array(mx.source_key()), mx.repeating_weights, per_bucket=40, tail=8)
    got = {r.doc_id: r for r in out.collect()}
    for pattern, members, flow in plan["flows"]:
        own = sorted((h[d], got[d].size, d) for d in got if got[d].pattern == pattern)
        whole, room = divmod(sum(flow.values()), sum(s for _, s, _ in own))
        begin, best = brute_choice([(k, s) for k, s, _ in own], room, 8)
        extra = [got[d].times - whole for _, _, d in own]
        assert extra[:begin] == [1] * begin and not any(extra[begin + 12 :])
        assert sum(s for (_, s, _), e in zip(own[begin : begin + 12], extra[begin : begin + 12]) if e) == best


def test_fill_with_very_long_texts():
    sizes = [3_000_000, 5, 9, 8_000_000, 2_500_000, 4]
    got = fill(sizes, 5_500_018)
    assert sum(s for s, t in zip(sizes, got) if t) == 5_500_018
    assert choose([5_000_000_000, 3], 4, 48) == [False, True]


def test_mixed_takes_rows_that_differ_elsewhere_for_themselves(spark):
    rows = [(1, "a b c", "s1"), (1, "a b c", "s2"), (2, "d " * 40, "s1"), (2, "d " * 40, "s1"), (3, None, "s2"), (None, "e f", None)]
    docs = edge_docs(spark, rows)
    plan = [(r.doc_id, r.source_size, r.times) for r in mix_by_source(docs).collect()]
    assert mixed(docs).count() == sum(t for _, _, t in plan) and mixed(docs).columns == docs.columns
    clash = docs.withColumnRenamed("rank", "_row").withColumnRenamed("h", "_COPY").withColumnRenamed("run", "_times")
    assert mixed(clash).columns == clash.columns and keep_one(clash, exact_dedup(clash)).columns == clash.columns


def test_keep_one_of_conflicting_rows_is_the_same_in_any_order(spark):
    rows = [(1, "a b", f"s{i}") for i in range(9)] + [(2, "a  b", "s0")]
    kept = [keep_one(d, exact_dedup(d)).collect() for d in (edge_docs(spark, rows), edge_docs(spark, rows[::-1]))]
    assert len(kept[0]) == 1 and kept[0][0].doc_id == 1 and kept[0] == kept[1]


def test_repeated_rows_are_spread_over_buckets(spark):
    from pyspark.sql import functions as F

    from corvane.llm.common import hash_buckets

    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.xxhash64("id")).alias("h"), F.xxhash64("id", F.lit(1)).alias("g")).cache()
    got = rows.select("h", "g", hash_buckets(rows, 9000, 64).alias("b")).toPandas()
    assert got.groupby("b").size().max() < 400 and got.sort_values(["h", "g"]).b.is_monotonic_increasing


def test_shard_order_by_brute_force(spark):
    rows = [(i % 90 if i % 7 else None, "w" * (i % 13), "abc"[i % 5 % 3]) for i in range(300)]
    key = lambda r: hashlib.md5(f"17:{'-' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()[:15]
    ranked = []
    for s in "abc":
        own = sorted((key(r), r) for r in rows if r[2] == s)
        ranked += [((2 * i + 1) / (2 * len(own)), s, h, r) for i, (h, r) in enumerate(own)]
    want = sorted((str(r[0]), len(r[1]) + 8, i * 24 // 300, i - -(-(i * 24 // 300) * 300 // 24)) for i, (_, _, _, r) in enumerate(sorted(ranked, key=lambda x: x[:3])))
    got = shard(edge_docs(spark, rows), per_bucket=8).select("doc_id", "size", "shard", "slot").collect()
    assert sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in got) == want


def test_lookup_through_the_filters_of_the_runs(spark):
    old = edge_docs(spark, [(i, f"text {i % 400}", "s") for i in range(900)])
    new = edge_docs(spark, [(5000 + i, f"text {i * 3}", "s") for i in range(300)] + [(None, "text 7", None), (None, "text 7", None), (6000, None, None)])
    runs = ed.write_runs(old, memtable_rows=50)
    want = sorted((str(5000 + i), i * 3) for i in range(300) if i * 3 < 400) + [("None", 7), ("None", 7)]
    for most in (1 << 26, 0):
        assert sorted((str(r.doc_id), r.keep_id) for r in ed.lookup(runs, new, most).collect()) == sorted(want)
    footers = runs.where("seq = -1").collect()
    assert len(footers) >= 18 and all(bytes(f["digest"]) <= bytes(f["last"]) and f["filter"] for f in footers)


def test_merged_runs_equal_an_aggregation(spark):
    from pyspark.sql import functions as F

    docs = edge_docs(spark, [(i if i % 11 else None, f"t{i * i % 700}", "s") for i in range(3000)] + [(i, f"alone {i}", "s") for i in range(4000, 4500)])
    runs = ed.write_runs(docs, memtable_rows=70, entry_ids=2)
    level = ed.compact(runs, range_entries=100)
    want = runs.where("seq >= 0").groupBy("digest").agg(F.sum("n").alias("n"), F.min("min_id").alias("min_id"))
    got = level.where("filter is null")
    assert sorted(map(str, got.select("digest", "n", "min_id").collect())) == sorted(map(str, want.collect()))
    index = ed.Runs([(bytes(r["digest"]), bytes(r["last"]), bytes(r["filter"])) for r in level.where("filter is not null").collect()])
    for hits, least, most in (("n > 1", 1.0, 1.0), ("n = 1", 0.0, 0.1)):
        import numpy as np

        own = b"".join(bytes(r["digest"]) for r in got.where(hits).collect())
        share = index.covering(np.frombuffer(own, np.uint8)).mean()
        assert least <= share <= most
