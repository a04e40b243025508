"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from corvane.llm.components import components
from corvane.llm.simhash import STRETCH, Within, candidates, forest, keep_representatives, near_components, similarity, simhash, sketch, shingle_hashes
from tests.llm.test_rows import edge_docs


def brute_print(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family_rows(seed=3):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = pick.choices(words, k=pick.choice([1, 2, 5, 60, 400]))
        for _ in range(pick.choice([1, 3, 8])):
            own = list(base)
            for _ in range(pick.choice([0, 1, 2])):
                own[pick.randrange(len(own))] = pick.choice(words)
            rows.append((n, "  ".join(own).title() if pick.random() < 0.3 else " ".join(own), "s"))
            n += 1
    return rows


@pytest.mark.parametrize("tiles", [{}, {"tile_rows": 7}])
def test_components_equal_brute_force(spark, tiles):
    rows = [*family_rows(), (900, None, "s"), (901, "", "s"), (902, " \t", "s"), (903, "é É x", "s")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_components(edge_docs(spark, rows), **tiles).collect()}
    prints = {d: brute_print(t) for d, t, _ in rows}
    assert {d: f for d, (f, _) in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    assert {d: c for d, (_, c) in got.items()} == brute_components(prints, links)


def test_wide_radius_with_similarity(spark):
    pick = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = pick.choices(words, k=300)
    near = [*base[:150], "x", *base[151:]]
    rows = [(1, " ".join(base), "s"), (2, " ".join(near), "s"), (3, " ".join(pick.choices(words, k=300)), "s"), (None, "alone here", None)]
    docs = edge_docs(spark, rows)
    found = near_components(docs, radius=12, sketch_words=5, min_similarity=0.75)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 1, 3: 3, None: None}
    assert sorted(str(r.doc_id) for r in keep_representatives(docs, found).collect()) == ["1", "3", "None"]


def test_edges(spark):
    docs = edge_docs(spark)
    got = near_components(docs).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id == 5} == {1}
    assert near_components(edge_docs(spark, [])).count() == 0


def test_sketch_estimates_jaccard():
    pick = np.random.default_rng(1)
    a = pick.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:889], pick.integers(0, 2**63, 111).astype(np.uint64)]
    x, y = (np.frombuffer(sketch(v), np.uint8)[None] for v in (a, b))
    assert abs(similarity(x, y)[0] - 889 / 1111) < 0.12 and similarity(x, x)[0] == 1
    assert sketch(np.zeros(0, np.uint64)) == bytes(128)
    assert simhash(shingle_hashes(b"", 3)) == 0


def test_components_of_chains_and_stars(spark):
    pick = random.Random(4)
    ids = pick.sample(range(-1000, 1000), 300)
    links = [(a, b) for a, b in zip(ids[:100], ids[1:100])] + [(ids[150], x) for x in ids[151:220]] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({x for p in links[:-1] for x in p}, links[:-1])
    assert got == want
    x, y = forest(np.array([0, 1, 4]), np.array([1, 2, 3]), 6)
    assert dict(zip(x.tolist(), y.tolist())) == {1: 0, 2: 0, 4: 3}


def five(text):
    own = text.split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def test_pipeline_links_by_exact_jaccard(spark):
    pick = random.Random(11)
    fresh = iter(f"w{i}" for i in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for k in range(120):  # appended blocks that end at 0.8 and just below
        n = pick.choice([60, 200, 1000])
        base = take(n)
        more = (n - 4) // 4
        texts += [base, base + take(more if k % 2 else more + max(1, n // 100))]
    for _ in range(3):  # families around 0.8, where links hang on chains
        base = take(150)
        for _ in range(12):
            at = pick.randrange(1, 150)
            texts.append(base[:at] + take(pick.randrange(8, 24)) + base[at:])
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    sets = [five(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if not sets[i].isdisjoint(sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = brute_components(range(len(rows)), links)
    docs = edge_docs(spark, rows)
    assert sum(d == c for d, c in want.items()) > 100
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == sorted(set(want.values()))


def test_sizes_leave_out_pairs_that_cannot_be_alike(monkeypatch):
    pick = np.random.default_rng(5)
    sizes = np.sort(np.exp(pick.uniform(0, 9, 3000)).astype(np.int64))
    prints = pick.integers(0, 4, 3000).astype(np.uint64)  # all are near each other
    nodes = np.arange(3000)
    tile = (prints, nodes, np.ones((3000, 128), np.uint8), nodes, sizes)
    seen, call = [], Within.__call__
    monkeypatch.setattr(Within, "__call__", lambda self, x, y: seen.append(len(x) * len(y)) or call(self, x, y))
    a, b = candidates(tile, None, 20, 0.65, True, 0.8)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert all((i, j) in got for i in range(0, 3000, 7) for j in range(i + 1, 3000) if sizes[i] >= 0.8 * sizes[j])
    assert sum(seen) < 3000**2 / 4 and STRETCH < 3000
