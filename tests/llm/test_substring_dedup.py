"""Chunking against a byte-by-byte gear hash; planted passages are found, clean texts are left alone."""

import random
from collections import defaultdict

import numpy as np

from corvane.llm.substring_dedup import GEAR, REACH, chunk_ends, repeated_passages
from tests.llm.test_rows import edge_docs


def brute_ends(text, mean, most):
    ends, start = [], 0
    for i in range(len(text)):
        h = 0
        for b in text[max(0, i - REACH + 1) : i + 1]:
            h = ((h << 1) + int(GEAR[b])) % 2**32
        if h < 2**32 // mean or i + 1 == len(text):
            ends += [*range(start + most, i + 1, most), i + 1]
            start = i + 1
    return ends


def test_chunks_equal_a_rolling_hash():
    pick = np.random.default_rng(1)
    texts = [b"", b"a", bytes(pick.integers(97, 120, 3000, dtype=np.uint8)), b"z" * 1000, b"", b"ab" * 700]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = chunk_ends(offsets, np.frombuffer(b"".join(texts), np.uint8), 32, 100).tolist()
    assert got == [o + e for o, t in zip(offsets, texts) for e in brute_ends(t, 32, 100)]


def words(pick, n):
    return " ".join("".join(pick.choices("abcdefghij", k=pick.choice([2, 4, 6, 9]))) for _ in range(n))


def test_planted_passages(spark):
    pick = random.Random(6)
    rows, planted = [], {}
    passages = [words(pick, 70) for _ in range(20)]
    for i in range(200):
        text = words(pick, pick.choice([3, 60, 300]))
        if i < 60:
            body = text.split(" ")
            at = pick.randrange(len(body) + 1)
            text = " ".join([*body[:at], passages[i % 20], *body[at:]])
            planted[i] = text.index(passages[i % 20])
        rows.append((i, text, "s"))
    got = defaultdict(list)
    for r in repeated_passages(edge_docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert set(got) <= set(planted) and len(got) >= 0.97 * len(planted)
    for i, found in got.items():
        for r in found:  # inside the passage but for the rest of a chunk
            assert r.start >= planted[i] and r.end <= planted[i] + len(passages[i % 20])
    kept = defaultdict(int)
    for i, found in got.items():
        kept[i % 20] += any(r.kept for r in found)
    assert all(v == 1 for v in kept.values())


def test_edges(spark):
    docs = edge_docs(spark)
    got = repeated_passages(docs).collect()
    assert {r.doc_id for r in got} <= {10, 11}
    text = words(random.Random(1), 80)
    same = repeated_passages(edge_docs(spark, [(1, text, "s"), (1, text, "s"), (None, text, None), (4, text + text, "s"), (5, None, None)])).collect()
    assert sorted((str(r.doc_id), r.start) for r in same if r.start == 0) == [("1", 0), ("1", 0), ("4", 0), ("None", 0)]
    assert repeated_passages(edge_docs(spark, [])).count() == 0


def test_removals_beside_text_first_seen_here(spark):
    pick = random.Random(9)
    a, b, c, d, e, f, g, h, x = (words(pick, 40) + " " for _ in range(9))
    texts = [a + b + c + d + e + f + g + h, a + b + c + x + e + f + g + h, a + b + c + x + e + f + g + h]
    first, spans = {}, []
    for i, t in enumerate(texts):
        ends = chunk_ends(np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8), 32, 512).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        for s, z in spans[i]:
            first.setdefault(t[s:z], i)
    want = {i: {k for s, z in spans[i] if first[t[s:z]] < i for k in range(s, z)} for i, t in enumerate(texts)}
    assert len(want[1]) > 0.9 * len(a + b + c + e + f + g + h) and len(want[2]) == len(texts[2])
    got = defaultdict(set)
    for r in repeated_passages(edge_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).where("not kept").collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    assert not got[0] and got[1] == want[1] and got[2] == want[2]


def brute_passages(rows, mean=32, most=512, least=112):
    """Passages by hand: every occurrence of every chunk, owners in the order of identifier and text hash."""
    from collections import Counter

    spans, held = [], defaultdict(list)
    for i, (d, t, _) in enumerate(rows):
        raw = (t or "").encode()
        ends = chunk_ends(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), mean, most).tolist() if raw else []
        spans.append(list(zip([0, *ends[:-1]], ends)))
        for s, e in spans[-1]:
            held[raw[s:e]].append((d is None, d or 0, i))
    owner = {c: min(v) for c, v in held.items() if len({x[2] for x in v}) > 1}
    out = Counter()
    for i, (d, t, _) in enumerate(rows):
        raw = (t or "").encode()
        runs = []
        for s, e in spans[i]:
            if raw[s:e] in owner:
                if not runs or runs[-1][-1][1] != s:
                    runs.append([])
                runs[-1].append((s, e, owner[raw[s:e]][2] == i))
        for run in runs:
            if run[-1][1] - run[0][0] < least:
                continue
            parts = []
            for s, e, own in run:
                if parts and parts[-1][3] == own:
                    parts[-1][1], parts[-1][2] = e, parts[-1][2] + 1
                else:
                    parts.append([s, e, 1, own])
            out.update((d, s, e, e - s, n, own) for s, e, n, own in parts)
    return out


def test_equals_brute_force_in_any_order(spark):
    from collections import Counter

    pick = random.Random(21)
    pool = [words(pick, pick.choice([12, 30, 60])) + " " for _ in range(30)]
    rows = [(i if i % 9 else None, "".join(pick.choices(pool, k=pick.choice([1, 2, 5]))) + (words(pick, 50) if i % 2 else "") + (f"{i} " * 40 if i % 9 == 0 else ""), "s") for i in range(70)]
    rows += [(200, rows[3][1], "s"), (200, rows[3][1], "s"), (201, None, "s"), (202, pool[0] * 9, "s")]
    want = None
    for order in (rows, rows[::-1]):
        got = Counter(tuple(r) for r in repeated_passages(edge_docs(spark, order)).select("doc_id", "start", "end", "n_bytes", "n_chunks", "kept").collect())
        if want is None:
            nulls = sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
            assert len(nulls) > 5
            with_id = lambda c: Counter({k: n for k, n in c.items() if k[0] is not None})
            brute = brute_passages(rows)
            # rows without an identifier come last, so they own nothing that a row with one has
            assert with_id(got) == with_id(brute) and sum(got.values()) >= 40
            want = got
        assert got == want


def test_each_repeated_chunk_stays_in_one_document(spark):
    pick = random.Random(4)
    pool = [words(pick, 60) + " " for _ in range(12)]
    rows = [(i, "".join(pick.sample(pool, 4)), "s") for i in range(30)]
    left = defaultdict(set)
    removed = defaultdict(set)
    found = defaultdict(set)
    for r in repeated_passages(edge_docs(spark, rows)).collect():
        found[r.doc_id] |= set(range(r.start, r.end))
        if not r.kept:
            removed[r.doc_id] |= set(range(r.start, r.end))
    for i, t, _ in rows:
        ends = chunk_ends(np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8), 32, 512).tolist()
        for s, e in zip([0, *ends[:-1]], ends):
            if s in found[i]:
                left[t[s:e]] |= {i} - ({i} if s in removed[i] else set())
    assert len(left) > 50 and {len(v) for v in left.values()} == {1}


def test_far_identifiers_and_clashing_columns(spark):
    text = words(random.Random(2), 90)
    docs = spark.createDataFrame([(2**62, text, 1, 1, 1), (-(2**62), text, 1, 1, 1), (None, text, 1, 1, 1)], "doc_id long, text string, rid int, digest int, at int")
    got = {r.doc_id: r.kept for r in repeated_passages(docs).collect()}
    assert got == {2**62: False, -(2**62): True, None: False}
