"""Spans against the plain patterns, disclosure against a direct computation."""

import hashlib
import math
import random
import re
from collections import defaultdict

from corvane.llm.pii import personal_data, sanitise
from tests.llm.test_rows import edge_docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def fuzz(seed, n):
    pick = random.Random(seed)
    bits = ["a.b", "@", "x-y.com", ".", "+", "+49 (0)30 1234-567", "4111 1111 1111 1111", "5500-0000-0000-0004", "1.2.3.4", "256.1.1.1", "0000255.1.2.3", " ", "\n", "é", "日", "9" * 17, "%", "_", "..", "1", "12", "-", "@@", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1((((", "𝒳"]
    return ["".join(pick.choices(bits, k=pick.choice([1, 3, 8, 25]))) for _ in range(n)]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [*fuzz(1, 300), "1 " * 40_000, "a" * 30_000 + "@", "9" * 30_000, "+1" + "(" * 20_000, "x@y.z " * 300, None, ""]
    docs = edge_docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_spans(t)
        r = got[i]
        assert {k: getattr(r, f"n_{k}") for k in PLAIN} == {k: sum(s[0] == k for s in want) for k in PLAIN}, t[:200]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term:")] == [f"{k}:{s}:{e}" for k, s, e, _ in want]


def brute_terms(texts, reach=60, support=2, generalise=0.8, remove=0.95):
    term = re.compile(r"[^\W_]+")
    n = len(texts)
    spans = [plain_spans(t) for t in texts]

    def name(k, v):
        return k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)

    d_e, d_t, c = defaultdict(set), defaultdict(set), defaultdict(set)
    near = []
    for i, t in enumerate(texts):
        words = [(m.start(), m.end(), m[0].lower()) for m in term.finditer(t)]
        for s, e, w in words:
            d_t[w].add(i)
        for k, s, e, v in spans[i]:
            d_e[name(k, v)].add(i)
            for ws, we, w in words:
                if (s - reach <= ws and we <= s or e <= ws and we <= e + reach) and not any(ws < b and a < we for _, a, b, _ in spans[i]):
                    c[name(k, v), w].add(i)
                    near.append((i, name(k, v), w, ws, we))
    out = defaultdict(dict)
    for i, ent, w, s, e in near:
        both = len(c[ent, w])
        if both >= support and len(d_e[ent]) < n:
            share = min(1.0, math.log2(both * n / (len(d_t[w]) * len(d_e[ent]))) / math.log2(n / len(d_e[ent])))
            if share >= generalise:
                out[i][s, e] = max(out[i].get((s, e), "generalised"), "removed" if share >= remove else "generalised")
    return out


def test_terms_equal_brute_force_and_stay_near_entities(spark):
    pick = random.Random(5)
    common = ["and", "the", "of", "near", "to", "is"]
    texts = []
    for i in range(200):
        body = pick.choices(common, k=30)
        if i % 20 == 0:
            body[10:12] = ["Zorvath", "ceo", "mail", "boss@corp.example", "suite", "4711"]
        elif i % 20 == 7:
            body[3:4] = ["call", "+49 30 1234567", "Quillon"]
        elif i % 20 == 9:
            body[5:6] = ["Zorvath"] if i < 40 else ["call"]
        texts.append(" ".join(body))
    docs = edge_docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    want = brute_terms(texts)
    got = {r.doc_id: {(x.s, x.e): x.v for x in r.terms} for r in sanitise(docs).select("doc_id", "terms").collect()}
    assert {i: t for i, t in got.items() if t} == want and want
    assert all(plain_spans(texts[i]) for i in want)
    made = {r.doc_id: r.sanitised for r in sanitise(docs, with_text=True).collect()}
    assert "boss@" not in made[0] and "[email]" in made[0] and "Zorvath" not in made[0] and made[9] == texts[9]


def test_edges_and_plan(spark):
    docs = edge_docs(spark)
    assert personal_data(docs).count() == docs.count() and personal_data(edge_docs(spark, [])).count() == 0
    same = edge_docs(spark, [(1, "a@b.cd x", None), (1, "a@b.cd x", None), (None, "a@b.cd x", None)])
    assert [r.n_email for r in personal_data(same).collect()] == [1, 1, 1]
    plan = personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_entities_of_one_document_are_scored(spark):
    pick = random.Random(7)
    texts = [" ".join(pick.choices(["and", "the", "of", "near", "to", "is"], k=30)) for _ in range(200)]
    texts[3] = "the and Xanthor writes from solo@one.example to the " + texts[3]
    texts[4] = "writes " + texts[4]
    got = {r.doc_id: r for r in personal_data(edge_docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    terms = {texts[i][int(s) : int(e)] for i, r in got.items() for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
    assert terms == {"Xanthor", "from"} and got[3].n_terms == 2


def test_many_matches_and_clashing_columns(spark):
    from corvane.llm.pii import personal_data

    text = " ".join(f"a{i}@b.cd" for i in range(1500))
    docs = spark.createDataFrame([(1, text, "x", 1), (2, None, "y", 2), (2, "+49 30 1234567", "z", 3)], "doc_id long, text string, term string, entity int")
    got = {(r.doc_id, r.n_email, r.n_phone): r for r in personal_data(docs).collect()}
    assert set(got) == {(1, 1500, 0), (2, 0, 0), (2, 0, 1)}
    spans, at = [], 0
    for i in range(1500):
        word = f"a{i}@b.cd"
        spans.append(f"email:{at}:{at + len(word)}")
        at += len(word) + 1
    assert got[1, 1500, 0].spans.startswith(",".join(spans)) and got[1, 1500, 0].n_spans >= 1500
