"""Information-theoretic sanitisation of personal data, by DataFrame functions alone.

Entities (mail and network addresses, card and phone numbers) are found by patterns; a position is a running sum of the
lengths of what lies between matches and of the matches. A term near an entity may reveal it even when the entity is
masked: over the corpus, the disclosure of entity e by term t is their pointwise mutual information as a share of the
information of e,

    log2(c N / (d_t d_e)) / log2(N / d_e),

with N documents, d_e that hold e, d_t that hold t and c in which t lies within `reach` code points of e. Terms with at
least `support` such documents are generalised from `generalise` on and removed from `remove` on, where they stand near
that entity. With fewer, as near an entity that a single document holds, chance counts for more and the threshold is
`single`; without one they aren't scored. Counts cover all documents. Documents without entities are left alone.

Patterns are written without backtracking (possessive repeats, starts only where a run begins), which finds the same
matches in linear time and no deep recursion on very long texts.

Cases: null text counts as empty; repeated rows and null identifiers are documents of their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns as the contract has them, made possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Up to so many terms near entities are broadcast, so that only they are counted over the corpus.
MOST_TERMS = 500_000
_SPAN = "array<struct<s:int,e:int,v:string>>"


def located(text: Column, pattern: str, least: int = 0, stretch: int = 256) -> Column:
    """All matches with their places in code points: array of (s, e, v), end exclusive. Built in stretches, so that many matches aren't copied once each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    both = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(both) / stretch).cast("int")), lambda k: F.slice(both, k * stretch + 1, F.lit(stretch)))

    def step(held, x):
        s = held["at"] + x["n"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(held["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    def longer(held, part):
        own = F.aggregate(part, F.struct(held["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(held["out"], F.array(own["out"])).alias("out"))

    start = F.struct(F.lit(least).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(parts, start, longer, lambda held: F.flatten(held["out"]))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    own = F.reverse(digits(v))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(own)),
        F.lit(0),
        lambda held, i: held + F.when(i % 2 == 1, F.substring(own, i, F.lit(1)).cast("int")).otherwise((F.substring(own, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(own, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.cast("double") <= 255),
    "card": lambda v: F.when(F.length(digits(v)).between(16, 19), luhn(v)).otherwise(False),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}
#: What a text must hold for a pattern to match at all.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def find(text: Column, kind: str) -> Column:
    spans = F.filter(located(text, PATTERNS[kind]), lambda x: CHECKS[kind](x["v"]))
    return F.when(HINTS[kind](text), spans).otherwise(F.array().cast(_SPAN))


def entity(kind: str, v: Column) -> Column:
    """One name for the ways to write an entity."""
    return F.concat(F.lit(kind + ":"), F.lower(v) if kind == "email" else v if kind == "ip" else digits(v))


def found_in(docs: DataFrame, reach: int, with_text: bool) -> DataFrame:
    """rid, doc_id, the spans of each kind, and mentions with the text around them: in the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(kind, find(F.col("text"), kind))
    text, most = F.col("text"), F.lit(reach)

    def mention(kind):
        def around(x):
            left = F.greatest(x["s"] - most, F.lit(0))
            return F.struct(
                entity(kind, x["v"]).alias("entity"), left.alias("left_at"), x["e"].alias("right_at"), F.substring(text, left + 1, x["s"] - left).alias("left"),
                F.substring(text, x["e"] + 1, most).alias("right"), (x["e"] + most < F.length(text)).alias("cut"),
            )

        return F.transform(F.col(kind), around)

    rows = rows.withColumn("mentions", F.concat(*[mention(k) for k in KINDS]))
    rows = rows.withColumn("masked", F.concat(*[F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS]))
    if not with_text:
        rows = rows.drop("text")
    return stored(rows, "pii-found")


def contexts(found: DataFrame) -> DataFrame:
    """rid, entity, term, s, e: the whole terms near each mention that are no part of an entity."""
    rows = found.where(F.size("mentions") > 0).select("rid", "masked", F.explode("mentions").alias("m"))
    left, right = located(F.col("m.left"), TERM), located(F.col("m.right"), TERM)
    left = F.filter(left, lambda x: (x["s"] > 0) | (F.col("m.left_at") == 0))
    right = F.filter(right, lambda x: ~F.col("m.cut") | (x["e"] < F.length(F.col("m.right"))))

    def moved(spans, by):
        return F.transform(spans, lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), F.lower(x["v"]).alias("term")))

    rows = rows.select("rid", "masked", F.col("m.entity").alias("entity"), F.explode(F.concat(moved(left, F.col("m.left_at")), moved(right, F.col("m.right_at")))).alias("t"))
    rows = rows.where(~F.exists("masked", lambda x: (x["s"] < F.col("t.e")) & (F.col("t.s") < x["e"])))
    return rows.select("rid", "entity", "t.term", "t.s", "t.e")


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, generalise: float, support: int, single: float | None) -> DataFrame:
    """entity, term, disclosure: pairs over the threshold."""
    n = found.count()
    holds = found.select("rid", F.explode(F.array_distinct("mentions.entity")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("d_e"))
    pairs = near.join(holds, "entity").groupBy("entity", "term", "rid").agg(F.first("d_e").alias("d_e")).groupBy("entity", "term").agg(F.first("d_e").alias("d_e"), F.count(F.lit(1)).alias("c"))
    if single is None:
        pairs = pairs.where(F.col("c") >= support)
    pairs = stored(pairs, "pii-pairs")
    wanted = stored(pairs.select("term").distinct(), "pii-terms")
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(TERM), F.lit(0)))).alias("term"))
    if wanted.count() <= MOST_TERMS:  # other terms needn't be counted; where these are too many to broadcast, all are
        terms = terms.join(F.broadcast(wanted), "term", "left_semi")
    terms = terms.groupBy("term").agg(F.count(F.lit(1)).alias("d_t"))
    total = F.lit(float(max(n, 1)))
    share = F.log2(F.col("c") * total / (F.col("d_t") * F.col("d_e"))) / F.log2(total / F.col("d_e"))
    least = F.when(F.col("c") >= support, generalise).otherwise(float("inf") if single is None else single)
    return pairs.where(F.col("d_e") < n).join(terms, "term").select("entity", "term", F.least(share, F.lit(1.0)).alias("disclosure"), least.alias("least")).where(F.col("disclosure") >= F.col("least")).drop("least")


def sanitise(docs: DataFrame, reach: int = 60, support: int = 2, generalise: float = 0.8, remove: float = 0.95, with_text: bool = False, single: float | None = None) -> DataFrame:
    """rid, doc_id, the spans of each kind, terms (s, e, v = what becomes of it), and with_text the text and its sanitised form."""
    found = found_in(docs, reach, with_text)
    near = stored(contexts(found), "pii-near")
    bad = stored(disclosing(docs, found, near, generalise, support, single), "pii-disclosing")
    hits = near.join(bad, ["entity", "term"]).groupBy("rid", "s", "e").agg(F.max("disclosure").alias("disclosure"))
    what = F.when(F.col("disclosure") >= remove, F.lit("removed")).otherwise(F.lit("generalised"))
    hits = hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "e", what.alias("v")))).alias("terms"))
    out = found.drop("mentions", "masked").join(hits, "rid", "left").withColumn("terms", F.coalesce("terms", F.array().cast(_SPAN)))
    return out.withColumn("sanitised", sanitised(F.col("text"))) if with_text else out


def sanitised(text: Column) -> Column:
    """Entities become their kind, generalised terms a class (number or term), removed ones nothing; of overlapping spans the first counts."""
    def named(kind):
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind}]").alias("v")))

    def changed(x):
        word = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["v"] == "removed", F.lit("")).when(word.rlike("^[0-9]+$"), F.lit("[number]")).otherwise(F.lit("[term]")).alias("v"))

    spans = F.sort_array(F.concat(*[named(k) for k in KINDS], F.transform(F.col("terms"), changed)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held, x):
        cut = F.struct(x["e"].alias("at"), F.concat(held["out"], F.substring(text, held["at"] + 1, x["s"] - held["at"]), x["v"]).alias("out"))
        return F.when(x["s"] >= held["at"], cut).otherwise(held)

    return F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text))))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def personal_data(docs: DataFrame, single: float | None = 0.95, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_spans. Every entity is scored, those of one document too."""
    out = sanitise(docs, single=single, **how)
    base = [listed(k, F.col(k)) for k in KINDS]
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.concat_ws(",", F.concat(*base)), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(*base, listed("term", F.col("terms")))).alias("spans"), F.size("terms").cast("long").alias("n_terms"), (sum(F.size(k) for k in KINDS) + F.size("terms")).cast("long").alias("n_spans"),
    )
