"""Document fingerprints: threshold-scaled sketches, by DataFrame functions alone.

A sketch keeps every hash of a text's five-word shingles below a fixed fraction (1/4) of the hash range, the same for
every text, in ascending order. So sketches of very unequal texts compare as they are, containment is estimated as well
as likeness, and the sketch of a union is the union of the sketches (`merged`). A text of n shingles keeps n / 4 hashes on
average; one of a few words may keep none.

The edited text needs each document's successor by identifier. Documents are dealt into buckets by quantiles of the
identifier, about 2,048 rows each up to 16,384 buckets; an identifier that very many rows share, and rows without one, are
dealt further by a hash of the text. The first document of each bucket is also dealt, as a sentinel, to the bucket before
it, so one shuffle of the texts is enough and no window spans more than a bucket.

Cases: null text counts as empty; a text without words has an empty sketch; two empty sketches are fully alike, an empty
and another one not at all; fewer than five words make one shingle; null identifiers come last, ordered by a hash of
their text; rows that repeat an identifier are ordered by that hash; a single row is its own successor; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, bucket_bits, cut_index, longs, stored, text_or_empty

WORDS = 5
#: Hashes are signed; the lowest quarter of the range.
LIMIT = -(2**63) + 2**62


def with_sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds the sketch of a text column: an ascending array of hashes. The words are a column of their own, so they aren't cut twice."""
    words = f"_{to}_words"
    df = df.withColumn(words, F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))
    at = F.col(words)
    many = F.transform(F.sequence(F.lit(0), F.size(at) - WORDS), lambda i: F.xxhash64(*[F.get(at, i + k) for k in range(WORDS)]))
    hashes = F.when(F.size(at) >= WORDS, many).when(F.size(at) > 0, F.array(F.xxhash64(F.concat_ws(" ", at)))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(to, F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < LIMIT)))).drop(words)


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(a), F.size(b)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    both, x, y = _common(a, b)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(both / (x + y - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    both, x, _ = _common(a, b)
    return F.when(x == 0, F.lit(1.0)).otherwise(both / x)


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.sort_array(F.array_union(a, b))


def as_text(sketch: Column) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def with_successor(rows: DataFrame, per_bucket: int = 2048, most_buckets: int = 16_384) -> tuple[DataFrame, Window]:
    """rows (doc_id, text) dealt to buckets, with sentinels; and the window whose lead is the successor."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    n, ids = rows.agg(F.count(F.lit(1)), F.count("doc_id")).collect()[0]
    buckets = max(1, min(most_buckets, -(-ids // per_bucket)))
    cuts = []
    if buckets > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20 * buckets)).collect()[0][0]
    # an identifier that is two cuts or more has a bucket's rows by itself: its rows are dealt by hash
    many = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    cuts = sorted(set(cuts))
    fine = bucket_bits(n, per_bucket * max(1, len(many)), 14)
    by_hash = F.shiftright("h", 64 - fine) + (1 << (fine - 1))
    place = cut_index(F.col("doc_id"), cuts).cast("long")
    if many:
        own = F.coalesce(F.get(longs(many), cut_index(F.col("doc_id"), many) - 1) == F.col("doc_id"), F.lit(False))
        inside = F.when(own, by_hash).otherwise(F.lit(1 << fine).cast("long"))
    else:
        inside = F.lit(1 << fine).cast("long")
    apart = bucket_bits(n - ids, per_bucket, 14)
    none = F.shiftright("h", 64 - apart) + (1 << (apart - 1))
    width = (1 << fine) + 1
    bucket = F.when(F.col("doc_id").isNull(), none + (len(cuts) + 1) * width).otherwise(place * width + inside)
    rows = rows.withColumn("bucket", bucket)
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("h")]
    heads = rows.groupBy("bucket").agg(F.min(F.struct(order[0].alias("none"), "doc_id", "h")).alias("head"))
    every = Window.orderBy("bucket")  # one row per bucket, about 65,000 at most
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = stored(heads.select("before", F.col("bucket").alias("of"), F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h")), "fingerprint-heads")
    first = rows.join(heads, (rows["bucket"] == heads["of"]) & rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["h"] == heads["head_h"]))
    first = first.select("doc_id", "text", "h", F.col("before").alias("bucket"), F.lit(True).alias("sentinel"))
    dealt = rows.select("doc_id", "text", "h", "bucket", F.lit(False).alias("sentinel")).unionByName(first).repartition("bucket")
    return dealt, Window.partitionBy("bucket").orderBy("sentinel", *order, "text")


def fingerprint(docs: DataFrame, per_bucket: int = 2048) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt, window = with_successor(rows, per_bucket)
    dealt = with_sketch(dealt, "text", "sketch")
    led = dealt.withColumn("next", F.lead("text").over(window)).withColumn("next_sketch", F.lead("sketch").over(window)).where("not sentinel")
    led = led.withColumn("n_chars", F.length("text").cast("long"))
    led = led.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next, int(n_chars div 2)))"))
    led = with_sketch(led.drop("text", "next"), "edited", "edited_sketch")
    return led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
