"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; sorted by fractional rank (rank + 1/2) / rows of the
source, every stretch of the order holds the sources in their proportions, and cutting it into equal counts gives
shards that all match the mixture. Law: `rows`. Ranks are counted by buckets of the hash (then of the fractional rank),
so no window ever holds a whole source: a source of any size is dealt over all buckets evenly.

The hash is of identifier and text; a row repeated in full so often that its one hash would make a large bucket is dealt
over buckets by its address, so repeated rows don't gather either.

Cases: a null text has no bytes; null sources form one source; null or repeated identifiers are ordinary rows, ordered
by hash, then by address, which tells rows apart that share identifier and text; an empty table gives an empty result.
Copies of a text are ordinary rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import addressed, bucket_bits, fresh, hash_buckets, seeded_hash, source_key, stored, text_or_empty


def _with_rank(rows: DataFrame, keys: list[str], bucket: str, order: list) -> DataFrame:
    """Adds `rank`, from 0, within keys by bucket and order."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return rows.withColumn("_inside", inside).join(counts, [*keys, bucket]).withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside")


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, per_bucket: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty()
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + 8
    at = fresh(docs, "_row")
    # 60 bits of MD5, which SQL engines share, placed so that signed numbers order like them
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), text)
    hashed = F.shiftleft(F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long"), 4).bitwiseXOR(F.lit(-(2**63)))
    rows = addressed(docs, at).select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("src"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hashed.alias("h"), seeded_hash(seed, at).alias("g"))
    rows = stored(rows, "shard-rows")
    per_source = rows.groupBy("src").agg(F.count(F.lit(1)).alias("_rows"))
    total = rows.count()
    bits = bucket_bits(total, per_bucket)
    ties = ["h", "g"]
    ranked = _with_rank(rows.withColumn("bucket", hash_buckets(rows, total, per_bucket)), ["src"], "bucket", ties).join(per_source, "src")
    share = (F.col("rank") * 2 + 1) / (F.col("_rows") * 2).cast("double")
    ranked = ranked.select("doc_id", "size", "text_crc32", "h", "g", "src", share.alias("share")).withColumn("part", F.least(F.floor(F.col("share") * (1 << bits)), F.lit((1 << bits) - 1)).cast("int")).withColumn("all", F.lit(0))
    placed = _with_rank(ranked, ["all"], "part", ["share", "src", *ties])
    placed = placed.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {max(1, total)}L as int)"))
    first = F.expr(f"(shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
