"""Partitioned storage: idempotent appends, filtered reads, and small views of listings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions import scalars as S


def read(spark: SparkSession, path: str, schema: StructType, *conditions: Column) -> DataFrame:
    """A parquet table with a fixed schema; a missing path is an empty table, files that lack columns give nulls."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    out = spark.read.option("basePath", path).schema(schema).parquet(path)
    for c in conditions:
        out = out.where(c)
    return out


def dated(df: DataFrame, time: str = "timestamp", days: bool = True) -> DataFrame:
    """year, month (and day) as zero-padded strings, the names of the partition folders."""
    out = df.withColumn("year", F.date_format(time, "yyyy")).withColumn("month", F.date_format(time, "MM"))
    return out.withColumn("day", F.date_format(time, "dd")) if days else out


def append(df: DataFrame, path: str, time: str = "timestamp", days: bool = True) -> None:
    """Adds files to the partitions of the rows; existing files aren't read or rewritten."""
    dated(df, time, days).write.mode("append").partitionBy("year", "month", *(["day"] if days else [])).parquet(path)


def time_partitions(start: str | None, end: str | None) -> Column:
    """A condition on the partition columns that a time range implies."""
    key = F.concat_ws("-", "year", "month", "day")
    out = F.lit(True)
    if start:
        out = out & (key >= start[:10])
    if end:
        out = out & (key <= end[:10])
    return out


def after_watermark(df: DataFrame, mark: str) -> DataFrame:
    """Rows of partitions behind a `Y/M/D` mark."""
    return df.where(F.concat_ws("/", "year", "month", "day") > mark)


def listing_hash() -> Column:
    """md5 of event, section, row, seats, source and price to the cent; missing parts are empty."""
    text = lambda c: F.coalesce(S.folded(F.col(c)), F.lit(""))
    seat = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = S.cents(F.col("listing_price"))
    price = F.concat(F.floor(whole / 100).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))
    return F.md5(F.concat_ws("|", F.coalesce("event_id", F.lit("")), text("section"), text("row"), seat("seat_from"), seat("seat_to"), text("source"), F.coalesce(price, F.lit(""))).cast("binary"))


def unseen(batch: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """The first row of each hash of the batch that isn't stored yet."""
    fresh = batch.withColumn("hash", listing_hash())
    first = F.min_by(F.struct(*batch.columns), order).alias("r")
    fresh = fresh.groupBy("hash").agg(first)
    return fresh.join(stored.select(listing_hash().alias("hash")).distinct(), "hash", "left_anti").select("r.*")


def append_new(spark: SparkSession, batch: DataFrame, path: str, order: str = "listing_id") -> DataFrame:
    """Idempotent append: data are written, and hashes always follow from the data, so a crash loses nothing."""
    new = unseen(batch, read(spark, path, batch.schema), order)
    append(new, path)
    return new


def insert_events(new: DataFrame, stored: DataFrame) -> DataFrame:
    return new.join(stored.select("event_id").distinct(), "event_id", "left_anti")


def as_rows(df: DataFrame) -> DataFrame:
    """Rows as they are stored: times without a zone are taken as UTC (the session's zone must be UTC)."""
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def event(stored: DataFrame, event_id: str) -> DataFrame:
    """The event of that identifier (no row if there is none; of repeated ones the earliest date, then the least name)."""
    order = [c for c in ("event_datetime", "artist_or_team", "venue_name") if c in stored.columns]
    return stored.where(F.col("event_id") == event_id).orderBy(*order).limit(1)


def event_ids(stored: DataFrame, distinct: bool = False) -> DataFrame:
    """Identifiers of the stored rows, one a row, or each once."""
    out = stored.select("event_id")
    return out.distinct() if distinct else out


SNAPSHOT_COLUMNS = {"event_id": "string", "seat_zone": "string", "timestamp": "timestamp_ntz", "price_min": "double", "price_avg": "double", "price_max": "double", "inventory_remaining": "int", "days_to_event": "int"}


def load_snapshots(df: DataFrame) -> DataFrame:
    """The columns of a snapshot and no others; those that are missing are null. Joins to listings follow a split."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SNAPSHOT_COLUMNS.items()])


def config_lists(spark: SparkSession, path: str, default: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Lists of a small JSON configuration (an object of lists, or one list under the name ""), without keys that begin with `_`.

    A missing file gives the default. Read by Spark, so the path may be in any store it reaches; the file is one row.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return dict(default or {})
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    found = found if isinstance(found, dict) else {"": found}
    return {k: v for k, v in found.items() if not k.startswith("_")}


def config_words(spark: SparkSession, path: str, default: list[str] | None = None) -> list[str]:
    """The words of a configuration, in lower case and in order."""
    return [w.lower() for words in config_lists(spark, path, {"": default or []}).values() for w in words]


def events(listings: DataFrame) -> DataFrame:
    """One row per event of a listing table."""
    return listings.groupBy("event_id").agg(*[F.min(c).alias(c) for c in ("event_type", "event_datetime", "artist_or_team")], F.min("venue_name").alias("venue_name"), F.min("city").alias("city"))


def latest(df: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """The newest row of each key; of equal times the one with the smallest seq."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(time, -F.col(seq))).alias("r")).select(*keys, "r.*")


def listings_between(df: DataFrame, event: str | None = None, section: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive price range (0 counts as unset), newest first."""
    for column, value in (("event_id", event), ("section", section)):
        if value:
            df = df.where(F.col(column) == value)
    if low:
        df = df.where(F.col("listing_price") >= low)
    if high:
        df = df.where(F.col("listing_price") <= high)
    return df.orderBy(F.desc("timestamp"))


def price_history(df: DataFrame, event: str, section: str | None = None, row: str | None = None) -> DataFrame:
    df = df.where(F.col("event_id") == event)
    for column, value in (("section", section), ("row", row)):
        if value:
            df = df.where(F.col(column) == value)
    return df.orderBy("timestamp")


def zone_snapshots(df: DataFrame) -> DataFrame:
    """Prices and places of each event, zone and time of collection."""
    p = F.col("listing_price")
    return df.groupBy("event_id", S.zone(F.col("section")).alias("seat_zone"), "timestamp").agg(F.min(p).alias("price_min"), F.avg(p).alias("price_avg"), F.max(p).alias("price_max"), F.sum("quantity").alias("inventory_remaining"))


def seat_description() -> Column:
    place = F.concat(F.lit("Section "), F.col("section"), F.lit(", Row "), F.coalesce("row", F.lit("")))
    one = F.col("seat_to").isNull() | (F.col("seat_from") == F.col("seat_to"))
    return F.when(F.col("seat_from").isNull(), place).when(one, F.concat(place, F.lit(", Seat "), F.col("seat_from"))).otherwise(F.concat(place, F.lit(", Seats "), F.col("seat_from"), F.lit("-"), F.col("seat_to")))


def popularity_counts(part: DataFrame) -> DataFrame:
    """Counts of artists as a static table would hold them, made of part statistics."""
    return part.where("p_brand <> 'Brand#3'").groupBy(F.col("p_brand").alias("artist")).agg(
        F.max(F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") * 10_000)).alias("youtube_subscribers"), F.max(F.when(F.col("p_size") < 48, F.col("p_partkey") * 1_000_000)).alias("youtube_views"),
        F.min(F.when(F.col("p_size") > 3, F.col("p_partkey") * 1000)).alias("lastfm_listeners"), F.max(F.col("p_size") * 100_000).alias("lastfm_play_count"),
    )


def unexpired(cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return cache.where(F.col("cached_at") > now - F.expr(f"make_dt_interval(0, {hours})"))


def numbered(df: DataFrame, order: list) -> DataFrame:
    return df.withColumn("row_id", F.row_number().over(W.orderBy(*order)))
