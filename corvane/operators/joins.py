"""As-of joins and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars as S


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: str, values: list[str], seq: str | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the values of the last right row not after left_time, by keys (null where none).

    Both sides are put into one stream ordered by time; of equal times the right row with the largest `seq` counts.
    One shuffle by the keys, no inequality join.
    """
    row = F.struct(*left.columns)
    value = F.struct(*values, F.col(right_time).alias("_matched"))
    one = left.select(*keys, S.micros(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"), row.alias("_row"))
    two = right.select(*keys, S.micros(F.col(right_time)).alias("_t"), F.lit(0).alias("_side"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("_seq"), value.alias("_value"))
    both = one.unionByName(two, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_t", "_side", "_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_row is not null")
    return found.select("_row.*", *[F.col(f"_value.{v}").alias(prefix + v) for v in values], F.col("_value._matched").alias(prefix + "matched_at"))


def snapshot_features(listings: DataFrame, snapshots: DataFrame, seq: str | None = None) -> DataFrame:
    """Adds _snap_inv_rate, _snap_trend, _snap_count and _snap_range from the last snapshot of a listing's event and zone.

    The count is of all snapshots of the pair, later ones too; without a snapshot before the listing all four are 0.
    """
    keys = ["event_id", "seat_zone"]
    stats = snapshots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_t0"),
        F.min_by("inventory_remaining", F.when(F.col("inventory_remaining").isNotNull(), F.struct("timestamp", *([seq] if seq else [])))).alias("_inv0"),
        F.min_by("price_avg", F.when(F.col("price_avg").isNotNull(), F.struct("timestamp", *([seq] if seq else [])))).alias("_avg0"),
        F.min_by("price_min", F.when(F.col("price_min").isNotNull(), F.struct("timestamp", *([seq] if seq else [])))).alias("_min0"),
    )
    df = asof(listings, snapshots, keys, F.col("timestamp"), "timestamp", ["price_avg", "price_min", "price_max", "inventory_remaining"], seq, "_s_")
    df = df.join(stats, keys, "left")
    hit = F.col("_s_matched_at").isNotNull()
    hours = F.greatest(S.seconds(F.col("_s_matched_at"), F.col("_t0")) / 3600, F.lit(1.0))
    now, first = F.coalesce("_s_price_avg", "_s_price_min", F.lit(0.0)), F.coalesce("_avg0", "_min0", F.lit(0.0))
    avg = F.coalesce("_s_price_avg", F.lit(0.0))
    made = {
        "_snap_inv_rate": F.coalesce((F.col("_s_inventory_remaining") - F.col("_inv0")) / hours, F.lit(0.0)), "_snap_trend": (now - first) / F.greatest(first, F.lit(1.0)), "_snap_count": F.log1p(F.col("_n").cast("double")),
        "_snap_range": (F.coalesce("_s_price_max", "_s_price_avg", F.lit(0.0)) - F.coalesce("_s_price_min", F.lit(0.0))) / F.greatest(avg, F.lit(1.0)),
    }
    return df.select(*listings.columns, *[F.when(hit, c).otherwise(0.0).alias(n) for n, c in made.items()])


def dimension(fact: DataFrame, dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join of a dimension's columns, with `matched`."""
    return fact.join(dim.select(key, *columns, F.lit(True).alias("_hit")), key, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def outer_keys(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The union of keys with both values, 0 where missing."""
    one, two = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    return one.join(two, key, "full_outer").select(key, F.coalesce("_a", F.lit(0)).alias("now"), F.coalesce("_b", F.lit(0)).alias("baseline"))
