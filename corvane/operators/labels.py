"""Sale labels: runs of absence, depletion of inventory, and the features beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators.joins import asof


def before_event(df: DataFrame) -> DataFrame:
    return df.where("timestamp < event_datetime")


def listing_stability(df: DataFrame) -> DataFrame:
    """One row: identifiers, those seen at two times or more, and their share."""
    per = df.groupBy("listing_id").agg(F.count_distinct("timestamp").alias("times"))
    return per.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("times") >= 2).alias("n_stable")).withColumn("stability", F.when(F.col("n_ids") > 0, F.col("n_stable") / F.col("n_ids")).otherwise(0.0))


def absence_labels(df: DataFrame, window_hours: float = 24, absent: int = 2, least_scrapes: int = 5) -> DataFrame:
    """sold, hours_until_disappearance: 1 if a listing misses `absent` scrapes of its event in a row within the window.

    Scrapes of an event are numbered; a gap behind a sighting is the distance to the next one. From each sighting on, the
    first gap that is long enough decides, so windows over (event, listing) replace a join over time ranges.
    """
    df = before_event(df).where("event_id is not null and listing_id is not null")
    scrapes = df.select("event_id", "timestamp").distinct().withColumn("r", F.row_number().over(W.partitionBy("event_id").orderBy("timestamp")))
    scrapes = scrapes.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("event_id"))).withColumn("last", F.max("timestamp").over(W.partitionBy("event_id"))).where(F.col("n") >= least_scrapes)
    after = W.partitionBy("event_id").orderBy("r")
    scrapes = scrapes.withColumn("t1", F.lead("timestamp", 1).over(after)).withColumn("tk", F.lead("timestamp", absent).over(after))
    seen = df.select("event_id", "listing_id", "timestamp").distinct().join(scrapes, ["event_id", "timestamp"])
    own = W.partitionBy("event_id", "listing_id").orderBy("r")
    seen = seen.withColumn("gap", F.coalesce(F.lead("r").over(own), F.col("n") + 1) - F.col("r") - 1)
    run = F.when(F.col("gap") >= absent, F.struct("t1", "tk"))
    seen = seen.withColumn("run", F.first(run, ignorenulls=True).over(own.rowsBetween(W.currentRow, W.unboundedFollowing)))
    labelled = df.join(seen.select("event_id", "listing_id", "timestamp", "last", "run"), ["event_id", "listing_id", "timestamp"])
    t = F.col("timestamp")
    inside = S.seconds(F.col("last"), t) >= window_hours * 3600
    sold = F.coalesce(S.seconds(F.col("run.tk"), t) <= window_hours * 3600, F.lit(False))
    return labelled.where(inside).withColumn("sold", sold.cast("int")).withColumn("hours_until_disappearance", F.when(sold, S.seconds(F.col("run.t1"), t) / 3600)).drop("last", "run")


def depletion_labels(listings: DataFrame, snapshots: DataFrame, window_hours: int = 48, threshold: float = 0.3, least_snapshots: int = 5, seq: str | None = None) -> DataFrame:
    """sold: 1 if an event's inventory falls by more than `threshold` from a listing's time to `window_hours` later."""
    total = snapshots.where("inventory_remaining is not null").groupBy("event_id", "timestamp").agg(F.sum("inventory_remaining").alias("inventory"))
    enough = total.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_snapshots).select("event_id")
    total = total.join(enough, "event_id", "left_semi")
    df = before_event(listings) if "event_datetime" in listings.columns else listings
    df = df.join(enough, "event_id", "left_semi")
    df = asof(df, total, ["event_id"], F.col("timestamp"), "timestamp", ["inventory"], prefix="now_")
    later = F.col("timestamp") + F.expr(f"make_dt_interval(0, {window_hours})")
    df = asof(df, total, ["event_id"], later, "timestamp", ["inventory"], prefix="later_")
    a, b = F.col("now_inventory"), F.col("later_inventory")
    df = df.where(a.isNotNull() & b.isNotNull()).withColumn("depletion", F.when(a <= 0, 0.0).otherwise((a - b) / a))
    return df.withColumn("sold", (F.col("depletion") > threshold).cast("int")).select(*listings.columns, "depletion", "sold")


def sale_features(df: DataFrame, train: DataFrame, keys: list[str], predicted: str | None = None) -> DataFrame:
    """price_z and price_to_median against training groups, price_to_predicted."""
    stats = train.groupBy(*keys).agg(F.median("listing_price").alias("_median"), F.stddev_samp("listing_price").alias("_std"))
    out = df.join(stats, keys, "left")
    p = F.col("listing_price")
    out = out.withColumn("price_z", F.when(F.col("_std") > 0, (p - F.col("_median")) / F.col("_std")).otherwise(0.0)).withColumn("price_to_median", F.when(F.col("_median") > 0, p / F.col("_median")).otherwise(1.0))
    if predicted:
        out = out.withColumn("price_to_predicted", F.when(F.col(predicted) > 0, p / F.col(predicted)).otherwise(1.0))
    return out.drop("_median", "_std")
