"""Cold-start estimates, prediction columns and value ranking: batch expressions, no row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars as S

# Default prices of zones, multipliers, and names that tell a category.
ZONE_PRICE = {"floor_vip": 450.0, "lower_tier": 250.0, "upper_tier": 150.0, "balcony": 75.0}
TIER_FACTOR = {"high": 2.5, "medium": 1.5, "low": 1.0}
CITY_FACTOR = {1: 1.2, 2: 1.0, 3: 0.8}
TYPE_FACTOR = {"CONCERT": 1.0, "SPORTS": 0.9, "THEATER": 1.1, "COMEDY": 1.0}
CATEGORY = [
    (2.5, ["blackpink", "bts", "twice", "stray kids", "aespa", "newjeans", "seventeen", "nct", "exo", "red velvet", "itzy", "ive", "le sserafim"]),
    (2.0, ["taylor swift", "beyonce", "coldplay", "ed sheeran", "eagles", "the weeknd", "drake", "bad bunny", "harry styles", "adele", "bruno mars", "lady gaga", "billie eilish", "post malone"]),
    (1.5, ["morgan wallen", "zach bryan", "luke combs", "chris stapleton", "kenny chesney", "jason aldean", "thomas rhett", "carrie underwood"]),
]


def mapped(key: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def category_factor(artist: Column) -> Column:
    a = S.folded(artist)
    out = None
    for factor, names in CATEGORY:
        hit = S.any_in(a, names)
        out = F.when(hit, factor) if out is None else out.when(hit, factor)
    return out.otherwise(1.0)


def cold_start(df: DataFrame, history: DataFrame | None = None, tiers: DataFrame | None = None) -> DataFrame:
    """Four rows per input row: zone, estimate, confidence, source. history (artist, zone, price), tiers (artist, tier)."""
    df = df.withColumn("_artist", S.folded(F.col("artist_or_team")))
    if tiers is not None:
        df = df.join(tiers.select(S.folded(F.col("artist")).alias("_artist"), F.col("tier").alias("_tier")), "_artist", "left")
    else:
        df = df.withColumn("_tier", F.lit(None).cast("string"))
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in TIER_FACTOR.items() for x in kv])[F.col("_tier")], category_factor(F.col("artist_or_team")))
    total = factor * mapped(F.col("city_tier"), CITY_FACTOR, 1.0) * mapped(F.col("event_type"), TYPE_FACTOR, 1.0)
    zones = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(p).alias("p")) for z, p in ZONE_PRICE.items()]))
    df = df.withColumn("_total", total).withColumn("_zp", zones).withColumn("zone", F.col("_zp.z"))
    estimate, confidence = F.col("_zp.p") * F.col("_total"), F.when(F.col("_tier").isNotNull(), 0.4).otherwise(0.3)
    source = F.when(F.col("_tier").isNotNull(), "heuristic_popularity_service").otherwise("heuristic_keyword_fallback")
    if history is not None:
        own = history.select(S.folded(F.col("artist")).alias("_artist"), "zone", F.col("price").alias("_past"))
        known = own.select("_artist").distinct().withColumn("_known", F.lit(True))
        df = df.join(own, ["_artist", "zone"], "left").join(known, "_artist", "left")
        estimate, confidence, source = F.when(F.col("_known"), F.col("_past")).otherwise(estimate), F.when(F.col("_known"), 0.7).otherwise(confidence), F.when(F.col("_known"), "performer_history").otherwise(source)
    return df.withColumns({"estimate": estimate, "confidence": confidence, "estimate_source": source}).drop("_artist", "_tier", "_total", "_zp", "_past", "_known")


def with_bounds(df: DataFrame, predicted: str = "predicted", baseline: str = "baseline", low: str | None = None, high: str | None = None) -> DataFrame:
    """Bounds (15 % without quantile columns), confidence, direction against a baseline (5 %) and its probability."""
    p, b = F.col(predicted), F.col(baseline)
    a, z = F.col(low) if low else p * 0.85, F.col(high) if high else p * 1.15
    sure = F.when(p > 0, S.clip(1 - F.least((z - a) / p, F.lit(1.0)), 0.0, 1.0)).otherwise(0.5)
    way = F.when(p > b * 1.05, "UP").when(p < b * 0.95, "DOWN").otherwise("STABLE")
    chance = F.when(way == "STABLE", 0.6).otherwise(F.least(F.lit(0.9), 0.5 + F.abs(p - b) / b))
    return df.withColumns({"price_lower_bound": a, "price_upper_bound": z, "confidence_score": sure, "predicted_direction": way, "direction_probability": chance})


def rank_by_value(df: DataFrame, known_events: DataFrame | None = None, position: str = "listing_id", within: str | None = None) -> DataFrame:
    """Listings by predicted / price, best first. Prices of 0 and less and unknown events are left out."""
    df = df.where("listing_price > 0")
    if known_events is not None:
        df = df.join(known_events.select("event_id").distinct(), "event_id", "left_semi")
    df = df.withColumn("value_score", F.col("predicted") / F.col("listing_price")).withColumn("savings_estimate", F.col("predicted") - F.col("listing_price"))
    order = (W.partitionBy(within) if within else W).orderBy(F.desc("value_score"), position)
    return df.withColumn("rank", F.row_number().over(order))
