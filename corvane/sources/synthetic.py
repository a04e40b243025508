"""Price trajectories of past concerts: zones by days before the event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalars import SYNTHETIC_ZONE_RATIO

#: Fixed value: days before the event at which a price is made.
DAYS = [90, 60, 30, 14, 7, 3, 1, 0]


def time_factor(days: Column, demand: Column) -> Column:
    """1 until 60 days before, then in four slopes to the demand multiplier."""
    return (
        F.when(days > 60, 1.0).when(days > 30, 1.0 + 0.2 * (60 - days) / 30).when(days > 14, 1.2 + 0.3 * (30 - days) / 16)
        .when(days > 7, 1.5 + 0.3 * (14 - days) / 7).otherwise(1.8 + (demand - 1.8) * (7 - days) / 7)
    )


def trajectories(concerts: DataFrame, volatility: float = 0.1, seed: int = 42) -> DataFrame:
    """concerts (event_id, low, high, demand, popularity, event_date) to snapshots of four zones and eight days."""
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(r).alias("ratio")) for z, r in SYNTHETIC_ZONE_RATIO.items()])
    rows = concerts.withColumn("z", F.explode(zones)).withColumn("days_to_event", F.explode(F.array(*[F.lit(d) for d in DAYS])))
    noise = 1 + (F.rand(seed) * 2 - 1) * volatility if volatility else F.lit(1.0)
    price = (F.col("low") + (F.col("high") - F.col("low")) * F.col("z.ratio")) * time_factor(F.col("days_to_event"), F.col("demand")) * (1 + F.col("popularity") * 0.5) * noise
    rows = rows.withColumn("price_avg", price)
    return rows.select(F.concat(F.lit("syn_"), "event_id").alias("event_id"), F.col("z.zone").alias("seat_zone"), F.expr("event_date - make_dt_interval(days_to_event)").alias("timestamp"), (F.col("price_avg") * 0.9).alias("price_min"), "price_avg", (F.col("price_avg") * 1.1).alias("price_max"), "days_to_event")
