"""Structured Streaming versions of ingestion, dedup, snapshots, labels and enrichment.

Lateness: rows older than the watermark are dropped by the stateful jobs here, unlike the batch path, which keeps any
timestamp. `append_exactly` has no such bound: it compares with what is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corvane.functions import scalars as S
from corvane.operators.joins import asof
from corvane.sources import store


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Works off what the source holds now, exactly once into parquet files, and reads them."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def distinct_listings(stream: DataFrame, keys: list[str], time: str = "timestamp", late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_exactly(stream: DataFrame, path: str, checkpoint: str, order: str = "listing_id") -> None:
    """Each micro-batch appends what isn't stored yet; a batch that runs again finds its rows there."""

    def write(batch: DataFrame, _: int) -> None:
        store.append_new(batch.sparkSession, batch, path, order)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def zone_snapshots(stream: DataFrame, time: str = "timestamp", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling windows by event and zone; `n` rows each."""
    p = F.col("listing_price")
    zone = F.col("seat_zone") if "seat_zone" in stream.columns else S.zone(F.col("section"))
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_id", zone.alias("seat_zone"))
    return rows.agg(F.min(p).alias("price_min"), F.max(p).alias("price_max"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_id", "seat_zone", "price_min", "price_max", "n")


def anchored_dedup(stream: DataFrame, keys: list[str], time: str = "timestamp", hours: float = 6.0, late: str = "1 day") -> DataFrame:
    """Rows kept: the first of a key, then the first that is `hours` behind the last kept one. State: one time per key."""
    limit = pd.Timedelta(hours=hours)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)) if not state.hasTimedOut else None
        if rows is None:
            state.remove()
            return
        rows = rows.sort_values(time, kind="stable")
        anchor = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        kept = []
        for i, at in enumerate(rows[time]):
            if anchor is None or at - anchor >= limit:
                anchor = at
                kept.append(i)
        state.update((int(anchor.value // 1000),))
        state.setTimeoutTimestamp(max(int(anchor.value // 1_000_000 + limit.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept]

    return stream.withWatermark(time, late).groupBy(*keys).applyInPandasWithState(keep, stream.schema, "anchor long", "append", GroupStateTimeout.EventTimeTimeout)


def disappearances(stream: DataFrame, absent: int = 2, time: str = "timestamp", late: str = "1 day") -> DataFrame:
    """(event_id, listing_id, last_seen, missed_at): a listing misses `absent` scrapes of its event in a row.

    State: the listings of an event that are still there, with the time last seen and the scrapes missed since.
    """
    schema = "event_id string, listing_id string, last_seen timestamp, missed_at timestamp"
    held = "ids array<string>, seen array<long>, missed array<int>, first array<long>"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = {i: [s, m, f] for i, s, m, f in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        for at, own in sorted(pd.concat(list(batches)).groupby(time)):
            us = int(at.value // 1000)
            here = set(own["listing_id"])
            for i in here:
                live[i] = [us, 0, 0]
            for i in [i for i in live if i not in here]:
                live[i][1] += 1
                live[i][2] = live[i][2] or us
                if live[i][1] >= absent:
                    seen, _, first = live.pop(i)
                    out.append((key[0], i, pd.Timestamp(seen, unit="us"), pd.Timestamp(first, unit="us")))
        state.update((list(live), [v[0] for v in live.values()], [v[1] for v in live.values()], [v[2] for v in live.values()]))
        yield pd.DataFrame(out, columns=["event_id", "listing_id", "last_seen", "missed_at"])

    return stream.withWatermark(time, late).groupBy("event_id").applyInPandasWithState(follow, schema, held, "append", GroupStateTimeout.NoTimeout)


def enriched(stream: DataFrame, quotes: DataFrame, keys: list[str], values: list[str], out: str, checkpoint: str, time: str = "timestamp", seq: str | None = None) -> None:
    """Each micro-batch joined as of its time with a static table of quotes."""

    def write(batch: DataFrame, _: int) -> None:
        asof(batch, quotes, keys, F.col(time), time, values, seq, "quote_").write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
