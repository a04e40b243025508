"""The star schema seen as listings, events, snapshots and probes: one set of expressions for Spark and for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of a listing as SQL that both dialects read; {event} is the one expression that differs.
LISTING = {
    "listing_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "event_id": "'E' || CAST(l_partkey AS STRING)",
    "source": "CASE WHEN l_returnflag = 'A' THEN 'vividseats' WHEN l_returnflag = 'N' THEN 'stubhub' ELSE 'other' END",
    "artist_or_team": "p_brand",
    "venue_name": "s_name",
    "city": "CASE n_nationkey % 6 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'Las Vegas, NV' WHEN 2 THEN 'Seattle' WHEN 3 THEN 'Toronto' WHEN 4 THEN 'austin, tx ' ELSE n_name END",
    "event_datetime": "{event}",
    "timestamp": "l_shipdate",
    "section": "CASE l_linenumber WHEN 1 THEN 'Floor A' WHEN 2 THEN 'Lower Box 12' WHEN 3 THEN 'Section ' || CAST(l_suppkey % 600 AS STRING) WHEN 4 THEN 'Balcony Left' WHEN 5 THEN 'Mezzanine 212' WHEN 6 THEN 'GA Pit' ELSE 'Parterre ' || CAST(l_suppkey % 10 AS STRING) END",
    "row": "CASE WHEN CAST(l_quantity AS INT) = 1 THEN NULL WHEN CAST(l_quantity AS INT) % 6 = 0 THEN 'GA' WHEN CAST(l_quantity AS INT) % 5 = 0 THEN chr(CAST(65 + CAST(l_quantity AS INT) % 26 AS INT)) WHEN CAST(l_quantity AS INT) % 7 = 0 THEN 'AB' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END",
    "seat_from": "CASE WHEN CAST(l_quantity AS INT) % 4 = 0 THEN NULL WHEN CAST(l_quantity AS INT) % 9 = 0 THEN '*' ELSE CAST(CAST(l_quantity AS INT) * 30 AS STRING) END",
    "seat_to": "CASE WHEN CAST(l_quantity AS INT) % 4 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) * 30 + l_linenumber AS STRING) END",
    "quantity": "CAST(1 + CAST(l_quantity AS INT) % 4 AS INT)",
    "face_value": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE p_retailprice / 10 END",
    "listing_price": "l_extendedprice / 100",
    "event_type": "CASE p_size % 5 WHEN 0 THEN 'concert' WHEN 1 THEN 'sports' WHEN 2 THEN 'theater' WHEN 3 THEN 'comedy' ELSE 'CONCERT' END",
    "days_to_event": "CASE WHEN CAST(l_quantity AS INT) % 11 = 0 THEN NULL ELSE CAST(l_partkey % 97 AS INT) END",
    "venue_capacity": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(1000 + (s_suppkey * 977) % 60000 AS INT) END",
    "is_train": "l_orderkey % 10 < 7",
}
EVENT = {"spark": "timestamp_ntz'1998-01-01 20:00:00' + make_dt_interval(CAST(l_partkey % 1400 AS INT))", "duckdb": "TIMESTAMP '1998-01-01 20:00:00' + to_days(CAST(l_partkey % 1400 AS INTEGER))"}
#: A quote of a zone at a time, from the event stream; probes are rows of the same kind that look up quotes.
SNAPSHOT = {
    "event_id": "'E' || CAST(user_id AS STRING)",
    "seat_zone": "CASE WHEN event_id % 2 = 0 THEN 'lower_tier' ELSE 'upper_tier' END",
    "timestamp": "ts",
    "price_min": "value * 0.5",
    "price_avg": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END",
    "price_max": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 1.5 END",
    "inventory_remaining": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id * 7 % 200 AS INT) END",
    "kind": "event_type",
    "seq": "event_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: unbroadcast_if_large(table(spark, sf_dir, name))
    rows = table(spark, sf_dir, "lineitem").join(t("part"), same("l_partkey", "p_partkey")).join(t("supplier"), same("l_suppkey", "s_suppkey")).join(t("nation"), same("s_nationkey", "n_nationkey"))
    return rows.selectExpr(*[f"{e.replace('{event}', EVENT['spark'])} AS `{n}`" for n, e in LISTING.items()])


def listings_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `listings`, those of an event together: dealt once, as raw columns; windows by event need no other shuffle.

    Parts are joined by the event too, so they are merged into the rows where these lie. Sellers are broadcast or, if
    large, joined before. A partition has some 4 MB of the table's files, so what is sorted in a task stays small.
    """
    from pyspark.sql import functions as F

    lines, parts, sellers, nations = (table(spark, sf_dir, name) for name in ("lineitem", "part", "supplier", "nation"))
    event = lambda key: F.coalesce(F.expr(LISTING["event_id"].replace("l_partkey", key)), F.lit(""))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), file_bytes(lines) // (4 << 20))
    dealt = lambda df: df.where("l_partkey IS NOT NULL").repartition(n, event("l_partkey"))
    sold = lambda df: df.join(broadcast_if_small(sellers), same("l_suppkey", "s_suppkey")).join(broadcast_if_small(nations), same("s_nationkey", "n_nationkey"))
    rows = sold(dealt(lines)) if file_bytes(sellers) <= SMALL else dealt(sold(lines))
    rows = rows.join(unbroadcast_if_large(parts.where("p_partkey IS NOT NULL")), event("l_partkey") == event("p_partkey"))
    return rows.selectExpr(*[f"{e.replace('{event}', EVENT['spark'])} AS `{n}`" for n, e in LISTING.items()])


#: Bytes of files up to which a side is broadcast, whatever the session's own limit.
SMALL = 16 << 20


def file_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A table that is read from files, broadcast in joins if they are small, else merged."""
    return df.hint("broadcast" if file_bytes(df) <= SMALL else "merge")


def unbroadcast_if_large(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """df, merged and never broadcast in joins if its files hold more than most_bytes.

    The optimizer goes by the share of the compressed files that the columns read are estimated at: of a key column alone
    it would collect millions of rows at the driver.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.hint("merge") if size > most_bytes else df


def same(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS `{n}`" for n, e in SNAPSHOT.items()])


LISTINGS_SQL = "listings AS (SELECT " + ", ".join(f'{e.replace("{event}", EVENT["duckdb"])} AS "{n}"' for n, e in LISTING.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
SNAPSHOTS_SQL = "snapshots AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in SNAPSHOT.items()) + " FROM events)"
