"""The catalogue: one query per operator over the canonical views. `oracle` holds the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import cleaning, collect, evaluate, features, joins, labels, popularity, serve, splits
from corvane.operators.stats import adjusted_skewness, global_stats, price_cuts, price_stats
from corvane.plans.canonical import broadcast_if_small, listings, listings_by_event, snapshots, table
from corvane.plans.shared import freed, small_methods, stored
from corvane.sources import payloads, store, synthetic

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
NOW = "timestamp_ntz'2000-01-01 00:00:00'"


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    from corvane.oracle import SQL

    return {k: v for k, v in SQL.items() if k in _ALL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x05_event_pricing(spark, sf_dir)


def _rounded(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keep, *[(S.r4(F.col(n)) if kinds[n] == "double" else F.col(n)).alias(n) for n in names])


def _extracted(make: Callable[[], features.Extractor], spark, sf_dir, is_train: bool | None = None) -> DataFrame:
    """Fit on training rows, transform all rows (or the training rows, marked as such)."""
    rows = listings(spark, sf_dir)
    train = rows.where("is_train")
    made = make().fit(train)
    out = made.transform(train if is_train else rows, bool(is_train))
    return _rounded(out, made.names, "listing_id")


def _in_one_pass(make: Callable[[], features.Extractor], spark, sf_dir, **how) -> DataFrame:
    """The same for extractors whose statistics are mostly by event."""
    made = make()
    return _rounded(made.fit_transform(listings_by_event(spark, sf_dir), F.col("is_train"), **how), made.names, "listing_id")


# sources and sinks


@query
def s12_listing_hash(spark, sf_dir):
    return listings(spark, sf_dir).select("listing_id", store.listing_hash().alias("listing_hash"))


@query
def s14_dedup_append(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("listing_price", F.floor("listing_price") + 0.0)
    stored, batch = rows.where("is_train"), rows.where("not is_train")
    fresh = store.unseen(batch, stored, "listing_id")
    return fresh.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_new"), F.min("listing_id").alias("first_id"))


@query
def s07_events_filter(spark, sf_dir):
    return store.events(listings(spark, sf_dir)).where("event_type = 'sports' AND event_datetime BETWEEN timestamp_ntz'1998-06-01' AND timestamp_ntz'1999-06-01'").select("event_id", "event_type", "event_datetime", "city")


@query
def s06_event_lookup(spark, sf_dir):
    return store.event(store.events(listings(spark, sf_dir)), "E7").select("event_id", "event_type", "event_datetime", "city")


@query
def s08_event_ids(spark, sf_dir):
    return store.event_ids(store.events(listings(spark, sf_dir)))


@query
def s18_listing_event_ids(spark, sf_dir):
    return store.event_ids(listings(spark, sf_dir), distinct=True)


@query
def s20_load_snapshots(spark, sf_dir):
    return store.load_snapshots(snapshots(spark, sf_dir)).withColumn("inventory_remaining", F.col("inventory_remaining").cast("double")).drop("days_to_event")


@query
def f19_title_artist(spark, sf_dir):
    title = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, " live").otherwise(" at "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.title_artist(title).alias("artist"))


@query
def s11_latest_snapshot(spark, sf_dir):
    return store.latest(snapshots(spark, sf_dir), ["event_id", "seat_zone"], "timestamp", "seq").select("event_id", "seat_zone", "timestamp", "price_avg", F.col("inventory_remaining").cast("double").alias("inventory_remaining"))


@query
def s15_listings_filter(spark, sf_dir):
    return store.listings_between(listings(spark, sf_dir), low=100.0, high=110.0).select("listing_id", "event_id", "listing_price", "timestamp")


@query
def s17_latest_listings(spark, sf_dir):
    return listings(spark, sf_dir).orderBy(F.desc("timestamp"), "listing_id").limit(100).select("listing_id", "timestamp")


@query
def s21_summary(spark, sf_dir):
    p = F.col("listing_price")
    return listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_listings"), F.count_distinct("event_id").alias("n_events"), F.count_distinct("artist_or_team").alias("n_artists"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), S.r4(F.avg(p)).alias("avg_price"))


@query
def s26_event_payloads(spark, sf_dir):
    return payloads.discovery_events(payloads.sample_discovery(table(spark, sf_dir, "part")))


@query
def s27_concert_payloads(spark, sf_dir):
    return payloads.concerts(payloads.sample_concerts(table(spark, sf_dir, "part")), 1999, 2000)


@query
def s28_marketplace_payloads(spark, sf_dir):
    return payloads.marketplace_listings(payloads.sample_marketplace(table(spark, sf_dir, "part")))


@query
def s33_synthetic_prices(spark, sf_dir):
    concerts = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), "p_partkey").alias("event_id"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") * 3).alias("high"), F.lit(2.5).alias("demand"), (F.col("p_size") / 50).alias("popularity"), F.expr("timestamp_ntz'1998-01-01 20:00:00' + make_dt_interval(cast(p_partkey as int))").alias("event_date"))
    out = synthetic.trajectories(concerts, volatility=0.0)
    return out.select("event_id", "seat_zone", "days_to_event", "timestamp", S.r4(F.col("price_avg")).alias("price_avg"))


# projections and predicates


@query
def p01_listing_projection(spark, sf_dir):
    d = F.greatest(F.lit(0), S.floor_days(F.col("event_datetime"), F.col("timestamp"))).cast("int")
    markup = F.when(F.col("face_value") > 0, S.r2(F.col("listing_price") / F.col("face_value")))
    return listings(spark, sf_dir).select("listing_id", d.alias("days"), markup.alias("markup_ratio"), store.seat_description().alias("seat_description"), (F.col("listing_price") * F.col("quantity")).alias("total_price"))


@query
def p04_price_filter_cap(spark, sf_dir):
    rows = splits.cap_price(listings(spark, sf_dir).where("listing_price >= 10"))
    return rows.groupBy("artist_or_team").agg(F.count(F.lit(1)).alias("n"), S.r4(F.max("listing_price")).alias("max_price"), S.r4(F.min("listing_price")).alias("min_price"))


@query
def p05_post_event_filter(spark, sf_dir):
    return labels.before_event(listings(spark, sf_dir)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_at"))


@query
def p06_keyword_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(S.has(F.col("p_name"), ["ring", "blue w", "bolt"])).select("p_partkey", "p_name")


@query
def p10_geo_region(spark, sf_dir):
    c = F.col("city")
    return listings(spark, sf_dir).select("city").distinct().select("city", S.city_name(c).alias("city_name"), S.country(c).alias("country"), S.region_key(c).alias("region_key"), S.city_tier(c).alias("city_tier"), S.nickname_city(c).alias("nickname_city"))


@query
def p13_zone_map(spark, sf_dir):
    return listings(spark, sf_dir).select("section").distinct().select("section", S.zone(F.col("section")).alias("zone"), S.by_zone(S.zone(F.col("section")), S.ZONE_RATIO, 0.5).alias("ratio"))


@query
def p14_zone_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(S.zone_prices(F.col("p_size") * 10.0, F.col("p_retailprice") - 1000)).alias("x"))
    return rows.select("p_partkey", "x.zone", "x.price")


@query
def p16_types(spark, sf_dir):
    raw = listings(spark, sf_dir).select("listing_id", F.when(F.col("quantity") == 3, "n/a").otherwise(F.col("listing_price").cast("string")).alias("listing_price"))
    return cleaning.typed(raw, ["listing_price"], []).agg(F.count(F.lit(1)).alias("n"), F.count("listing_price").alias("n_numbers"))


@query
def p18_temporal(spark, sf_dir):
    out = cleaning.timed(listings(spark, sf_dir))
    return out.select("listing_id", "hour_of_day", F.col("days_to_event").alias("days_exact"), F.col("is_weekend").cast("int").alias("is_weekend"))


@query
def p19_zero_variance(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("constant", F.lit(1)).withColumn("nothing", F.lit(None).cast("int"))
    names = ["quantity", "section", "row", "constant", "nothing", "event_type"]
    row = rows.agg(*[F.count_distinct(n).alias(n) for n in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n_distinct")) for n in names])).alias("x")).select("x.*").where("n_distinct <= 1")


@query
def p22_validation(spark, sf_dir):
    rows = cleaning.validated_listings(listings(spark, sf_dir), F.expr(NOW))
    return rows.groupBy(F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


@query
def p22_batch_summary(spark, sf_dir):
    out = cleaning.batch_summary(cleaning.validated_listings(listings(spark, sf_dir), F.expr(NOW)))
    return out.withColumn("error_rate", S.r4(F.col("error_rate")))


@query
def p22_event_validation(spark, sf_dir):
    rows = store.events(listings(spark, sf_dir)).withColumn("city", F.expr("CASE WHEN event_type = 'sports' THEN '' ELSE city END"))
    out = cleaning.validated_events(rows, F.expr(NOW), venue="venue_name")
    return out.groupBy(F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


@query
def p22_snapshot_validation(spark, sf_dir):
    rows = snapshots(spark, sf_dir).withColumn("price_max", F.expr("CASE WHEN seq % 5 = 0 THEN price_min * 0.9 ELSE price_max END"))
    out = cleaning.validated_snapshots(rows, F.expr("timestamp_ntz'2024-01-16 00:00:00'"))
    return out.groupBy(F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


@query
def t05_offending_rows(spark, sf_dir):
    return cleaning.offending(listings(spark, sf_dir), F.col("row").isNull(), "listing_id")


@query
def p23_null_rates(spark, sf_dir):
    out = cleaning.null_rates(listings(spark, sf_dir), ["event_id", "row", "seat_from", "face_value", "days_to_event"])
    return out.withColumn("null_rate", S.r4(F.col("null_rate")))


@query
def p24_referential(spark, sf_dir):
    rows = cleaning.zoned(listings(spark, sf_dir))
    known = store.events(rows).where("event_type <> 'sports'")
    return cleaning.referential(rows, known, "normalized_seat_zone")


@query
def p25_temporal_validation(spark, sf_dir):
    return cleaning.temporal(listings(spark, sf_dir), F.expr(NOW))


# joins


@query
def j01_dimension(spark, sf_dir):
    dim = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("venue_name"), F.col("s_acctbal").alias("balance"))
    out = joins.dimension(listings(spark, sf_dir), dim, "venue_name", ["balance"])
    return out.groupBy("venue_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("n_matched"), F.max("balance").alias("balance"))


@query
def j02_asof_snapshot(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    probes = rows.where("kind = 'view'").select("seq", "event_id", "seat_zone", "timestamp")
    quotes = rows.where("kind = 'purchase'")
    out = joins.asof(probes, quotes, ["event_id", "seat_zone"], F.col("timestamp"), "timestamp", ["price_min", "inventory_remaining"], "seq", "quote_")
    return out.select("seq", "event_id", "seat_zone", "quote_price_min", F.col("quote_inventory_remaining").cast("double").alias("quote_inventory_remaining"), F.col("quote_matched_at").alias("matched_at"))


@query
def j02_snapshot_features(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    out = joins.snapshot_features(rows.where("kind = 'view'").select("seq", "event_id", "seat_zone", "timestamp"), rows.where("kind <> 'view'"), "seq")
    return _rounded(out, ["_snap_inv_rate", "_snap_trend", "_snap_count", "_snap_range"], "seq").withColumnsRenamed({"_snap_inv_rate": "inv_rate", "_snap_trend": "trend", "_snap_count": "log_count", "_snap_range": "price_range"})


@query
def j06_known_events(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return rows.where("not is_train").join(rows.where("is_train and artist_or_team < 'Brand#2'").select("event_id").distinct(), "event_id", "left_semi").groupBy("artist_or_team").agg(F.count(F.lit(1)).alias("n"))


@query
def j07_unseen(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return rows.where("not is_train").join(rows.where("is_train and listing_price > 900").select("event_id").distinct(), "event_id", "left_anti").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query
def j12_outer_keys(spark, sf_dir):
    rows = listings(spark, sf_dir)
    a = rows.where("is_train and artist_or_team < 'Brand#20'").groupBy("artist_or_team").agg(F.count("face_value").alias("n"))
    b = rows.where("not is_train and artist_or_team > 'Brand#12'").groupBy("artist_or_team").agg(F.count("face_value").alias("n"))
    out = joins.outer_keys(a, b, "artist_or_team", "n")
    return out.withColumn("trend", cleaning.against_baseline(F.col("now"), F.col("baseline"), 5.0))


# aggregations


@query
def a01_group_stats(spark, sf_dir):
    out = price_stats(listings(spark, sf_dir), ["event_id"])
    return out.select("event_id", "n", "median", S.r4(F.col("mean")).alias("mean"), S.r4(F.col("std")).alias("std"))


@query
def a05_distribution(spark, sf_dir):
    p = F.col("listing_price")
    return listings(spark, sf_dir).groupBy("artist_or_team").agg(S.r4(F.percentile(p, 0.02)).alias("p2"), S.r4(F.percentile(p, 0.95)).alias("p95"), S.r4(F.percentile(p, 0.75) - F.percentile(p, 0.25)).alias("iqr"), S.r4(S.clip(adjusted_skewness(p), -3.0, 3.0)).alias("skew"))


@query
def a09_zone_snapshots(spark, sf_dir):
    p = F.col("listing_price")
    return store.zone_snapshots(listings(spark, sf_dir)).select("event_id", "seat_zone", "timestamp", "price_min", S.r4(F.col("price_avg")).alias("price_avg"), "price_max", "inventory_remaining")


@query
def a16_listing_stability(spark, sf_dir):
    rows = snapshots(spark, sf_dir).select(F.concat_ws("-", "event_id", "kind").alias("listing_id"), "timestamp")
    return labels.listing_stability(rows).withColumn("stability", S.r4(F.col("stability")))


@query
def a19_popularity_scores(spark, sf_dir):
    out = popularity.scored(store.popularity_counts(table(spark, sf_dir, "part")))
    return out.select("artist", S.r4(F.col("score")).alias("score"), "tier")


# windows


@query
def w05_dedup_6h(spark, sf_dir):
    rows = snapshots(spark, sf_dir).select("event_id", F.col("kind").alias("section"), "timestamp", "seq")
    out = cleaning.flag_duplicates(rows, 6.0, ["event_id", "section"], "seq")
    return out.select("seq", "is_duplicate")


@query
def w08_rank_by_value(spark, sf_dir):
    rows = listings(spark, sf_dir)
    stats = price_stats(rows.where("is_train"), ["event_id"]).select("event_id", F.col("median").alias("predicted"))
    out = serve.rank_by_value(rows.join(stats, "event_id"), within="event_id")
    return out.select("listing_id", "event_id", "rank", S.r4(F.col("value_score")).alias("value_score"), S.r4(F.col("savings_estimate")).alias("savings_estimate"))


@query
def w09_coverage_cut(spark, sf_dir):
    return popularity.covering(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("score")), "c_nationkey")


@query
def w10_stall(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 / 10).alias("mae"))
    return evaluate.stalled(runs)


@query
def w12_round_robin(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return popularity.round_robin(rows, "c_mktsegment", ["c_custkey"])


# scalars


@query
def f02_section_scalars(spark, sf_dir):
    s = F.col("section")
    return listings(spark, sf_dir).select("section").distinct().select("section", S.section_level(s).alias("level"), S.section_hash(s).alias("hash"), S.section_number(s).alias("number"), S.word_count(s).alias("words"))


@query
def f03_rows_and_seats(spark, sf_dir):
    r = F.col("row")
    return listings(spark, sf_dir).select("row", "seat_from").distinct().select("row", "seat_from", S.row_quality(r).alias("quality"), S.row_number(r).alias("number"), S.row_bucket(r).alias("bucket"), S.seat_number(F.col("seat_from")).alias("seat"))


@query
def f11_counts(spark, sf_dir):
    text = F.expr("CASE p_size % 4 WHEN 0 THEN concat(p_size, '.5M subscribers') WHEN 1 THEN concat(p_size, ',', 100 + p_size, ' views') WHEN 2 THEN concat(p_size, 'k') ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", S.count_of(text).alias("count_value"))


@query
def f14_date_parts(spark, sf_dir):
    d = F.col("event_datetime")
    return listings(spark, sf_dir).select("event_datetime").distinct().select("event_datetime", F.weekday(d).alias("dow"), F.month(d).alias("month"), F.hour(d).alias("hour"), F.expr("extract(YEAROFWEEK FROM event_datetime)").alias("iso_year"), F.weekofyear(d).alias("iso_week"), F.quarter(d).alias("quarter"), F.date_format(d, "yyyy-MM").alias("period"))


# features


@query
def x01_performer(spark, sf_dir):
    return _extracted(features.Performer, spark, sf_dir)


@query
def x02_event(spark, sf_dir):
    return _extracted(features.Event, spark, sf_dir)


@query
def x03_seating(spark, sf_dir):
    return _extracted(features.Seating, spark, sf_dir)


@query
def x04_time_series(spark, sf_dir):
    return _extracted(features.TimeSeries, spark, sf_dir)


@query
def x05_event_pricing(spark, sf_dir):
    return _in_one_pass(features.EventPricing, spark, sf_dir)


@query
def x06_relative_pricing(spark, sf_dir):
    return _in_one_pass(features.RelativePricing, spark, sf_dir)


@query
def x07_cold_start(spark, sf_dir):
    return _in_one_pass(features.ColdStart, spark, sf_dir)


@query
def x08_within_event(spark, sf_dir):
    return _extracted(features.WithinEvent, spark, sf_dir)


@query
def x08_within_event_train(spark, sf_dir):
    return _extracted(features.WithinEvent, spark, sf_dir, True)


@query
def x09_section(spark, sf_dir):
    return _extracted(features.Section, spark, sf_dir)


@query
def x10_listing_structural(spark, sf_dir):
    return _in_one_pass(features.ListingStructural, spark, sf_dir)


@query
def x10_listing_structural_train(spark, sf_dir):
    return _in_one_pass(features.ListingStructural, spark, sf_dir, is_train=True)


@query
def x11_snapshot(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    out = joins.snapshot_features(rows.where("kind = 'view'").select("seq", "event_id", "seat_zone", "timestamp"), rows.where("kind <> 'view'"), "seq")
    out = out.withColumn("_snap_trend", F.when(F.col("seq") % 5 != 0, F.col("_snap_trend")))
    made = features.Snapshot().fit(out)
    return _rounded(made.transform(out), made.names, "seq")


@query
def x12_regional(spark, sf_dir):
    return _extracted(features.Regional, spark, sf_dir)


@query
def x13_popularity(spark, sf_dir):
    return _extracted(lambda: features.Popularity(store.popularity_counts(table(spark, sf_dir, "part"))), spark, sf_dir)


@query
def x14_listing_context(spark, sf_dir):
    return _extracted(features.ListingContext, spark, sf_dir)


@query
def x15_venue(spark, sf_dir):
    return _extracted(features.Venue, spark, sf_dir)


@query
def x16_interaction(spark, sf_dir):
    rows = listings(spark, sf_dir)
    train = rows.where("is_train")
    out, base = rows, train
    for make in (features.Performer, features.Event, features.Seating, features.TimeSeries, features.Venue):
        made = make().fit(train)
        out, base = made.transform(out), made.transform(base, True)
    made = features.Interaction().fit(base)
    return _rounded(made.transform(out), made.names, "listing_id")


@query
def x17_momentum(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("price_momentum_7d", F.col("face_value"))
    return _rounded(features.Momentum().transform(rows), features.Momentum.names, "listing_id")


# labels


def _scrapes(spark, sf_dir) -> DataFrame:
    """Sightings: a user's event types are the listings of an event, scraped whenever the user did anything."""
    rows = snapshots(spark, sf_dir)
    return rows.select(F.col("event_id"), F.concat_ws("-", "event_id", "kind").alias("listing_id"), "timestamp", F.expr("timestamp_ntz'2024-01-29 00:00:00'").alias("event_datetime"), "price_min")


@query
def l02_absence_label(spark, sf_dir):
    out = labels.absence_labels(_scrapes(spark, sf_dir), window_hours=72)
    return out.select("listing_id", "timestamp", "sold", S.r4(F.col("hours_until_disappearance")).alias("hours"))


@query
def l03_depletion_label(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    probes = rows.where("kind = 'view'").select("seq", "event_id", "timestamp", F.expr("timestamp_ntz'2024-01-29 00:00:00'").alias("event_datetime"))
    out = labels.depletion_labels(probes, rows.where("kind <> 'view'"))
    return out.select("seq", S.r4(F.col("depletion")).alias("depletion"), "sold")


@query
def l04_sale_features(spark, sf_dir):
    rows = listings(spark, sf_dir)
    out = labels.sale_features(rows.where("not is_train"), rows.where("is_train"), ["event_id"], "face_value")
    return _rounded(out, ["price_z", "price_to_median", "price_to_predicted"], "listing_id")


# splits, weights, targets


@query
def k01_temporal_split(spark, sf_dir):
    return splits.temporal_split(listings(spark, sf_dir), ["event_datetime", "listing_id"]).select("listing_id", "split")


@query
def k02_stratified_split(spark, sf_dir):
    return splits.stratified_split(listings(spark, sf_dir), "artist_or_team", ["event_datetime", "listing_id"]).select("listing_id", "split")


@query
def k03_group_folds(spark, sf_dir):
    return splits.group_folds(listings(spark, sf_dir), "event_id", "event_datetime")


@query
def k05_contiguous_folds(spark, sf_dir):
    return splits.contiguous_folds(listings(spark, sf_dir), "event_id")


@query
def k07_winsorise(spark, sf_dir):
    out = splits.winsorise(cleaning.zoned(listings(spark, sf_dir)), "normalized_seat_zone")
    return out.select("listing_id", S.r4(F.col("listing_price")).alias("listing_price"))


@query
def k08_outliers(spark, sf_dir):
    out = cleaning.flag_outliers(listings(spark, sf_dir))
    return out.groupBy(F.coalesce("outlier_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def k10_impute(spark, sf_dir):
    out = cleaning.impute(listings(spark, sf_dir))
    return out.select("listing_id", "venue_capacity", "capacity_imputed", "face_value", "face_value_imputed")


def _weights(how):
    def run(spark, sf_dir):
        return splits.weights(listings(spark, sf_dir).where("is_train"), how).select("listing_id", S.r4(F.col("weight")).alias("weight"))

    run.__name__ = f"k11_weights_{how}"
    return query(run)


for _how in ("inverse_artist_freq", "sqrt_price", "log_price", "inverse_price_quartile", "low_count_upweight"):
    _weights(_how)


@query
def k12_coverage_buckets(spark, sf_dir):
    return evaluate.events_per_artist(listings(spark, sf_dir))


@query
def k12_city_months(spark, sf_dir):
    return evaluate.city_months(listings(spark, sf_dir))


@query
def k13_low_count_gate(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return evaluate.low_count_gate(rows.where("is_train and artist_or_team <> 'Brand#7'"), rows.where("not is_train"))


@query
def k13_gate_auc(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("unrowed", F.col("row").isNull())
    return evaluate.flag_auc(rows, "unrowed", "is_train").select(S.r4(F.col("auc")).alias("auc"))


@query
def g04_relative_target(spark, sf_dir):
    rows = listings(spark, sf_dir)
    train = rows.where("is_train")
    out = splits.RelativeTarget().fit(train).base(train, True)
    return out.select("listing_id", S.r4(F.col("target_base")).alias("target_base"), S.r4(F.log1p("listing_price") - F.col("target_base")).alias("residual"))


@query
def g01_targets(spark, sf_dir):
    rows = listings(spark, sf_dir)
    p = F.col("listing_price")
    log, root = splits.target("log"), splits.target("sqrt")
    return rows.select("listing_id", S.r4(log.forward(p)).alias("log_price"), S.r4(log.back(log.forward(p))).alias("log_back"), S.r4(root.forward(p)).alias("root_price"), S.r4(root.back(root.forward(p))).alias("root_back"))


# evaluation


def _predicted(spark, sf_dir) -> DataFrame:
    rows = listings(spark, sf_dir)
    by = price_stats(rows.where("is_train and listing_price < 900"), ["event_id"]).select("event_id", F.col("median").alias("predicted"))
    return cleaning.zoned(rows.where("not is_train")).join(by, "event_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(500.0))).withColumnRenamed("listing_price", "actual")


@query
def e01_regression(spark, sf_dir):
    return _rounded(evaluate.regression(_predicted(spark, sf_dir)), ["mae", "rmse", "r2", "mape"], "n")


@query
def e02_quartiles(spark, sf_dir):
    return _rounded(evaluate.by_quartile(_predicted(spark, sf_dir)), ["mae"], "quartile", "n")


@query
def e03_zones(spark, sf_dir):
    return _rounded(evaluate.by_zone(_predicted(spark, sf_dir), "normalized_seat_zone"), ["mae"], "normalized_seat_zone", "n")


@query
def e04_seen_unseen(spark, sf_dir):
    train = listings(spark, sf_dir).where("is_train and event_type <> 'sports'")
    return _rounded(evaluate.seen_breakdown(_predicted(spark, sf_dir), train), ["overall_mae", "seen_mae", "unseen_mae", "q4_mae", "unseen_event_pct"], "n_seen", "n_unseen")


def _classified(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_orderkey") * 7919 % 1000 / 1000).alias("score"))


@query
def e05_classification(spark, sf_dir):
    return _rounded(evaluate.classification(_classified(spark, sf_dir)), ["auc", "precision", "recall", "f1"], "n")


@query
def e06_calibration(spark, sf_dir):
    return _rounded(evaluate.calibration(_classified(spark, sf_dir)), ["mean_score", "positives"], "bin", "n")


@query
def e06_ece(spark, sf_dir):
    return _rounded(evaluate.ece(evaluate.calibration(_classified(spark, sf_dir))), ["ece"])


@query
def e07_leaderboard(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), F.col("o_custkey") % 40).alias("version"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 1000).alias("primary_mae"), (F.col("o_totalprice") / 900).alias("overall_mae"), F.col("o_orderdate").alias("timestamp"), F.concat(F.lit("c"), "o_orderkey").alias("commit"))
    return _rounded(evaluate.leaderboard(runs, 20), ["mae", "mae_std"], "version", "folds", "last_at", "last_commit")


@query
def m13_asymmetric_huber(spark, sf_dir):
    return _predicted(spark, sf_dir).groupBy("normalized_seat_zone").agg(S.r4(F.avg(evaluate.asymmetric_huber(F.col("actual") - F.col("predicted"), 50.0))).alias("loss"))


# serving


@query
def i01_bounds(spark, sf_dir):
    rows = _predicted(spark, sf_dir).withColumn("baseline", F.col("actual") + 1)
    return _rounded(serve.with_bounds(rows), ["price_lower_bound", "price_upper_bound", "confidence_score", "predicted_direction", "direction_probability"], "listing_id")


@query
def i02_cold_start(spark, sf_dir):
    events = store.events(listings(spark, sf_dir)).select("event_id", F.when(F.col("event_type") == "sports", "BTS world").otherwise(F.col("artist_or_team")).alias("artist_or_team"), S.city_tier(F.col("city")).alias("city_tier"), F.upper("event_type").alias("event_type"))
    tiers = popularity.scored(store.popularity_counts(table(spark, sf_dir, "part"))).where("score > 30").select("artist", "tier")
    return _rounded(serve.cold_start(events, tiers=tiers), ["estimate"], "event_id", "zone", "confidence", "estimate_source")


@query
def i04_discovered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return popularity.discovered(part.where("p_size < 20").select(F.col("p_brand").alias("name")).distinct(), part.select(F.upper("p_brand").alias("name")).distinct())


@query
def i04_allocation(spark, sf_dir):
    out = popularity.scored(store.popularity_counts(table(spark, sf_dir, "part"))).withColumn("events", popularity.allocated(F.col("tier")))
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("artists"), F.sum("events").alias("max_events"))


# quality


@query
def q01_listing_pipeline(spark, sf_dir):
    # every stage's metrics are a pass over the rows: the star is joined once
    rows = stored(listings(spark, sf_dir).drop("source", "quantity", "days_to_event", "is_train"), "pipeline-listings")
    freed(spark)
    return cleaning.listing_pipeline(store.events(rows).where("event_type <> 'sports'")).process(rows).data.groupBy("normalized_seat_zone", "is_outlier", "is_duplicate", "has_event", "face_value_imputed").agg(F.count(F.lit(1)).alias("n"))


@query
def q03_quality_rates(spark, sf_dir):
    rows = cleaning.flag_outliers(listings(spark, sf_dir))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), S.r4(F.count_if("is_outlier") / n).alias("outlier_rate"), S.r4(1 - F.count("face_value") / n).alias("null_rate"))



# models: no SQL says the same, rows only


def _model_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    with small_methods(spark):
        return _joined_model_rows(spark, sf_dir)


def _joined_model_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    # the star is joined once; what depends on a section and row alone is computed once for each pair of them
    rows = listings(spark, sf_dir).where("listing_price >= 10")
    rows = stored(rows.select("listing_price", "event_id", "event_type", "quantity", "is_train", "section", "row", "days_to_event", "artist_or_team", "venue_name", S.folded(F.col("artist_or_team")).alias("_artist"), S.folded(F.col("venue_name")).alias("_venue")), "model-listings")
    seats = stored(features.Seating().transform(rows.select("section", "row").distinct().withColumn("_zone", S.zone(F.col("section")))), "seats")
    kept = ["listing_price", "event_id", "event_type", "quantity", "is_train", "days_to_event", "artist_or_team", "venue_name", "_artist", "_venue", "_zone"]
    pair = lambda df: [F.coalesce(F.col(c), F.lit("")) for c in ("section", "row")] + [F.col(c).isNull() for c in ("section", "row")]
    keyed = lambda df: df.withColumns({f"_k{i}": c for i, c in enumerate(pair(df))})
    rows = keyed(rows).join(broadcast_if_small(keyed(seats).drop("section", "row")), [f"_k{i}" for i in range(4)]).select(*kept, *features.Seating.names)
    train = rows.where("is_train")
    prices = stored(train.select("listing_price", "event_id", "artist_or_team", "venue_name", "_artist", "_zone"), "train-prices")
    g, cuts = global_stats(prices, kept=True), price_cuts(prices)
    performer, venue = features.Performer().fit_stored(prices, g, cuts), features.Venue().fit_stored(prices, g, cuts)
    for made, names in ((performer, ("artists", "zones")), (venue, ("venues",))):
        for n in names:
            setattr(made, n, broadcast_if_small(stored(getattr(made, n), n)))
    out = features.TimeSeries().transform(rows)
    out = venue.looked_up(out, out.columns)
    out = performer.looked_up(out, out.columns)
    names = [n for made in (features.Seating, features.TimeSeries, features.Venue, features.Performer) for n in made.names]
    # fitting passes over the rows many times: every pass reads the narrow result
    return stored(out.select("listing_price", "event_type", "quantity", "is_train", F.log1p("listing_price").alias("label"), *names), "model-rows"), names


@query
def m01_ridge(spark, sf_dir):
    from corvane.operators.models import Ridge

    rows, names = _model_rows(spark, sf_dir)
    out = Ridge(names, categories=["event_type"]).fit(rows.where("is_train")).predict(rows.where("not is_train"))
    return evaluate.regression(out.select(F.col("listing_price").alias("actual"), F.expm1("prediction").alias("predicted")))


@query
def m02_boosted_bands(spark, sf_dir):
    from corvane.operators.boosting import Binned
    from corvane.operators.models import Banded

    rows, names = _model_rows(spark, sf_dir)
    train = rows.where("is_train")
    made = Banded(Binned(names, rounds=5, depth=4)).fit(train.where("quantity <> 1"), train.where("quantity = 1"))
    out = made.predict(rows.where("not is_train"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").between(F.col("lower"), F.col("upper")).cast("double")).alias("covered"), F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae_log"))


@query
def m12_sale_probability(spark, sf_dir):
    from corvane.operators.boosting import Binned

    rows, names = _model_rows(spark, sf_dir)
    rows = rows.withColumn("label", (F.col("listing_price") > 500).cast("int"))
    train = rows.where("is_train")
    share = train.agg(F.avg("label")).collect()[0][0] or 0.5
    balanced = F.when(F.col("label") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
    out = Binned(names, weight=balanced, rounds=15, depth=4, loss="log").fit(train).predict(rows.where("not is_train"), "score")
    return evaluate.classification(out)


# streams: drained with what the source holds now


def _event_stream(spark, sf_dir) -> DataFrame:
    from corvane.streaming import jobs

    schema = table(spark, sf_dir, "events").schema
    return jobs.source(spark, f"{sf_dir}/event[s].parquet", schema).selectExpr("concat('E', cast(user_id AS string)) AS event_id", "event_type AS seat_zone", "event_id AS seq", "cast(ts AS timestamp) AS timestamp", "value AS listing_price")


def _drained(spark, stream, name, mode="append") -> DataFrame:
    import uuid

    from corvane.plans.shared import folder
    from corvane.streaming import jobs

    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    return jobs.drained(stream, f"{at}/out", f"{at}/checkpoint", mode)


@query
def r02_stream_distinct(spark, sf_dir):
    from corvane.streaming import jobs

    out = _drained(spark, jobs.distinct_listings(_event_stream(spark, sf_dir), ["event_id", "seat_zone"], late="60 days"), "distinct")
    return out.select("event_id", "seat_zone")


@query
def r05_stream_dedup_6h(spark, sf_dir):
    from corvane.streaming import jobs

    return _drained(spark, jobs.anchored_dedup(_event_stream(spark, sf_dir), ["event_id", "seat_zone"]), "dedup").select("seq")


@query
def r06_stream_disappearances(spark, sf_dir):
    from corvane.streaming import jobs

    rows = _event_stream(spark, sf_dir).select("event_id", F.concat_ws("-", "event_id", "seat_zone").alias("listing_id"), "timestamp")
    out = _drained(spark, jobs.disappearances(rows), "gone")
    return out.select("listing_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.col("missed_at").cast("timestamp_ntz").alias("missed_at"))


# collection runs


@query
def p07_urgent(spark, sf_dir):
    return collect.urgent(store.events(listings(spark, sf_dir)), F.expr("timestamp_ntz'1998-03-01 00:00:00'")).select("event_id", "event_datetime")


@query
def p09_aliases(spark, sf_dir):
    rows = listings(spark, sf_dir).select(F.when(F.col("quantity") == 2, "Drake - Hip Hop").otherwise(F.col("artist_or_team")).alias("artist"), F.concat("city", F.when(F.col("quantity") == 3, F.lit(" Music Fest")).otherwise(F.lit(""))).alias("name"))
    return rows.groupBy(collect.canonical_artist(F.col("artist")).alias("artist"), collect.is_festival(F.col("name")).alias("is_festival")).agg(F.count(F.lit(1)).alias("n"))


@query
def u04_greedy_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("i"), F.col("p_partkey") % 90).alias("id"), F.col("p_type").alias("venue"), F.expr("timestamp_ntz'2025-01-01 20:00:00' + make_dt_interval(p_size % 11)").alias("event_datetime"), F.col("p_brand").alias("batch"))
    return collect.first_of_both(rows, ["seq"], "batch").select("seq", "id")


@query
def s34_ingest_counts(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("listing_price", F.floor("listing_price") + 0.0)
    return collect.ingested(rows.where("not is_train"), rows.where("is_train"), F.expr(NOW))[1]


@query
def s35_pending(spark, sf_dir):
    tasks = listings(spark, sf_dir).select(F.col("artist_or_team").alias("artist")).distinct()
    trail = table(spark, sf_dir, "part").select(F.col("p_brand").alias("artist"), F.when(F.col("p_size") == 7, "ok").otherwise("failed").alias("status"))
    return collect.pending(tasks, trail)


@query
def k04_temporal_folds(spark, sf_dir):
    out = collect.temporal_folds(listings(spark, sf_dir).select("listing_id", "timestamp"), ["timestamp", "listing_id"], 3)
    return out.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


@query
def q02_snapshot_pipeline(spark, sf_dir):
    rows = snapshots(spark, sf_dir).withColumn("seat_zone", F.when(F.col("seq") % 23 == 0, "roof").otherwise(F.col("seat_zone")))
    return collect.snapshot_pipeline().process(rows).data.groupBy("zone_known", "price_ordered").agg(F.count(F.lit(1)).alias("n"))


@query
def w01_prefix_counts(spark, sf_dir):
    return _extracted(features.WithinEvent, spark, sf_dir).groupBy("we_history_support").agg(F.count(F.lit(1)).alias("n"), F.max("we_pos_in_sequence").alias("furthest"))
