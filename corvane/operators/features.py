"""Feature extractors as fit/transform pairs: fit gives small tables of statistics, transform is look-ups and expressions.

Every extractor adds its features as columns to the rows; a missing input column takes the default when the plan is
built. Nothing is computed row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators.stats import adjusted_skewness, bar_set, exact_percentiles, global_stats, lookup, medians_by_parts, price_cuts, price_stats, price_stats_by_ranges, smooth, with_membership
from corvane.plans.canonical import broadcast_if_small
from corvane.plans.shared import stored, stored_by


def col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else default if isinstance(default, Column) else F.lit(default)


def by_event() -> Column:
    """What rows are dealt by in `listings_by_event`; rows without an event lie together."""
    return F.coalesce(F.col("event_id").cast("string"), F.lit(""))


def at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


class Extractor:
    """names: the features in order. fit returns self; transform adds the columns."""

    names: list[str] = []
    uses_train_flag = False
    stage = "base"

    def fit(self, df: DataFrame) -> Extractor:
        return self

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, train: Column) -> DataFrame:
        """Fitted on the rows that `train` marks, all rows transformed."""
        return self.fit(df.where(train)).transform(df)

    def hold(self, df: DataFrame) -> DataFrame:
        """The few columns that several statistics are made of, computed once; `release` lets them go."""
        self._held = df.persist()
        return self._held

    def release(self) -> None:
        if "_held" in vars(self):
            vars(self).pop("_held").unpersist()

    def done(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *self.names)


class Performer(Extractor):
    names = ["artist_avg_price", "artist_median_price", "artist_price_std", "artist_event_count", "artist_listing_count", "artist_premium_ratio", "is_known_artist", "artist_zone_median_price"]

    def __init__(self, smoothing: float = 50, zone_smoothing: float = 20):
        self.m, self.zone_m = smoothing, zone_smoothing

    def fit_stored(self, df, g, cuts):
        """fit for a stored df with `_artist` and `_zone`, its global statistics and price cuts: no rows are dealt but those near a median."""
        self.g, p = g, F.col("listing_price")
        rows = df.where("artist_or_team is not null")
        by = rows.groupBy("artist_or_team").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("std"), F.avg((p > 200).cast("double")).alias("premium"))
        # held once: its join to the counts would be planned on the rows again
        by = broadcast_if_small(stored(by, "artists"))
        events = rows.select("artist_or_team", "event_id").distinct().groupBy("artist_or_team").agg(F.count("event_id").alias("events"))
        for more in (stored(events, "artist-events"), medians_by_parts(rows.where(p.isNotNull()), ["artist_or_team"], cuts)):
            by = by.join(broadcast_if_small(more), "artist_or_team", "left")
        self._artists(by)
        zones = rows.groupBy("_artist", "_zone").agg(F.count(F.lit(1)).alias("n"))
        zones = stored(zones, "zones").join(broadcast_if_small(medians_by_parts(rows.where(p.isNotNull()), ["_artist", "_zone"], cuts).withColumnRenamed("median", "mid")), ["_artist", "_zone"], "left")
        return self._zones(zones)

    def fit(self, df):
        g = self.g = global_stats(df)
        p = F.col("listing_price")
        by = df.where("artist_or_team is not null").groupBy("artist_or_team").agg(
            F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("std"), F.count_distinct("event_id").alias("events"), F.avg((p > 200).cast("double")).alias("premium")
        )
        self._artists(by)
        zones = df.where("artist_or_team is not null").select(S.folded(F.col("artist_or_team")).alias("_artist"), S.zone(F.col("section")).alias("_zone"), "listing_price")
        return self._zones(zones.groupBy("_artist", "_zone").agg(F.count(F.lit(1)).alias("n"), F.median("listing_price").alias("mid")))

    def _artists(self, by):
        g = self.g
        own = F.struct(smooth(F.col("n"), F.col("mean"), self.m, F.lit(g["mean"])).alias("avg"), smooth(F.col("n"), F.col("median"), self.m, F.lit(g["median"])).alias("median"), "std", "events", "n", "premium")
        # names that fold to one key: the last in order counts
        self.artists = by.withColumn("_artist", S.folded(F.col("artist_or_team"))).groupBy("_artist").agg(F.max_by(own, "artist_or_team").alias("s")).select("_artist", "s.*")

    def _zones(self, zones):
        zones = lookup(zones, self.artists.select("_artist", "median"), ["_artist"], "a_")
        self.zones = zones.select("_artist", "_zone", smooth(F.col("n"), F.col("mid"), self.zone_m, F.col("a_median")).alias("median"))
        return self

    def transform(self, df, is_train=False):
        keep = df.columns
        df = df.withColumn("_artist", S.folded(F.col("artist_or_team"))).withColumn("_zone", S.zone(col_or(df, "section", F.lit(None).cast("string"))))
        return self.looked_up(df, keep)

    def looked_up(self, df, keep):
        """transform for rows with `_artist` and `_zone`."""
        g = self.g
        df = lookup(lookup(df, self.artists, ["_artist"], "a_"), self.zones, ["_artist", "_zone"], "z_")
        median = F.coalesce("a_median", F.lit(g["median"]))
        out = [F.coalesce("a_avg", F.lit(g["mean"])), median, F.coalesce("a_std", F.lit(g["std"])), F.coalesce("a_events", F.lit(0)).cast("double"), F.coalesce("a_n", F.lit(0)).cast("double"), F.coalesce("a_premium", F.lit(g["premium"])), F.col("a_n").isNotNull().cast("int"), F.coalesce("z_median", F.when(median > 0, median), F.lit(g["median"]))]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Event(Extractor):
    names = ["event_type_encoded", "city_tier", "day_of_week", "is_weekend", "month", "is_summer", "is_holiday_season", "venue_capacity_bucket", "market_saturation"]

    def fit(self, df):
        self.weeks = df.where("event_datetime is not null and city is not null").select(S.city_name(F.col("city")).alias("_city"), F.expr("extract(YEAROFWEEK FROM event_datetime)").alias("_year"), F.weekofyear("event_datetime").alias("_week"), "event_id")
        self.weeks = self.weeks.groupBy("_city", "_year", "_week").agg(F.count_distinct("event_id").alias("events"))
        return self

    def transform(self, df, is_train=False):
        keep, when = df.columns, F.col("event_datetime")
        df = df.withColumns({"_city": S.city_name(F.col("city")), "_year": F.expr("extract(YEAROFWEEK FROM event_datetime)"), "_week": F.weekofyear(when)})
        df = lookup(df, self.weeks, ["_city", "_year", "_week"], "w_")
        day, month = F.weekday(when), F.month(when)
        out = [S.event_code(col_or(df, "event_type", "concert")), S.city_tier(F.col("city")), day, (day >= 5).cast("int"), month, month.isin(6, 7, 8).cast("int"), month.isin(11, 12).cast("int"), S.capacity_bucket(col_or(df, "venue_capacity", F.lit(None).cast("int"))), F.log1p(F.coalesce("w_events", F.lit(0)).cast("double"))]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Seating(Extractor):
    names = ["seat_zone_encoded", "zone_price_ratio", "row_numeric", "is_floor", "is_ga", "is_premium"]

    def transform(self, df, is_train=False):
        section = F.coalesce(F.col("section"), F.lit(""))
        zone = S.zone(section)
        premium = S.has(section, S.PREMIUM_WORDS) & ~F.lower(section).contains("general admission")
        out = [S.by_zone(zone, S.ZONE_CODE, 1), S.by_zone(zone, S.ZONE_RATIO, 0.5), S.row_number(F.col("row")) if "row" in df.columns else F.lit(10), S.has(section, ["floor", "pit", "field", "courtside"]).cast("int"), S.has(section, ["ga", "general admission"]).cast("int"), premium.cast("int")]
        return df.select("*", *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class TimeSeries(Extractor):
    names = ["days_to_event_filled", "days_to_event_squared", "days_to_event_sqrt", "urgency_bucket", "is_last_week", "is_last_day"]

    def transform(self, df, is_train=False):
        d = F.coalesce(col_or(df, "days_to_event", 30), F.lit(30))
        out = [d, d * d, F.sqrt(d + 1), S.urgency(d), (d <= 7).cast("int"), (d <= 1).cast("int")]
        return df.select("*", *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class EventPricing(Extractor):
    """Medians of event, event by zone and event by section, smoothed towards the level above.

    A row whose price in cents is among the event's training prices gets its own price taken out of the event's value
    (`loo`: "cents" on any split, "flag" only where is_train says so).
    """

    names = ["event_median_price", "event_zone_median_price", "event_listing_count", "event_price_cv", "event_zone_price_ratio", "event_section_median_price", "event_price_iqr", "event_price_skewness", "zone_price_range_ratio"]
    uses_train_flag = True

    def __init__(self, smoothing: float = 20, loo: str = "cents"):
        self.m, self.loo = smoothing, loo

    def fit(self, df):
        m, g = self.m, global_stats(df)
        self.g = g
        df = self.hold(df.select("event_id", "section", "artist_or_team", "listing_price", S.zone(F.col("section")).alias("_zone")))
        p = F.col("listing_price")
        spread = df.where("listing_price is not null and event_id is not null").groupBy("event_id").agg(F.count(p).alias("k"), (F.percentile(p, 0.75) - F.percentile(p, 0.25)).alias("iqr"), S.clip(adjusted_skewness(p), -3.0, 3.0).alias("skew")).where("k >= 3").drop("k")
        event = price_stats(df, ["event_id"]).withColumn("raw", F.col("median")).withColumn("median", smooth(F.col("n"), F.col("raw"), m, F.lit(g["median"]))).drop("raw")
        self.events = event.join(spread, "event_id", "left")
        prior = F.coalesce("e_median", F.lit(g["median"]))
        zone = df.where("listing_price is not null and event_id is not null").groupBy("event_id", "_zone").agg(F.count(p).alias("n"), F.median(p).alias("mid"), ((F.max(p) - F.min(p)) / F.greatest(F.median(p), F.lit(1.0))).alias("range"))
        zone = lookup(zone, event.select("event_id", "median"), ["event_id"], "e_")
        self.zones = zone.select("event_id", "_zone", smooth(F.col("n"), F.col("mid"), m, prior).alias("median"), F.when(F.col("n") >= 5, S.clip(F.col("range"), 0.0, 10.0)).alias("range"))
        section = price_stats(df, ["event_id", "section"]).withColumn("_zone", S.zone(F.col("section")))
        section = lookup(lookup(section, self.zones.select("event_id", "_zone", "median"), ["event_id", "_zone"], "z_"), event.select("event_id", "median"), ["event_id"], "e_")
        self.sections = section.select("event_id", "section", smooth(F.col("n"), F.col("median"), m, F.coalesce("z_median", "e_median", F.lit(g["median"]))).alias("median"))
        self._by_artist(df, price_stats)
        self.members = bar_set(df.where("event_id is not null"), ["event_id"])
        return self

    def _by_artist(self, df, stats):
        g, m = self.g, self.m
        artist = stats(df, ["artist_or_team"])
        self.artists = artist.select("artist_or_team", "n", "mean", "std", smooth(F.col("n"), F.col("median"), m, F.lit(g["median"])).alias("median"))
        az = lookup(stats(df, ["artist_or_team", "_zone"]), self.artists.select("artist_or_team", "median"), ["artist_or_team"], "a_")
        self.artist_zones = az.select("artist_or_team", "_zone", smooth(F.col("n"), F.col("median"), m, F.coalesce("a_median", F.lit(g["median"]))).alias("median"))

    def fit_transform(self, df, train):
        """The same in one pass: training rows and rows to transform lie together by event, and statistics of an event are windows.

        Rows dealt by event already (`listings_by_event`) aren't shuffled again; only the tables by artist are looked up.
        """
        m, keep, train = self.m, df.columns, F.coalesce(train, F.lit(False))
        prices = stored(df.where(train).select("artist_or_team", S.zone(F.col("section")).alias("_zone"), "listing_price"), "train-prices")
        g = self.g = global_stats(prices, kept=True)
        self._by_artist(prices, price_stats_by_ranges)
        priced = train & F.col("event_id").isNotNull() & F.col("listing_price").isNotNull()
        df = df.withColumns({"_zone": S.zone(F.col("section")), "_event": by_event(), "_p": F.when(priced, F.col("listing_price")), "_c": S.cents(F.col("listing_price")), "_known": F.col("event_id").isNotNull()})
        p = F.col("_p")
        at = W.partitionBy("_event", "_zone", "section")
        df = df.withColumns({"_s_n": F.count(p).over(at), "_s_mid": F.median(p).over(at)})
        at = W.partitionBy("_event", "_zone")
        df = df.withColumns({"_z_n": F.count(p).over(at), "_z_mid": F.median(p).over(at), "_z_low": F.min(p).over(at), "_z_high": F.max(p).over(at)})
        at = W.partitionBy("_event")
        df = df.withColumns({"_e_n": F.count(p).over(at), "e_total": F.sum(p).over(at), "e_mean": F.avg(p).over(at), "_e_std": F.stddev_samp(p).over(at), "_e_q": F.percentile(p, [0.25, 0.5, 0.75]).over(at), "_e_skew": adjusted_skewness(p, at)})
        df = df.withColumn("_own", F.coalesce(F.max(priced).over(W.partitionBy("_event", "_c")), F.lit(False)) & F.col("_known") & F.col("_c").isNotNull())
        # what the look-ups of transform give: null where there are no training prices
        there = lambda level, x: F.when(F.col("_known") & (F.col(f"_{level}_n") > 0), x)
        df = df.withColumns({
            "e_n": there("e", F.col("_e_n")), "e_median": there("e", smooth(F.col("_e_n"), F.col("_e_q")[1], m, F.lit(g["median"]))), "e_std": there("e", F.coalesce("_e_std", F.lit(0.0))),
            "e_total": there("e", F.col("e_total")), "e_mean": there("e", F.col("e_mean")), "e_iqr": there("e", F.when(F.col("_e_n") >= 3, F.col("_e_q")[2] - F.col("_e_q")[0])), "e_skew": there("e", F.when(F.col("_e_n") >= 3, S.clip(F.col("_e_skew"), -3.0, 3.0))),
        })
        df = df.withColumns({"z_median": there("z", smooth(F.col("_z_n"), F.col("_z_mid"), m, F.coalesce("e_median", F.lit(g["median"])))), "z_range": there("z", F.when(F.col("_z_n") >= 5, S.clip((F.col("_z_high") - F.col("_z_low")) / F.greatest(F.col("_z_mid"), F.lit(1.0)), 0.0, 10.0)))})
        df = df.withColumn("s_median", there("s", F.when(F.col("section").isNotNull(), smooth(F.col("_s_n"), F.col("_s_mid"), m, F.coalesce("z_median", "e_median", F.lit(g["median"]))))))
        df = lookup(df, broadcast_if_small(stored(self.artists, "artists")), ["artist_or_team"], "a_")
        df = lookup(df, broadcast_if_small(stored(self.artist_zones, "artist-zones")), ["artist_or_team", "_zone"], "az_")
        return self._features(df, keep, False)

    def _joined(self, df):
        df = df.withColumn("_zone", S.zone(F.col("section")))
        for stats, keys, prefix in ((self.events, ["event_id"], "e_"), (self.zones, ["event_id", "_zone"], "z_"), (self.sections, ["event_id", "section"], "s_"), (self.artists, ["artist_or_team"], "a_"), (self.artist_zones, ["artist_or_team", "_zone"], "az_")):
            df = lookup(df, stats, keys, prefix)
        return df

    def transform(self, df, is_train=False):
        return self._features(with_membership(self._joined(df), self.members, ["event_id"], "_own"), df.columns, is_train)

    def _features(self, df, keep, is_train):
        g, m = self.g, self.m
        of = lambda name, default: F.coalesce(f"e_{name}", f"a_{name}", F.lit(default))
        n, price = F.col("e_n"), F.col("listing_price")
        rest = F.when(n > 1, smooth(n - 1, (F.col("e_total") - price) / (n - 1), m, F.lit(g["mean"]))).otherwise(F.lit(g["mean"]))
        own = F.col("_own") if self.loo == "cents" else F.col("_own") & F.lit(is_train)
        event = F.when(own & n.isNotNull(), rest).otherwise(of("median", g["median"]))
        df = df.withColumn("_event", event).withColumn("_ez", F.coalesce("z_median", "az_median", "_event"))
        mean, std = of("mean", g["mean"]), of("std", g["std"])
        out = [
            F.col("_event"), F.col("_ez"), F.log1p(of("n", 1).cast("double")), F.when(mean > 0, S.clip(std / mean, 0.0, 3.0)).otherwise(0.0), F.when(F.col("_event") > 0, S.clip(F.col("_ez") / F.col("_event"), 0.1, 10.0)).otherwise(1.0),
            F.coalesce("s_median", "_ez"), F.coalesce("e_iqr", F.lit(g["q75"] - g["q25"] if g["n"] > 3 else 0.0)), F.coalesce("e_skew", F.lit(g["skew"] or 0.0)), F.coalesce("z_range", F.lit(0.5)),
        ]
        return df.select(*keep, *[c.alias(x) for c, x in zip(out, self.names, strict=True)])


class RelativePricing(EventPricing):
    """Deviations between the levels of EventPricing, without taking rows out; shares its tables if given."""

    names = ["section_price_deviation", "zone_price_deviation", "section_zone_residual", "zone_event_residual", "event_artist_residual"]
    uses_train_flag = False

    def transform(self, df, is_train=False):
        return self._features(self._joined(df), df.columns, is_train)

    def _features(self, df, keep, is_train):
        g = self.g
        artist = F.coalesce("a_median", F.lit(g["median"]))
        event = F.coalesce("e_median", artist)
        zone = F.coalesce("z_median", event)
        section = F.coalesce("s_median", zone)
        out = [F.when(zone > 0, (section - zone) / zone).otherwise(0.0), F.when(event > 0, (zone - event) / event).otherwise(0.0), section - zone, zone - event, event - artist]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class ColdStart(Extractor):
    """Log-price means of groups of sibling events: (artist, region, quarter), (venue, weekday), (section hash, zone).

    For a row whose cents are among its event's training prices, the whole event is taken out of every group. Each
    chain falls back to its wider groups, then to the global mean.
    """

    names = ["coldstart_arq_logmean", "coldstart_vdow_logmean", "coldstart_sz_logmean", "coldstart_arq_support", "coldstart_vdow_support", "coldstart_sz_support"]
    CHAINS = {"arq": (75, [["_artist", "_region", "_quarter"], ["_artist", "_region"], ["_artist"]]), "vdow": (100, [["_venue", "_dow"], ["_venue"]]), "sz": (50, [["_hash", "_sz"], ["_sz"]])}

    def _keyed(self, df, fitting):
        when = F.col("event_datetime")
        text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
        city = text("city")
        zone = text("seat_zone") if "seat_zone" in df.columns else F.lit("unknown")
        return df.withColumns({
            "_artist": text("artist_or_team"), "_region": F.when(city == "", "US:unknown").otherwise(S.region_key(city)), "_quarter": F.coalesce(F.concat(F.year(when).cast("string"), F.lit("Q"), F.quarter(when).cast("string")), F.lit("unknown")),
            "_venue": text("venue_name"), "_dow": F.coalesce(F.weekday(when).cast("string"), F.lit("unknown")), "_hash": S.section_hash(text("section")).cast("string"), "_sz": zone if fitting else F.when(zone == "", "unknown").otherwise(zone), "_event": F.coalesce(F.col("event_id").cast("string"), F.lit("")),
        })

    def fit(self, df):
        self.g = df.agg(F.avg(F.log1p("listing_price"))).collect()[0][0]
        self.g = 5.017279836814924 if self.g is None else self.g  # log1p(150)
        keyed = self._keyed(df, True).withColumn("_log", F.log1p(F.coalesce("listing_price", F.lit(0.0))))
        keys = dict.fromkeys(k for _, levels in self.CHAINS.values() for level in levels for k in level)
        keyed = self.hold(keyed.select(*keys, "_event", "_log", "listing_price", "event_id"))
        self.groups, self.parts = {}, {}
        for chain, (_, levels) in self.CHAINS.items():
            # the event's parts in the finest groups, once; wider parts and the groups are sums of them
            finest = keyed.groupBy(*levels[0], "_event").agg(F.count(F.lit(1)).alias("n"), F.sum("_log").alias("s")).persist()
            for i, keys in enumerate(levels):
                parts = finest if i == 0 else finest.groupBy(*keys, "_event").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
                self.parts[chain, i] = parts
                self.groups[chain, i] = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        self.members = bar_set(keyed.where("event_id is not null"), ["_event"])
        return self

    def fit_transform(self, df, train):
        """The same in one pass: the event's parts are windows over rows that lie together by event; groups are looked up.

        Rows dealt by event already (`listings_by_event`) aren't shuffled again unless a table of groups is large.
        """
        keep, train, price = df.columns, F.coalesce(train, F.lit(False)), F.col("listing_price")
        log = F.log1p(F.coalesce(price, F.lit(0.0)))
        keyed = self._keyed(df.where(train), True)
        finest = F.array(*[F.struct(F.lit(chain).alias("chain"), F.array(*levels[0]).alias("keys")) for chain, (_, levels) in self.CHAINS.items()], F.when(price.isNotNull(), F.struct(F.lit("all").alias("chain"), F.array().cast("array<string>").alias("keys"))))
        sums = [F.sum("n").alias("n"), F.sum("s").alias("s")]
        finest = keyed.select(F.explode(finest).alias("of"), log.alias("s")).where("of IS NOT NULL").groupBy("of.chain", "of.keys").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
        wider = F.lit(None)
        for chain, (_, levels) in self.CHAINS.items():
            at = {k: F.col("keys")[i] for i, k in enumerate(levels[0])}
            wider = F.when(F.col("chain") == chain, F.array(*[F.struct(F.lit(f"{chain}{i}").alias("level"), F.array(*[at[k] for k in keys]).alias("keys")) for i, keys in enumerate(levels)])).otherwise(wider)
        wider = F.coalesce(wider, F.array(F.struct(F.lit("all").alias("level"), F.col("keys"))))
        levels = finest.select(F.explode(wider).alias("of"), "n", "s").groupBy("of.level", "of.keys").agg(*sums)
        names = {f"{chain}{i}": keys for chain, (_, levels) in self.CHAINS.items() for i, keys in enumerate(levels)}
        tables = stored_by(levels, "level", ["all", *names], "cold-start")
        self.g = next((r.s / r.n for r in tables["all"].collect()), 5.017279836814924)  # log1p(150)
        df = self._keyed(df, False).withColumns({"_log": log, "_c": S.cents(price), "_t": train, "_filled": train & ((F.col("seat_zone") != "") if "seat_zone" in df.columns else F.lit(True))})
        own = F.max(F.col("_t") & F.col("event_id").isNotNull() & price.isNotNull()).over(W.partitionBy("_event", "_c"))
        df = df.withColumn("_own", F.coalesce(own & F.col("_c").isNotNull(), F.lit(False)))
        for chain, (_, levels) in self.CHAINS.items():
            order = list(dict.fromkeys(k for keys in reversed(levels) for k in keys))  # the wider level's keys first: one sort
            counts = F.coalesce("_filled" if chain == "sz" else "_t", F.lit(False))  # an empty zone of a training row is looked up by none
            for i, keys in enumerate(levels):
                at = W.partitionBy("_event", *[k for k in order if k in keys])
                df = df.withColumns({f"p_{chain}{i}_n": F.count_if(counts).over(at), f"p_{chain}{i}_s": F.sum(F.when(counts, F.col("_log"))).over(at)})
        for level, keys in names.items():
            groups = broadcast_if_small(tables[level]).select(*[F.col("keys")[i].alias(k) for i, k in enumerate(keys)], F.col("n").alias(f"g_{level}_n"), F.col("s").alias(f"g_{level}_s"))
            df = df.join(groups, keys, "left")
        return self._features(df, keep)

    def transform(self, df, is_train=False):
        keep = df.columns
        df = with_membership(self._keyed(df, False), self.members, ["_event"], "_own")
        for chain, (_, levels) in self.CHAINS.items():
            for i, keys in enumerate(levels):
                df = lookup(lookup(df, self.groups[chain, i], keys, f"g_{chain}{i}_"), self.parts[chain, i], [*keys, "_event"], f"p_{chain}{i}_")
        return self._features(df, keep)

    def _features(self, df, keep):
        means, supports = [], []
        for chain, (m, levels) in self.CHAINS.items():
            steps = []
            for i in range(len(levels)):
                a, b = f"g_{chain}{i}_", f"p_{chain}{i}_"
                out = lambda c, b=b: F.when(F.col("_own"), F.coalesce(F.col(f"{b}{c}"), F.lit(0))).otherwise(F.lit(0))
                n = F.coalesce(F.col(f"{a}n"), F.lit(0)) - out("n")
                steps.append((n, F.col(f"{a}s") - out("s")))
            mean = F.lit(self.g)
            for n, s in reversed(steps):
                mean = F.when(n > 0, (s + m * F.lit(self.g)) / (n + m)).otherwise(mean)
            means.append(mean)
            supports.append(F.coalesce(F.col(f"g_{chain}0_n"), F.lit(0)).cast("double"))
        return df.select(*keep, *[c.alias(n) for c, n in zip(means + supports, self.names, strict=True)])


class WithinEvent(Extractor):
    """An event's own history up to a row: strictly before it on training rows, up to it on others.

    One sorted window pass per event instead of an array of history on every row: training rows are the history, and
    probes are ordered into it, so memory per task doesn't grow with rows times history.
    """

    names = ["we_pos_in_sequence", "we_time_since_first_hours", "we_age_percentile", "we_rolling5_dev", "we_zone_price_at_t", "we_history_support"]
    uses_train_flag = True

    def fit(self, df):
        self.zone = next((c for c in ("seat_zone", "section", "zone") if c in df.columns), None)
        self.history = df.where("event_id is not null and timestamp is not null and listing_price is not null").select("event_id", S.micros(F.col("timestamp")).alias("_t"), F.col("listing_price").alias("_p"), (F.coalesce(F.col(self.zone), F.lit("")) if self.zone else F.lit("")).alias("_z"))
        self.sizes = self.history.groupBy("event_id").agg(F.count(F.lit(1)).alias("size"))
        return self

    def transform(self, df, is_train=False):
        keep = df.columns
        zone = F.coalesce(F.col(self.zone), F.lit("")) if self.zone and self.zone in df.columns else F.lit("")
        rows = df.withColumns({"_t": S.micros(F.col("timestamp")), "_z": zone, "_row": F.struct(*keep)})
        both = rows.select("event_id", "_t", "_z", F.lit(None).cast("double").alias("_p"), "_row").unionByName(self.history.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
        # strictly before: probes come first among equal times; else last
        side = F.when(F.col("_row").isNotNull(), 0 if is_train else 1).otherwise(1 if is_train else 0)
        both = both.withColumn("_side", side)
        order = W.partitionBy("event_id").orderBy("_t", "_side", "_p")
        before = order.rowsBetween(W.unboundedPreceding, W.currentRow)
        price = F.col("_p")
        both = both.withColumn("_k", F.count(price).over(before)).withColumn("_first", F.min(F.when(price.isNotNull(), F.col("_t"))).over(W.partitionBy("event_id")))
        # each history row knows its last five; a probe takes those of the last history row before it
        recent = F.collect_list(price).over(W.partitionBy("event_id", price.isNull()).orderBy("_t", "_p").rowsBetween(-4, 0))
        both = both.withColumn("_recent", F.when(price.isNotNull(), recent))
        five = F.last("_recent", ignorenulls=True).over(before)
        numbered = both.withColumn("_five", F.get(F.sort_array(five), F.lit(2)))
        in_zone = W.partitionBy("event_id", "_z").orderBy("_t", "_side", "_p").rowsBetween(W.unboundedPreceding, W.currentRow)
        numbered = numbered.withColumn("_zoned", F.percentile(price, F.lit(0.5)).over(in_zone)).where("_row is not null")
        numbered = lookup(numbered, self.sizes, ["event_id"], "h_")
        size = F.coalesce("h_size", F.lit(0))
        own = F.col("_row.listing_price")
        ratio = lambda mid: F.when((own > 0) & (mid > 0), F.log(own / mid)).otherwise(0.0)
        k = F.when(size > 0, F.col("_k")).otherwise(0)
        out = [k.cast("double"), F.when(k > 0, (F.col("_t") - F.col("_first")) / 3.6e9).otherwise(0.0), k / F.greatest(size, F.lit(1)), F.when(k >= 5, ratio(F.col("_five"))).otherwise(0.0), F.when(F.col("_zoned").isNotNull() & (F.col("_z") != ""), ratio(F.col("_zoned"))).otherwise(0.0), size.cast("double")]
        return numbered.select("_row.*", *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Section(Extractor):
    names = ["section_number", "section_level", "row_quality", "is_named_section", "sec_is_ga", "sec_is_vip", "sec_is_floor", "is_obstructed", "section_name_hash", "has_row_info", "section_word_count", "venue_section_count"]

    def fit(self, df):
        self.venues = df.where("venue_name is not null").groupBy("venue_name").agg(F.log1p(F.count_distinct("section").cast("double")).alias("sections"))
        return self

    def transform(self, df, is_train=False):
        keep, s = df.columns, F.coalesce(F.col("section"), F.lit(""))
        row = col_or(df, "row", F.lit(None).cast("string"))
        df = lookup(df, self.venues, ["venue_name"], "v_")
        told = row.isNotNull() & (S.strip(row) != "")
        named = S.has(s, S.NAMED_WORDS) | ~s.rlike("[0-9]")
        out = [S.section_number(s), S.section_level(s), S.row_quality(row), named.cast("int"), *[S.has(s, w).cast("int") for w in (S.GA_WORDS, S.VIP_WORDS, S.FLOOR_WORDS, S.OBSTRUCTED_WORDS)], S.section_hash(s), told.cast("int"), S.word_count(s), F.coalesce("v_sections", F.lit(0.0))]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class ListingStructural(Extractor):
    names = ["seat_number", "seat_span", "is_low_seat_number", "is_unknown_seat", "row_bucket_encoded", "event_section_row_median_price", "event_section_row_listing_count", "row_bucket_section_count"]
    uses_train_flag = True
    KEYS = ["event_id", "section", "_bucket"]

    def __init__(self, group_smoothing: float = 8, prior_smoothing: float = 20):
        self.m, self.prior_m = group_smoothing, prior_smoothing

    def fit(self, df):
        self.g = global_stats(df)["mean"]
        df = self.hold(df.select("event_id", "section", "listing_price", S.row_bucket(F.col("row")).alias("_bucket")))
        self.events = price_stats(df, ["event_id"]).select("event_id", "mean")
        es = lookup(price_stats(df, ["event_id", "section"]), self.events, ["event_id"], "e_")
        self.priors = es.select("event_id", "section", smooth(F.col("n"), F.col("mean"), self.prior_m, F.coalesce("e_mean", F.lit(self.g))).alias("prior"))
        self.groups = price_stats(df, self.KEYS).select(*self.KEYS, "n", "total", "mean")
        self.members = bar_set(df.where("event_id is not null and section is not null"), self.KEYS)
        self.spread = df.where("event_id is not null").groupBy("event_id", "_bucket").agg(F.least(F.count_distinct("section"), F.lit(50)).alias("sections"))
        return self

    def fit_transform(self, df, train, is_train=False):
        """The same in one pass over rows dealt by event (`listings_by_event`): every statistic is a window inside the event.

        With is_train the training rows alone are transformed, as such.
        """
        keep, m, train = df.columns, self.prior_m, F.coalesce(train, F.lit(False))
        row = df.where(train).agg(F.avg("listing_price").alias("mean")).collect()[0]
        self.g = 150.0 if row["mean"] is None else row["mean"]
        df = df.where(train) if is_train else df
        known, placed = F.col("event_id").isNotNull(), F.col("event_id").isNotNull() & F.col("section").isNotNull()
        df = df.withColumns({"_bucket": S.row_bucket(col_or(df, "row", F.lit(None).cast("string"))), "_event": by_event(), "_fits": train & known, "_p": F.when(train & known, F.col("listing_price"))})
        p, at = F.col("_p"), W.partitionBy("_event", "section", "_bucket")
        df = df.withColumn("_first", F.row_number().over(at.orderBy(F.col("_fits").desc())))
        df = df.withColumns({"_r_n": F.count(p).over(at), "r_total": F.sum(p).over(at), "r_mean": F.avg(p).over(at)})
        at = W.partitionBy("_event", "section")
        df = df.withColumns({"_s_n": F.count(p).over(at), "_s_mean": F.avg(p).over(at)})
        at = W.partitionBy("_event")
        df = df.withColumns({"_e_n": F.count(p).over(at), "e_mean": F.avg(p).over(at)})
        # a section counts once in a bucket, at its first training row
        once = F.when((F.col("_first") == 1) & F.col("_fits") & F.col("section").isNotNull(), 1)
        at = W.partitionBy("_event", "_bucket")
        df = df.withColumns({"_b_n": F.count(F.when(F.col("_fits"), 1)).over(at), "_sections": F.count(once).over(at)})
        e_mean = F.when(known & (F.col("_e_n") > 0), F.col("e_mean"))
        prior = F.when(placed & (F.col("_s_n") > 0), smooth(F.col("_s_n"), F.col("_s_mean"), m, F.coalesce(e_mean, F.lit(self.g))))
        df = df.withColumns({"e_mean": e_mean, "s_prior": prior, "r_n": F.when(placed & (F.col("_r_n") > 0), F.col("_r_n")), "b_sections": F.when(known & (F.col("_b_n") > 0), F.least(F.col("_sections"), F.lit(50)))})
        # a training row with a price is one of those that its group was made of
        df = df.withColumn("_own", placed & F.col("listing_price").isNotNull())
        return self._features(df, keep, is_train)

    def transform(self, df, is_train=False):
        keep = df.columns
        df = df.withColumn("_bucket", S.row_bucket(col_or(df, "row", F.lit(None).cast("string"))))
        for stats, keys, prefix in ((self.events, ["event_id"], "e_"), (self.priors, ["event_id", "section"], "s_"), (self.groups, self.KEYS, "r_"), (self.spread, ["event_id", "_bucket"], "b_")):
            df = lookup(df, stats, keys, prefix)
        if is_train:
            df = with_membership(df, self.members, self.KEYS, "_own")
        return self._features(df, keep, is_train)

    def _features(self, df, keep, is_train):
        none, m = F.lit(None).cast("string"), self.m
        seat, to = S.seat_number(col_or(df, "seat_from", none)), S.seat_number(col_or(df, "seat_to", none))
        prior, n = F.coalesce("s_prior", "e_mean", F.lit(self.g)), F.col("r_n")
        value = smooth(n, F.col("r_mean"), m, prior)
        if is_train:
            rest = F.when(n == 1, prior).otherwise(smooth(n - 1, (F.col("r_total") - F.col("listing_price")) / (n - 1), m, prior))
            value = F.when(F.col("_own"), rest).otherwise(value)
        out = [
            F.when(seat == -1, 0).otherwise(seat), F.when((seat != -1) & (to != -1), F.greatest(F.least(to - seat + 1, F.lit(50)), F.lit(1))).otherwise(1), ((seat != -1) & (seat <= 5)).cast("int"), (seat == -1).cast("int"), S.by_zone(F.col("_bucket"), S.BUCKET_CODE, 4),
            F.when(n.isNull(), prior).otherwise(value), F.log1p(F.coalesce(n, F.lit(0)).cast("double")), F.coalesce("b_sections", F.lit(0)).cast("double"),
        ]
        return df.select(*keep, *[c.alias(x) for c, x in zip(out, self.names, strict=True)])


class Snapshot(Extractor):
    """Fills the columns that the as-of join gives with their training means."""

    names = ["snapshot_inventory_change_rate", "snapshot_zone_price_trend", "snapshot_count", "snapshot_price_range"]
    FROM = ["_snap_inv_rate", "_snap_trend", "_snap_count", "_snap_range"]

    def fit(self, df):
        have = [c for c in self.FROM if c in df.columns]
        row = df.agg(*[F.avg(c).alias(c) for c in have]).collect()[0].asDict() if have else {}
        self.means = {c: row.get(c) or 0.0 for c in self.FROM}
        return self

    def transform(self, df, is_train=False):
        return df.select("*", *[F.coalesce(col_or(df, c, F.lit(None).cast("double")), F.lit(self.means[c])).alias(n) for c, n in zip(self.FROM, self.names, strict=True)])


class Regional(Extractor):
    names = ["artist_regional_avg_price", "artist_regional_median_price", "artist_regional_listing_count", "regional_price_ratio", "artist_country_avg_price", "country_popularity_ratio", "regional_market_strength"]

    def __init__(self, smoothing: float = 75):
        self.m = smoothing

    def fit(self, df):
        m, g = self.m, global_stats(df)
        df = df.where("artist_or_team is not null and city is not null").select("artist_or_team", "listing_price", S.folded(F.col("artist_or_team")).alias("_artist"), S.city_name(F.col("city")).alias("_city"))
        df = self.hold(df.select("*", S.country_of(F.col("_city")).alias("_country"), S.region_of(F.col("_city")).alias("_region")))
        p = F.col("listing_price")
        stat = lambda keys: df.groupBy("artist_or_team", "_artist", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"))
        last = lambda d, keys: d.groupBy("_artist", *keys).agg(F.max_by(F.struct("n", "mean", "median"), "artist_or_team").alias("s")).select("_artist", *keys, "s.*")
        own = stat([])
        self.artists = last(own, [])
        region = lookup(stat(["_region"]), own.select("artist_or_team", "mean", "median"), ["artist_or_team"], "a_")
        self.regions = last(region.withColumn("mean", smooth(F.col("n"), F.col("mean"), m, F.col("a_mean"))).withColumn("median", smooth(F.col("n"), F.col("median"), m, F.col("a_median"))), ["_region"])
        land = stat(["_country"])
        self.countries = last(land.withColumn("mean", smooth(F.col("n"), F.col("mean"), m, F.lit(g["mean"]))).withColumn("median", smooth(F.col("n"), F.col("median"), m, F.lit(g["median"]))), ["_country"])
        self.markets = df.groupBy("_city").agg(F.count_distinct("artist_or_team").alias("artists"))
        self.most = max(1, self.markets.agg(F.max("artists")).collect()[0][0] or 1)
        return self

    def transform(self, df, is_train=False):
        keep = df.columns
        df = df.withColumns({"_artist": S.folded(F.coalesce("artist_or_team", F.lit("None"))), "_city": S.city_name(F.col("city")), "_country": S.country(F.col("city")), "_region": S.region_key(F.col("city"))})
        for stats, keys, prefix in ((self.regions, ["_artist", "_region"], "r_"), (self.countries, ["_artist", "_country"], "c_"), (self.artists, ["_artist"], "a_"), (self.markets, ["_city"], "m_")):
            df = lookup(df, stats, keys, prefix)
        of = lambda c: F.coalesce(f"r_{c}", f"c_{c}", f"a_{c}")
        ratio = lambda x: F.when(x.isNotNull() & (F.col("a_mean") > 0), x / F.col("a_mean")).otherwise(1.0)
        out = [F.coalesce(of("mean"), F.lit(150.0)), F.coalesce(of("median"), F.lit(150.0)), F.log1p(F.coalesce(of("n"), F.lit(0)).cast("double")), ratio(of("mean")), F.coalesce("c_mean", F.lit(150.0)), ratio(F.col("c_mean")), F.coalesce(F.col("m_artists") / self.most, F.lit(0.5))]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Popularity(Extractor):
    """Scores of artists from a table of counts (artist, youtube_subscribers, youtube_views, lastfm_listeners, lastfm_play_count)."""

    names = ["popularity_score", "popularity_tier_encoded", "youtube_subscribers_log", "youtube_views_log", "lastfm_listeners_log", "lastfm_play_count_log", "popularity_data_available"]

    def __init__(self, counts: DataFrame):
        self.counts = counts

    def fit(self, df):
        from corvane.operators.popularity import scored

        self.table = scored(self.counts).withColumn("_artist", S.folded(F.col("artist"))).drop("artist")
        return self

    def transform(self, df, is_train=False):
        keep = df.columns
        df = lookup(df.withColumn("_artist", S.folded(F.col("artist_or_team"))), self.table, ["_artist"], "p_")
        log = lambda c: F.when(F.col(c) > 0, F.log10(F.col(c).cast("double"))).otherwise(0.0)
        tier = F.when(F.col("p_tier") == "high", 2).when(F.col("p_tier") == "medium", 1).otherwise(0)
        out = [F.coalesce("p_score", F.lit(0.0)), tier, *[log(f"p_{c}") for c in ("youtube_subscribers", "youtube_views", "lastfm_listeners", "lastfm_play_count")], F.col("p_score").isNotNull().cast("int")]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class ListingContext(Extractor):
    names = ["source_encoded", "quantity_filled", "is_single_ticket", "is_pair"]

    def transform(self, df, is_train=False):
        q = F.coalesce(col_or(df, "quantity", 1), F.lit(1))
        out = [F.when(col_or(df, "source", "") == "stubhub", 1).otherwise(0), q, (q == 1).cast("int"), (q == 2).cast("int")]
        return df.select("*", *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Venue(Extractor):
    names = ["venue_avg_price", "venue_median_price", "venue_price_std", "is_known_venue"]

    def __init__(self, smoothing: float = 75):
        self.m = smoothing

    def fit_stored(self, df, g, cuts):
        """fit for a stored df, its global statistics and price cuts: no rows are dealt but those near a median."""
        self.g, p = g, F.col("listing_price")
        rows = df.where("venue_name is not null")
        by = stored(rows.groupBy("venue_name").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.coalesce(F.stddev_samp(p), F.lit(g["std"])).alias("std")), "venues")
        return self._venues(by.join(broadcast_if_small(medians_by_parts(rows.where(p.isNotNull()), ["venue_name"], cuts)), "venue_name", "left"))

    def fit(self, df):
        g = self.g = global_stats(df)
        p = F.col("listing_price")
        by = df.where("venue_name is not null").groupBy("venue_name").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.coalesce(F.stddev_samp(p), F.lit(g["std"])).alias("std"))
        return self._venues(by)

    def _venues(self, by):
        m, g = self.m, self.g
        own = F.struct(*[smooth(F.col("n"), F.col(c), m, F.lit(g[c])).alias(c) for c in ("mean", "median", "std")])
        self.venues = by.withColumn("_venue", S.folded(F.col("venue_name"))).groupBy("_venue").agg(F.max_by(own, "venue_name").alias("s")).select("_venue", "s.*")
        return self

    def transform(self, df, is_train=False):
        keep = df.columns
        if "venue_name" not in keep:
            return df.select("*", *[F.lit(0.0).alias(n) for n in self.names])
        return self.looked_up(df.withColumn("_venue", S.folded(F.col("venue_name"))), keep)

    def looked_up(self, df, keep):
        """transform for rows with `_venue`."""
        g = self.g
        df = lookup(df, self.venues, ["_venue"], "v_")
        out = [*[F.coalesce(f"v_{c}", F.lit(g[c])) for c in ("mean", "median", "std")], F.col("v_mean").isNotNull().cast("double")]
        return df.select(*keep, *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Interaction(Extractor):
    names = ["artist_zone_price", "popularity_zone", "urgency_zone", "artist_city_tier", "days_to_event_log", "price_per_urgency", "artist_venue_price"]
    stage = "post"

    def fit(self, df):
        self.median = (exact_percentiles(df, "venue_median_price", [0.5])[0] if "venue_median_price" in df.columns else None) or 0.0
        return self

    def transform(self, df, is_train=False):
        avg, ratio = col_or(df, "artist_avg_price", 0.0), col_or(df, "zone_price_ratio", 0.5)
        days = col_or(df, "days_to_event_filled", 30)
        out = [avg * ratio, col_or(df, "popularity_score", 0.0) * ratio, col_or(df, "urgency_bucket", 2) * ratio, avg * col_or(df, "city_tier", 3), F.log1p(F.greatest(days, F.lit(0)).cast("double")), avg / (days + 1), avg * col_or(df, "venue_median_price", 0.0) / max(self.median, 1.0)]
        return df.select("*", *[c.alias(n) for c, n in zip(out, self.names, strict=True)])


class Momentum(Extractor):
    """Off by default: passes given columns on, else neutral values."""

    names = ["price_momentum_7d", "price_momentum_30d", "price_vs_initial", "price_volatility"]

    def transform(self, df, is_train=False):
        return df.select(*[c for c in df.columns if c not in self.names], *[F.coalesce(col_or(df, n, F.lit(None).cast("double")), F.lit(d)).alias(n) for n, d in zip(self.names, (0.0, 0.0, 1.0, 0.0), strict=True)])


DEFAULT = {"performer": Performer, "event": Event, "seating": Seating, "time": TimeSeries, "event_pricing": EventPricing, "relative_pricing": RelativePricing, "cold_start": ColdStart, "within_event": WithinEvent, "section": Section, "listing_structural": ListingStructural, "snapshot": Snapshot, "regional": Regional, "listing_context": ListingContext, "venue": Venue, "interaction": Interaction}


class FeaturePipeline:
    """Extractors in order, base before post; every extractor is fitted on training rows only."""

    def __init__(self, without: tuple = (), counts: DataFrame | None = None, momentum: bool = False, parameters: dict | None = None):
        chosen = {n: c(**(parameters or {}).get(n, {})) for n, c in DEFAULT.items() if n not in without}
        if counts is not None:
            chosen["popularity"] = Popularity(counts)
        if momentum:
            chosen["momentum"] = Momentum()
        self._kept: list[DataFrame] = []
        self.extractors = dict(sorted(chosen.items(), key=lambda x: x[1].stage == "post"))

    @property
    def names(self) -> list[str]:
        return [n for e in self.extractors.values() for n in e.names]

    def fit(self, df: DataFrame) -> FeaturePipeline:
        shared = None
        for e in self.extractors.values():
            if e.stage == "base":
                if type(e) is RelativePricing and shared is not None and shared.m == e.m:
                    e.__dict__.update(shared.__dict__)  # the same tables
                else:
                    self._keep(e.fit(df))
                shared = e if type(e) is EventPricing else shared
        base = df
        for e in self.extractors.values():
            if e.stage == "post":
                base = self._run(df, "base", True) if base is df else base
                e.fit(base)
        return self

    def _keep(self, e: Extractor) -> None:
        """Statistics are read by every split, so they are computed once; `release` lets them go."""
        for name, value in vars(e).items():
            if isinstance(value, DataFrame) and name not in ("counts", "history", "_held"):
                self._kept.append(value.persist())
            elif isinstance(value, dict):
                self._kept += [v.persist() for v in value.values() if isinstance(v, DataFrame)]

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()
        for e in self.extractors.values():
            e.release()

    def _run(self, df: DataFrame, stage: str, is_train: bool) -> DataFrame:
        for e in self.extractors.values():
            if e.stage == stage:
                df = e.transform(df, is_train)
        return df

    def transform(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        return self._run(self._run(df, "base", is_train), "post", is_train)

    def matrix(self, df: DataFrame, key: str = "listing_id", is_train: bool = False) -> DataFrame:
        """The key and the features alone, in order, under their public names."""
        return self.transform(df, is_train).select(key, *[F.col(n).alias(PUBLIC.get(n, n)) for n in self.names])


#: Features that share a name with the raw column that they fill in.
PUBLIC = {"days_to_event_filled": "days_to_event", "quantity_filled": "quantity"}
