"""Splits, folds, sample weights, caps and target transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators.stats import exact_percentiles


def ranked(df: DataFrame, order: list, to: str = "_rank", parts: int = 256, by: list[str] | None = None) -> DataFrame:
    """Adds a rank from 1, global or within `by`, without putting all rows into one task: ranks within value ranges plus their sums."""
    by = by or []
    lead = order[0]
    number = S.micros(F.col(lead)) if dict(df.dtypes)[lead].startswith("timestamp") else F.col(lead).cast("double")
    cuts = sorted(set(df.agg(F.percentile_approx(number, [k / parts for k in range(1, parts)], 10_000)).collect()[0][0] or []))
    cuts = [float(c) for c in cuts]
    df = df.withColumn("_part", F.when(number.isNull(), -1).otherwise(S.position(number, cuts)))  # nulls come first
    sums = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    if by:  # a key may be null
        key = F.struct(*[F.col(c) for c in by])
        df, sums = df.withColumn("_key", F.xxhash64(key)), sums.withColumn("_key", F.xxhash64(key)).drop(*by)
    df = df.withColumn("_in", inside)
    return df.join(sums, ["_part", *(["_key"] if by else [])]).drop("_key").withColumn(to, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def temporal_split(df: DataFrame, order: list, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split: the first int(n train) rows train, up to int(n (train + val)) val, the rest test."""
    n = df.count()
    a, b = int(n * train), int(n * (train + val))
    return ranked(df, order).withColumn("split", F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= b, "val").otherwise("test")).drop("_rank")


def stratified_split(df: DataFrame, group: str, order: list, train: float = 0.7, val: float = 0.15, least: int = 10) -> DataFrame:
    """The temporal split within each group; groups of under `least` rows train; null groups are dropped."""
    df = df.where(F.col(group).isNotNull())
    df = ranked(df, order, "_r", by=[group]).join(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    a = F.greatest(F.lit(1), F.floor(F.col("_n") * train))
    b = F.greatest(a + 1, F.floor(F.col("_n") * (train + val)))
    return df.withColumn("split", F.when(F.col("_n") < least, "train").when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_n", "_r")


def group_folds(df: DataFrame, group: str, time: str, folds: int = 5) -> DataFrame:
    """(group, fold, part): an expanding window over the groups in order of their first time."""
    first = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(time).alias("_t"))
    total = first.count()
    size = max(1, total // (folds + 1))
    at = first.withColumn("_i", F.row_number().over(W.orderBy("_t", group)) - 1)  # one row per group
    used = [k for k in range(1, folds + 1) if (k + 1) * size < total]
    out = at.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")))
    cut = F.col("fold") * size
    part = F.when(F.col("_i") < cut, "train").when(F.col("_i") < cut + size, "val").when(F.col("_i") < cut + 2 * size, "test")
    return out.withColumn("part", part).where("part is not null").select(group, "fold", "part")


def contiguous_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, fold): the first `groups mod folds` folds hold one more."""
    own = df.select(group).distinct()
    total = own.count()
    base, more = divmod(total, folds)
    i = F.row_number().over(W.orderBy(group)) - 1
    edge = more * (base + 1)
    return own.withColumn("_i", i).withColumn("fold", F.when(F.col("_i") < edge, F.floor(F.col("_i") / (base + 1))).otherwise(more + F.floor((F.col("_i") - edge) / max(1, base))).cast("int")).drop("_i")


def cap_price(df: DataFrame, q: float = 0.95, price: str = "listing_price") -> DataFrame:
    cap = exact_percentiles(df, price, [q])[0]
    return df if cap is None else df.withColumn(price, F.least(F.col(price), F.lit(cap)))


def winsorise(df: DataFrame, zone: str, price: str = "listing_price", least: int = 20) -> DataFrame:
    """Prices clipped to p2 and p98 of their zone; of small zones to p5 and p95 of all."""
    narrow = df.select(zone, price).persist()  # read once for every zone
    sizes = {r[0]: r[1] for r in narrow.groupBy(zone).agg(F.count(price)).collect()}  # there are a handful of zones
    low, high = (F.lit(x) for x in exact_percentiles(narrow, price, [0.05, 0.95], sum(sizes.values()), kept=True))
    for name, n in sizes.items():
        if name is not None and n >= least:
            a, b = exact_percentiles(narrow.where(F.col(zone) == name), price, [0.02, 0.98], n, kept=True)
            own = F.col(zone) == name
            low, high = F.when(own, a).otherwise(low), F.when(own, b).otherwise(high)
    narrow.unpersist()
    return df.withColumn(price, F.least(F.greatest(F.col(price), low), high))


def normalised(df: DataFrame, raw: Column, to: str = "weight") -> DataFrame:
    """Weights that sum to the number of rows; the sum is one aggregate, not a window over everything."""
    df = df.withColumn(to, raw.cast("double"))
    row = df.agg(F.sum(to).alias("s"), F.count(F.lit(1)).alias("n")).collect()[0]
    return df.withColumn(to, F.col(to) * (row["n"] / row["s"])) if row["s"] else df


def weights(df: DataFrame, how: str, price: str = "listing_price", artist: str = "artist_or_team") -> DataFrame:
    """how: inverse_artist_freq, sqrt_price, log_price, inverse_price_quartile (at most 4 : 1) or low_count_upweight."""
    p = F.col(price)
    if how == "sqrt_price":
        return normalised(df, F.sqrt(p))
    if how == "log_price":
        return normalised(df, F.log1p(p))
    if how == "inverse_price_quartile":
        q = exact_percentiles(df, price, [0.25, 0.5, 0.75])
        quartile = sum((p > c).cast("int") for c in q[1:]) + (p > q[0]).cast("int")
        df = df.withColumn("_q", quartile)
        by = df.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"))
        most = by.agg(F.max("_n")).collect()[0][0]
        return normalised(df.join(by, "_q"), F.least(F.lit(most) / F.col("_n"), F.lit(4.0))).drop("_q", "_n")
    by = df.where(F.col(artist).isNotNull()).groupBy(artist).agg((F.count_distinct("event_id") if how == "low_count_upweight" else F.count(F.lit(1))).alias("_n"))
    if how == "inverse_artist_freq":
        return normalised(df.join(by, artist, "left"), 1 / F.coalesce("_n", F.lit(1))).drop("_n")
    if how == "low_count_upweight":
        mid = by.agg(F.median("_n")).collect()[0][0] or 0
        return normalised(df.join(by, artist, "left"), F.when(F.col("_n") < mid, 2.0).otherwise(1.0)).drop("_n")
    raise ValueError(f"no weights named {how}")


class Target:
    """fit on training rows, forward and back on a price column."""

    def fit(self, df: DataFrame, price: str = "listing_price") -> Target:
        return self

    def forward(self, y: Column) -> Column:
        return y

    def back(self, z: Column) -> Column:
        return z

    def prepare(self, df: DataFrame, is_train: bool = False) -> DataFrame:
        """df with the columns that forward and back need."""
        return df


class LogTarget(Target):
    def forward(self, y):
        return F.log1p(y)

    def back(self, z):
        return F.greatest(F.expm1(z), F.lit(0.0))


class SqrtTarget(Target):
    def forward(self, y):
        return F.sqrt(F.greatest(y, F.lit(0.0)))

    def back(self, z):
        return F.greatest(z, F.lit(0.0)) ** 2


class BoxCoxTarget(Target):
    """Lambda by maximum likelihood within [-1, 3]: one aggregate gives the likelihood of a grid, twice refined."""

    def fit(self, df, price="listing_price"):
        y = F.col(price)
        low = df.agg(F.min(y)).collect()[0][0]
        self.shift = 0.0 if low is None or low > 0 else 1.0 - low
        y = y + self.shift
        a, b = -1.0, 3.0
        for _ in range(3):
            grid = [a + (b - a) * k / 20 for k in range(21)]
            row = df.agg(F.count(y).alias("n"), F.sum(F.log(y)).alias("l"), *[F.var_pop(self._power(y, g)).alias(f"v{i}") for i, g in enumerate(grid)]).collect()[0]
            fit = [(g - 1) * (row["l"] or 0.0) - row["n"] / 2 * math.log(row[f"v{i}"]) if row[f"v{i}"] else float("-inf") for i, g in enumerate(grid)]
            best = grid[max(range(21), key=fit.__getitem__)]
            a, b = max(-1.0, best - (b - a) / 20), min(3.0, best + (b - a) / 20)
        self.power = best
        return self

    @staticmethod
    def _power(y, g):
        return F.log(y) if abs(g) < 1e-10 else (y**g - 1) / g

    def forward(self, y):
        return self._power(y + self.shift, self.power)

    def back(self, z):
        raw = F.exp(z) if abs(self.power) < 1e-10 else F.greatest(z * self.power + 1, F.lit(1e-12)) ** (1 / self.power)
        return F.greatest(raw - self.shift, F.lit(0.0))


class RelativeTarget(Target):
    """log1p(price) less its event's smoothed log mean; a training row's own price is taken out of the mean by cents."""

    def __init__(self, smoothing: float = 20):
        self.m = smoothing

    def fit(self, df: DataFrame, price: str = "listing_price") -> RelativeTarget:
        from corvane.operators.stats import bar_set

        self.g = df.agg(F.avg(F.log1p("listing_price"))).collect()[0][0] or 0.0
        self.events = df.where("event_id is not null and listing_price is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log1p("listing_price")).alias("s"))
        self.members = bar_set(df.where("event_id is not null"), ["event_id"])
        return self

    def prepare(self, df, is_train=False):
        return self.base(df, is_train)

    def forward(self, y):
        return F.log1p(y) - F.col("target_base")

    def back(self, z):
        return F.greatest(F.expm1(z + F.col("target_base")), F.lit(0.0))

    def base(self, df: DataFrame, is_train: bool, cold: Column | None = None) -> DataFrame:
        """Adds `target_base`."""
        from corvane.operators.stats import lookup, with_membership

        keep = df.columns
        out = with_membership(lookup(df, self.events, ["event_id"], "t_"), self.members, ["event_id"], "_own")
        n, s, g, m = F.col("t_n"), F.col("t_s"), F.lit(self.g), self.m
        whole = (s + m * g) / (n + m)
        rest = F.when(n == 1, g).otherwise((s - F.log1p("listing_price") + m * g) / (n - 1 + m))
        value = F.when(n.isNull(), g if cold is None else F.coalesce(cold, g)).when(F.col("_own") & F.lit(is_train), rest).otherwise(whole)
        return out.select(*keep, value.alias("target_base"))


TARGETS = {"log": LogTarget, "sqrt": SqrtTarget, "boxcox": BoxCoxTarget, "none": Target, "tweedie_raw": Target, "relative": RelativeTarget}


def target(name: str):
    if name not in TARGETS:
        raise ValueError(f"no target transform named {name}")
    return TARGETS[name]()
