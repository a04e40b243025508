"""Group statistics shared by the extractors: smoothing, adjusted skewness, look-ups with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from corvane.plans.canonical import broadcast_if_small
from corvane.plans.shared import stored


def smooth(n, x, m: float, prior) -> Column:
    """(n x + m prior) / (n + m)."""
    return (n * x + prior * m) / (n + m)


def price_stats(df: DataFrame, keys: list[str], price: str = "listing_price") -> DataFrame:
    """n, total, mean, median and sample deviation (0 of one value) by keys; groups with a null key or without prices don't count."""
    rows = df.where(F.col(price).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    p = F.col(price)
    return rows.groupBy(*keys).agg(F.count(p).alias("n"), F.sum(p).alias("total"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("std"))


def price_stats_by_ranges(df: DataFrame, keys: list[str], price: str = "listing_price", reach: float = 1 / 512) -> DataFrame:
    """price_stats for few keys with many rows each, as a stored table: of the rows of a stored df only those near the middle are dealt by key.

    Approximate percentiles a little below and above the half give the range that holds it; what lies below is counted, and
    the median is picked inside the range. Should it lie outside for a key, price_stats does it.
    """
    p = F.col(price)
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (price, *keys)))
    ends = F.percentile_approx(p, [0.5 - reach, 0.5 + reach], 10_000)
    base = stored(rows.groupBy(*keys).agg(F.count(p).alias("n"), F.sum(p).alias("total"), F.avg(p).alias("mean"), ends.alias("_ends"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("std")), "price-stats")
    near = rows.join(broadcast_if_small(base.select(*keys, "n", F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))), keys).where(p <= F.col("_high"))
    values = near.groupBy(*keys, "n", F.when(p >= F.col("_low"), p).alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    values = values.withColumn("_upto", F.sum("_k").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_x"))))
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_k") <= rank), F.col("_x")))
    middle = values.groupBy(*keys).agg(at(F.floor((F.col("n") - 1) / 2)).alias("_a"), at(F.floor(F.col("n") / 2)).alias("_b"))
    median = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b"))
    out = stored(base.join(broadcast_if_small(stored(middle.select(*keys, median.alias("median")), "medians")), keys, "left").select(*keys, "n", "total", "mean", "median", "std"), "price-stats")
    return out if out.where("median IS NULL").isEmpty() else stored(price_stats(df, keys, price), "price-stats")


def price_cuts(df: DataFrame, price: str = "listing_price", parts: int = 64) -> list[float]:
    """Prices that cut the rows into parts of about the same length, for `medians_by_parts`."""
    found = df.agg(F.percentile_approx(price, [i / parts for i in range(1, parts)], 1_000)).collect()[0][0]
    return sorted(set(found or []))


def _part(price: str, cuts: list[float], first: int = 0) -> str:
    """How many of the ascending cuts are below the price, as nested cases."""
    if not cuts:
        return str(first)
    mid = len(cuts) // 2
    return f"CASE WHEN {price} > CAST({cuts[mid]!r} AS DOUBLE) THEN {_part(price, cuts[mid + 1 :], first + mid + 1)} ELSE {_part(price, cuts[:mid], first)} END"


def medians_by_parts(df: DataFrame, keys: list[str], cuts: list[float], price: str = "listing_price") -> DataFrame:
    """keys, median of a stored df without null prices and keys, as a stored table.

    Rows are counted by key and part of the price range; only those in the part that holds a key's middle are dealt by key.
    """
    at = lambda rank, upto, k: (upto > rank) & (upto - k <= rank)
    low, high, upto, k = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2), F.col("_upto"), F.col("_k")
    df = df.select(*keys, F.col(price).alias("_x"), F.expr(_part(f"`{price}`", cuts)).alias("_part"))
    counts = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.withColumns({"_upto": F.sum("_k").over(W.partitionBy(*keys).orderBy("_part")), "_n": F.sum("_k").over(W.partitionBy(*keys))})
    parts = stored(counts.where(at(low, upto, k) | at(high, upto, k)).select(*keys, "_part", "_n", (upto - k).alias("_below")), "price-parts")
    values = df.join(broadcast_if_small(parts), [*keys, "_part"]).groupBy(*keys, "_part", "_n", "_below", "_x").agg(F.count(F.lit(1)).alias("_k"))
    values = values.withColumn("_upto", F.col("_below") + F.sum("_k").over(W.partitionBy(*keys, "_part").orderBy("_x")))
    found = values.groupBy(*keys).agg(F.max(F.when(at(low, upto, k), F.col("_x"))).alias("_a"), F.max(F.when(at(high, upto, k), F.col("_x"))).alias("_b"))
    return stored(found.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b")).alias("median")), "medians")


def adjusted_skewness(x: Column, over: WindowSpec | None = None) -> Column:
    """Bias-corrected; 0 of fewer than three values or of equal ones."""
    n, g = F.count(x), F.skewness(x)
    n, g = (n, g) if over is None else (n.over(over), g.over(over))
    fixed = g * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n < 3) | g.isNull() | F.isnan(g), 0.0).otherwise(fixed)


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def lookup(df: DataFrame, stats: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Left join of statistics, their columns prefixed. The optimizer broadcasts a side whose size allows it."""
    return df.join(prefixed(stats, prefix, keys), keys, "left")


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row as one row, without a join."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def exact_percentiles(df: DataFrame, column: str, probs: list[float], n: int | None = None, parts: int = 512, small: int = 20_000, kept: bool = False) -> list:
    """The percentiles that F.percentile gives, without gathering all distinct values in one task where there may be many.

    Approximate percentiles a little below and above each wanted one give the range it lies in (a share of 2 / parts of
    the rows); one pass counts what lies below the ranges and inside, and only the ranges are looked into, by counts of
    their distinct values. Should a wanted rank lie outside its range, the ranges are widened. The column is held for
    these passes unless the caller has `kept` its rows. Up to `small` rows one aggregation does it.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    if n is not None and n <= small:
        return rows.agg(F.percentile("x", probs)).collect()[0][0] or [None] * len(probs)
    rows = rows if kept else rows.persist()
    try:
        n = rows.count() if n is None else n
        if n <= small:
            return rows.agg(F.percentile("x", probs)).collect()[0][0] or [None] * len(probs)
        return _by_ranges(rows, probs, n, 1 / parts)
    finally:
        if not kept:
            rows.unpersist()


def _by_ranges(rows: DataFrame, probs: list[float], n: int, reach: float) -> list:
    ends = [x for p in probs for x in (max(0.0, p - reach), min(1.0, p + reach))]
    cuts = rows.agg(F.percentile_approx("x", ends, max(10_000, int(20 / reach)))).collect()[0][0]
    open_at = lambda i: ends[i] in (0.0, 1.0)
    spans = sorted(((None if open_at(i) else cuts[i], None if open_at(i + 1) else cuts[i + 1]) for i in range(0, len(ends), 2)), key=lambda s: (s[0] is not None, s[0] or 0.0))
    ranges: list[tuple] = []
    for low, high in spans:  # overlapping ones become one
        if ranges and (low is None or ranges[-1][1] is None or low <= ranges[-1][1]):
            first, last = ranges.pop()
            low, high = first, None if last is None or high is None else max(last, high)
        ranges.append((low, high))
    x = F.col("x")
    below = [F.lit(False) if low is None else x < low for low, _ in ranges]
    inside = [~b & (F.lit(True) if high is None else x <= high) for b, (_, high) in zip(below, ranges, strict=True)]
    counted = rows.agg(*[F.count_if(c) for c in (*below, *inside)]).collect()[0]
    firsts, sizes = dict(enumerate(counted[: len(ranges)])), counted[len(ranges) :]
    ranks = sorted({r for p in probs for r in (int((n - 1) * p), -int(-((n - 1) * p) // 1))})
    of = {r: part for r in ranks for part, first in firsts.items() if first <= r < first + sizes[part]}
    if len(of) < len(ranks):
        return _by_ranges(rows, probs, n, 8 * reach)
    part = F.lit(None).cast("int")
    for i, c in enumerate(inside):
        part = F.when(c, i).otherwise(part)
    values = rows.withColumn("part", part).where("part is not null").groupBy("part", "x").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(W.partitionBy("part").orderBy("x"))
    hit = [(F.col("part") == part) & (F.col("upto") > r - firsts[part]) & (F.col("upto") - F.col("k") <= r - firsts[part]) for r, part in of.items()]
    found = values.withColumn("upto", upto).select("x", F.array(*hit).alias("hit")).where(F.exists("hit", lambda h: h)).collect()
    at = {r: row["x"] for row in found for r, h in zip(ranks, row["hit"], strict=True) if h}
    out = []
    for p in probs:
        place = (n - 1) * p
        low, high = int(place), -int(-place // 1)
        out.append(at[low] if low == high or at[low] == at[high] else (high - place) * at[low] + (place - low) * at[high])
    return out


def global_stats(df: DataFrame, price: str = "listing_price", kept: bool = False) -> dict:
    """kept: the rows of df are stored already."""
    p = F.col(price)
    df = df.select(price) if kept else df.select(price).persist()
    row = df.agg(F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), adjusted_skewness(p).alias("skew"), F.avg((p > 200).cast("double")).alias("premium"), F.count(p).alias("n")).collect()[0].asDict()
    row["q25"], row["median"], row["q75"] = exact_percentiles(df, price, [0.25, 0.5, 0.75], row["n"], kept=True)
    if not kept:
        df.unpersist()
    return row | {"mean": 150.0 if row["mean"] is None else row["mean"], "median": 150.0 if row["median"] is None else row["median"], "std": 50.0 if row["std"] is None else row["std"], "premium": 0.5 if row["premium"] is None else row["premium"]}


def bar_set(df: DataFrame, keys: list[str], price: str = "listing_price") -> DataFrame:
    """The distinct (keys, cents) that training rows have: what a row must match to count as one of them."""
    from corvane.functions.scalars import cents

    return df.where(F.col(price).isNotNull()).select(*keys, cents(F.col(price)).alias("_cents")).distinct().withColumn("_member", F.lit(True))


def with_membership(df: DataFrame, members: DataFrame, keys: list[str], to: str, price: str = "listing_price") -> DataFrame:
    from corvane.functions.scalars import cents

    out = df.withColumn("_cents", cents(F.col(price))).join(members, [*keys, "_cents"], "left")
    return out.withColumn(to, F.coalesce("_member", F.lit(False))).drop("_member", "_cents")
