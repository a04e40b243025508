"""Regression and classification metrics as aggregates, leaderboards and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.stats import exact_percentiles, side_by_side


def regression(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: n, mae, rmse, r2, mape (of actual values other than 0)."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    n = F.count(y)
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return df.where(y.isNotNull() & p.isNotNull()).agg(n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(0.0).alias("r2"), (F.avg(F.when(y != 0, F.abs(e / y))) * 100).alias("mape"))


def by_quartile(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    q = [x or 0.0 for x in exact_percentiles(df, actual, [0.25, 0.5, 0.75])]
    y = F.col(actual)
    quartile = F.when(y <= q[0], "Q1").when(y <= q[1], "Q2").when(y <= q[2], "Q3").otherwise("Q4")
    return df.groupBy(quartile.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - F.col(predicted))).alias("mae"))


def by_zone(df: DataFrame, zone: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))


def seen_breakdown(df: DataFrame, train: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: mae over all, over rows of seen and unseen events, over the top (at least 0.9 p95); share of unseen events among distinct events."""
    seen = train.where("event_id is not null").select("event_id").distinct().withColumn("_seen", F.lit(True))
    top = 0.9 * (exact_percentiles(df, actual, [0.95])[0] or 0.0)
    e = F.abs(F.col(actual) - F.col(predicted))
    rows = df.join(seen, "event_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False))).withColumn("_e", e)
    events = F.count_distinct("event_id")
    return rows.agg(
        F.avg("_e").alias("overall_mae"), F.avg(F.when(F.col("_seen"), F.col("_e"))).alias("seen_mae"), F.avg(F.when(~F.col("_seen"), F.col("_e"))).alias("unseen_mae"), F.avg(F.when(F.col(actual) >= top, F.col("_e"))).alias("q4_mae"),
        F.count_if(F.col("_seen")).alias("n_seen"), F.count_if(~F.col("_seen")).alias("n_unseen"), F.when(events > 0, F.count_distinct(F.when(~F.col("_seen"), F.col("event_id"))) / events * 100).otherwise(0.0).alias("unseen_event_pct"),
    )


def classification(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: n, auc (rank sum over distinct scores), precision, recall, f1 (0 where undefined)."""
    per = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)  # one row per distinct score
    area = per.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0))).agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    hit, said, true = (F.col(score) >= threshold) & (F.col(label) == 1), F.col(score) >= threshold, F.col(label) == 1
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("true"))
    both = side_by_side(area, counts)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = both.withColumn("precision", ratio("tp", "said")).withColumn("recall", ratio("tp", "true"))
    p, r = F.col("precision"), F.col("recall")
    return both.select("n", F.when(F.col("p") * F.col("q") > 0, F.col("area") / (F.col("p") * F.col("q"))).alias("auc"), p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def calibration(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """bin, n, mean score and share of positives; bins are closed on the right."""
    which = F.greatest(F.ceil(F.col(score) * bins), F.lit(1)).cast("int")
    return df.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positives"))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.avg(F.abs(F.col("positives") - F.col("mean_score"))), F.lit(0.0)).alias("ece"))


def leaderboard(runs: DataFrame, limit: int | None = None, by: str = "mae") -> DataFrame:
    """Per version: folds, mean and sample deviation, last time and the commit of it; best first, nulls last."""
    value = F.coalesce("primary_mae", "overall_mae")
    out = runs.groupBy("version").agg(F.count(F.lit(1)).alias("folds"), F.avg(value).alias("mae"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("mae_std"), F.max("timestamp").alias("last_at"), F.max_by("commit", F.struct("timestamp", "commit")).alias("last_commit"))
    out = out.orderBy(F.asc_nulls_last("mae") if by == "mae" else F.desc("last_at"), "version")
    return out.limit(limit) if limit else out


def stalled(runs: DataFrame, order: str = "seq", value: str = "mae", rows: int = 4, least: float = 1.0) -> DataFrame:
    """One row: whether the last improvements (of `rows` runs) are all under `least`."""
    last = runs.orderBy(F.desc(order)).limit(rows)
    step = last.withColumn("gain", F.lag(value).over(W.orderBy(order)) - F.col(value))
    return step.agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.count_if(F.col("gain") < least), F.lit(0)).alias("n_small")).select("n_runs", ((F.col("n_runs") >= rows) & (F.col("n_small") == rows - 1)).alias("stalled"))


def events_per_artist(df: DataFrame) -> DataFrame:
    n = df.where("artist_or_team is not null").groupBy("artist_or_team").agg(F.count_distinct("event_id").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 10, "4-10").otherwise("11+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("artists"))


def city_months(df: DataFrame, thin: int = 5) -> DataFrame:
    key = F.concat(F.col("city"), F.lit(" | "), F.date_format("event_datetime", "yyyy-MM"))
    out = df.where("city is not null and event_datetime is not null").groupBy(key.alias("city_month")).agg(F.count_distinct("event_id").alias("events"))
    return out.withColumn("thin", F.col("events") < thin)


def low_count_gate(train: DataFrame, test: DataFrame, share: float = 0.3) -> DataFrame:
    """Per artist of the test rows: train events, whether under the p30 threshold, whether unseen."""
    per = train.where("artist_or_team is not null").groupBy("artist_or_team").agg(F.count_distinct("event_id").alias("train_events"))
    cut = per.agg(F.percentile("train_events", share)).collect()[0][0] or 0.0
    out = test.where("artist_or_team is not null").select("artist_or_team").distinct().join(per, "artist_or_team", "left")
    n = F.coalesce("train_events", F.lit(0))
    return out.select("artist_or_team", n.alias("train_events"), (n <= cut).alias("gate_on"), (n == 0).alias("unseen"))


def flag_auc(df: DataFrame, flag: str, label: str) -> DataFrame:
    """One row, auc: the area under the curve of a 0/1 feature, which has one corner; null with one class only."""
    f, y = F.col(flag).cast("double"), F.col(label).cast("double")
    hit, false = F.avg(F.when(y == 1, f)), F.avg(F.when(y == 0, f))
    return df.agg((0.5 + (hit - false) / 2).alias("auc"))


def asymmetric_huber(error: Column, delta: float = 1.0, under: float = 2.0) -> Column:
    """Loss of an error (actual less predicted); underestimates weigh `under` times."""
    a = F.abs(error)
    loss = F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))
    return F.when(error > 0, under * loss).otherwise(loss)
