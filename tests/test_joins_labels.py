"""As-of joins, snapshot deltas, labels, dedup and splits by hand-computed values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import cleaning, joins, labels, splits

T0 = datetime(2025, 6, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def snaps(spark, rows):
    return spark.createDataFrame([("e", "upper_tier", at(h), avg * 0.8, avg, avg * 1.2, inv, i) for i, (h, avg, inv) in enumerate(rows)], "event_id string, seat_zone string, timestamp timestamp_ntz, price_min double, price_avg double, price_max double, inventory_remaining int, seq long")


def probe(spark, hour):
    return spark.createDataFrame([(1, "e", "upper_tier", at(hour))], "id int, event_id string, seat_zone string, timestamp timestamp_ntz")


def test_trend_and_rate(spark):
    row = joins.snapshot_features(probe(spark, 11), snaps(spark, [(8, 100.0, 200), (9, 110.0, 190)]), "seq").collect()[0]
    assert row._snap_trend == pytest.approx(0.10)
    row = joins.snapshot_features(probe(spark, 11), snaps(spark, [(8, 100.0, 200), (10, 100.0, 160)]), "seq").collect()[0]
    assert row._snap_inv_rate == pytest.approx(-20.0)


def test_no_earlier_snapshot_gives_zeros(spark):
    row = joins.snapshot_features(probe(spark, 7), snaps(spark, [(8, 100.0, 200)]), "seq").collect()[0]
    assert (row._snap_inv_rate, row._snap_trend, row._snap_count, row._snap_range) == (0.0, 0.0, 0.0, 0.0)


def test_asof_takes_the_last_of_equal_times(spark):
    out = joins.asof(probe(spark, 8), snaps(spark, [(8, 1.0, 1), (8, 2.0, 2)]), ["event_id", "seat_zone"], F.col("timestamp"), "timestamp", ["price_avg"], "seq").collect()[0]
    assert out.price_avg == 2.0


def scrapes(spark, seen):
    rows = [(i, "e", at(h), at(1000), 10.0) for i, hours in seen.items() for h in hours]
    return spark.createDataFrame(rows, "listing_id string, event_id string, timestamp timestamp_ntz, event_datetime timestamp_ntz, listing_price double")


def test_absence_runs(spark):
    df = scrapes(spark, {"all": range(0, 40, 2), "gone": [0, 2], "blink": [h for h in range(0, 40, 2) if h != 4]})
    got = {(r.listing_id, r.timestamp): (r.sold, r.hours_until_disappearance) for r in labels.absence_labels(df).collect()}
    assert got["all", at(0)] == (0, None) and got["blink", at(2)] == (0, None)
    assert got["gone", at(0)] == (1, 4.0) and got["gone", at(2)] == (1, 2.0)
    assert not any(t > at(38 - 24) for _, t in got)
    assert labels.absence_labels(scrapes(spark, {"a": [0, 2, 4]})).count() == 0


def test_depletion(spark):
    rows = snaps(spark, [(0, 1.0, 100), (10, 1.0, 90), (20, 1.0, 80), (48, 1.0, 50), (60, 1.0, 20)])
    out = labels.depletion_labels(probe(spark, 0), rows).collect()
    assert [(r.depletion, r.sold) for r in out] == [(0.5, 1)]


def test_anchored_dedup_and_nulls(spark):
    hours = [0, 5, 7, 12, 13.5]
    df = spark.createDataFrame([(str(i), "e", "s", "r", None, "2", at(h)) for i, h in enumerate(hours)] + [("n1", "e", None, "r", None, None, at(0)), ("n2", "e", None, "r", None, None, at(1))], "listing_id string, event_id string, section string, row string, seat_from string, seat_to string, timestamp timestamp_ntz")
    got = {r.listing_id: r.is_duplicate for r in cleaning.flag_duplicates(df).collect()}
    assert got == {"0": False, "1": True, "2": False, "3": True, "4": False, "n1": False, "n2": False}


def rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("listing_id"), F.expr("concat('a', id % 3)").alias("artist_or_team"), F.expr("concat('e', id div 4)").alias("event_id"), F.expr("timestamp_ntz'2025-01-01' + make_dt_interval(cast(id as int))").alias("event_datetime"), (F.col("id") * 10.0 + 1).alias("listing_price"))


def test_temporal_split(spark):
    got = splits.temporal_split(rows(spark, 100), ["event_datetime", "listing_id"]).groupBy("split").agg(F.count("*").alias("n"), F.min("event_datetime").alias("a"), F.max("event_datetime").alias("z")).collect()
    by = {r.split: r for r in got}
    assert {k: r.n for k, r in by.items()} == {"train": 70, "val": 15, "test": 15}
    assert by["train"].z < by["val"].a and by["val"].z < by["test"].a


def test_ranked_with_ties_and_one_value(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(50)], "id int, v double")
    assert sorted(r._rank for r in splits.ranked(df, ["v", "id"]).collect()) == list(range(1, 51))
    assert splits.temporal_split(df.limit(0), ["v", "id"]).count() == 0


def test_stratified_split_keeps_small_groups_in_train(spark):
    df = rows(spark, 60).unionByName(rows(spark, 9).withColumn("artist_or_team", F.lit("small")))
    got = splits.stratified_split(df, "artist_or_team", ["event_datetime", "listing_id"]).groupBy("artist_or_team", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got if r[0] in ("small", "a0")} == {("small", "train"): 9, ("a0", "train"): 14, ("a0", "val"): 3, ("a0", "test"): 3}


def test_folds_expand(spark):
    got = splits.group_folds(rows(spark, 96), "event_id", "event_datetime").groupBy("fold", "part").count().collect()
    assert {(r[0], r[1]): r[2] for r in got if r[0] in (1, 4)} == {(1, "train"): 4, (1, "val"): 4, (1, "test"): 4, (4, "train"): 16, (4, "val"): 4, (4, "test"): 4}


@pytest.mark.parametrize("how", ["inverse_artist_freq", "sqrt_price", "log_price", "inverse_price_quartile", "low_count_upweight"])
def test_weights_sum_to_the_rows(spark, how):
    out = splits.weights(rows(spark, 50), how).agg(F.sum("weight"), F.max("weight") / F.min("weight")).collect()[0]
    assert out[0] == pytest.approx(50)
    assert how != "inverse_price_quartile" or out[1] <= 4.0001


@pytest.mark.parametrize("name", ["log", "sqrt", "boxcox", "none"])
def test_targets_invert(spark, name):
    df = rows(spark, 40)
    t = splits.target(name)
    t.fit(df)
    got = df.select(F.abs(t.back(t.forward(F.col("listing_price"))) - F.col("listing_price")).alias("d")).agg(F.max("d")).collect()[0][0]
    assert got < 1e-6
    with pytest.raises(ValueError, match="no target"):
        splits.target("cube")
