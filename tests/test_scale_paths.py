"""Ways that only large tables take give what the plain ways give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import cleaning, splits
from corvane.operators.stats import exact_percentiles


@pytest.mark.parametrize("values", [[1.0], [3.0, 3.0, 3.0, 3.0], [5.5, 1.25, 9.0, 2.0], None])
def test_exact_percentiles_by_ranges(spark, values):
    pick = random.Random(3)
    values = values or [round(pick.choice([pick.random() * 1000, 7.0, pick.expovariate(0.01)]), 2) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.02, 0.25, 0.5, 0.95, 1.0]
    assert exact_percentiles(df, "x", probs, parts=16, small=0) == df.agg(F.percentile("x", probs)).collect()[0][0]
    assert exact_percentiles(df.limit(0), "x", [0.5]) == [None]


def test_ranks_in_ranges_of_a_skewed_column(spark):
    pick = random.Random(1)
    rows = [(i, pick.choice("ab") if i % 10 else None, pick.choice([0.0, 0.0, 1.0, 10.0**pick.randrange(9), None])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    key = lambda r: (r[2] is not None, r[2] or 0.0, r[0])
    got = {r.id: r._rank for r in splits.ranked(df, ["x", "id"], parts=8).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=key))}
    inside = {r.id: r.k for r in splits.ranked(df, ["x", "id"], "k", 8, ["g"]).collect()}
    for g in ("a", "b", None):
        assert [inside[r[0]] for r in sorted((r for r in rows if r[1] == g), key=key)] == list(range(1, 1 + sum(r[1] == g for r in rows)))


def test_duplicates_without_a_key_column(spark):
    t0 = datetime(2025, 1, 1)
    rows = [("E", "A", "1", None, None, t0 + timedelta(hours=h)) for h in (0, 0, 3, 7, 8)] + [("E", None, "1", None, None, t0)] * 2
    df = spark.createDataFrame(rows, "event_id string, section string, row string, seat_from string, seat_to string, timestamp timestamp_ntz")
    got = cleaning.flag_duplicates(df)
    assert got.columns == [*df.columns, "is_duplicate"] and got.count() == 7
    by = {}
    for r in got.collect():
        by.setdefault((r.section, r.timestamp.hour), []).append(r.is_duplicate)
    assert {k: sorted(v) for k, v in by.items()} == {("A", 0): [False, True], ("A", 3): [True], ("A", 7): [False], ("A", 8): [True], (None, 0): [False, False]}


def test_relative_target_goes_there_and_back(spark):
    rows = [(f"l{i}", f"E{i % 5}" if i % 7 else None, 20.0 + i * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "listing_id string, event_id string, listing_price double")
    y = splits.target("relative").fit(df)
    back = y.prepare(df, True).select("listing_price", y.back(y.forward(F.col("listing_price"))).alias("p")).collect()
    assert len(back) == 60 and all(r.p == pytest.approx(r.listing_price) for r in back)


def test_large_dimensions_are_not_broadcast(spark, tmp_path):
    from corvane.plans.canonical import unbroadcast_if_large

    spark.range(50_000).selectExpr("id AS k", "repeat(sha2(string(id), 256), 4) AS long_text").write.parquet(str(tmp_path / "dimension"))
    dimension = spark.read.parquet(str(tmp_path / "dimension"))
    plan = lambda side: spark.range(10).withColumnRenamed("id", "k").join(side.select("k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(unbroadcast_if_large(dimension))
    large = spark.range(10**6).withColumnRenamed("id", "k").join(unbroadcast_if_large(dimension, 1000), "k").select("k")
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString() and large.count() == 50_000


def test_models_join_their_rows_once(spark):
    from corvane.queries import _model_rows

    rows, names = _model_rows(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "model-rows" in rows.inputFiles()[0] and set(names) < set(rows.columns)
    assert rows.count() > 0 and rows.where("label is null").count() == 0


def test_pipeline_finds_duplicates_once(spark):
    """What reads the pipeline's result doesn't fold the keys again."""
    rows = spark.createDataFrame([(f"l{i}", f"e{i % 3}", "A", "1", None, "2", f"2025-01-01 {i:02d}:00:00", 10.0 + i) for i in range(24)], "listing_id string, event_id string, section string, row string, seat_from string, seat_to string, timestamp string, listing_price double")
    rows = rows.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "event_datetime": F.expr("timestamp_ntz'2025-02-01 00:00:00'"), "artist_or_team": F.lit("a"), "venue_name": F.lit("v"), "city": F.lit("Paris"), "venue_capacity": F.lit(100), "face_value": F.lit(5.0)})
    out = cleaning.listing_pipeline(rows.select("event_id").where("event_id <> 'e1'")).process(rows)
    assert not [i for i in out.issues if "CRITICAL" in i]
    assert "collect_list" not in out.data._jdf.queryExecution().optimizedPlan().toString()
    got = {r.listing_id: (r.is_duplicate, r.has_event) for r in out.data.collect()}
    want = {r.listing_id: r.is_duplicate for r in cleaning.flag_duplicates(rows).collect()}
    assert got == {k: (v, int(k[1:]) % 3 != 1) for k, v in want.items()} and set(want.values()) == {True, False}
