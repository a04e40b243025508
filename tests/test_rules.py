"""Lookups, configuration lists, validators of events and snapshots, schema rules and the area under a 0/1 feature."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import cleaning, evaluate
from corvane.sources import store

def now():
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'")


def test_event_lookup_and_ids(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 2)), ("a", datetime(2024, 1, 1)), ("b", None)], "event_id string, event_datetime timestamp_ntz")
    assert [r.event_datetime.day for r in store.event(rows, "a").collect()] == [1]
    assert store.event(rows, "c").count() == 0
    assert (store.event_ids(rows).count(), store.event_ids(rows, distinct=True).count()) == (3, 2)
    assert dict(store.as_rows(rows).dtypes)["event_datetime"] == "timestamp"


def test_snapshots_without_a_column(spark):
    rows = spark.createDataFrame([("a", 1.0, "x")], "event_id string, price_min double, extra string")
    out = store.load_snapshots(rows)
    assert out.columns == list(store.SNAPSHOT_COLUMNS) and out.first().price_avg is None


def test_configuration_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_about": "text", "big": ["One", "Two"], "small": ["THREE"]}))
    (tmp_path / "b.json").write_text(json.dumps(["Fest", "Parking"]))
    assert store.config_lists(spark, f"{tmp_path}/a.json") == {"big": ["One", "Two"], "small": ["THREE"]}
    assert store.config_words(spark, f"{tmp_path}/b.json") == ["fest", "parking"]
    assert store.config_words(spark, f"{tmp_path}/none.json", ["Pass"]) == ["pass"] and store.config_lists(spark, f"{tmp_path}/none.json") == {}


def test_event_rules(spark):
    rows = spark.createDataFrame([("a", "v", "x", "c", datetime(2025, 1, 1), 5), ("", None, "", None, datetime(2023, 1, 1), -1), ("b", "v", "x", "c", None, None)], "event_id string, venue_id string, artist_or_team string, city string, event_datetime timestamp_ntz, venue_capacity int")
    out = {r.event_id: r for r in cleaning.validated_events(rows, now()).collect()}
    assert out["a"].is_valid and not out["a"].warnings and out["b"].is_valid
    assert len(out[""].errors) == 3 and len(out[""].warnings) == 3
    assert len(cleaning.validated_events(rows, now(), allow_past=True).where("event_id = ''").first().warnings) == 2


def test_snapshot_rules(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 1), ("b", 2.0, 1.0, 0.5, -1), ("c", 2.0, None, None, None)], "event_id string, price_min double, price_avg double, price_max double, days_to_event int").withColumn("timestamp", now())
    out = {r.event_id: r.errors for r in cleaning.validated_snapshots(rows, now()).collect()}
    assert out["a"] == out["c"] == [] and len(out["b"]) == 4


def test_schema_rules(spark):
    rows = spark.createDataFrame([("a", "1", 2, None), ("b", "2", 3, None), (None, "3", 4, "x")], "event_id string, listing_price string, face_value int, section string")
    assert cleaning.type_issues(rows) == ["column listing_price has type string, not float"]
    assert [r.column_name for r in cleaning.mostly_null(rows, ["event_id", "section"]).collect()] == ["section"]
    assert [r.event_id for r in cleaning.offending(rows, F.col("face_value") > 1, "event_id", 2).collect()] == [None, "a"]
    assert cleaning.mostly_null(rows.limit(0), ["section"]).count() == 0


def test_area_under_a_flag(spark):
    pairs = [(1, 1), (1, 1), (0, 1), (1, 0), (0, 0), (0, 0)]
    ones, zeros = [f for f, y in pairs if y], [f for f, y in pairs if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    df = spark.createDataFrame(pairs, "f int, y int")
    assert abs(evaluate.flag_auc(df, "f", "y").first().auc - want) < 1e-12
    assert evaluate.flag_auc(df.where("y = 1"), "f", "y").first().auc is None


def test_artist_of_a_title(spark):
    got = spark.createDataFrame([("A at B at C",), ("A",), (None,)], "t string").select(S.title_artist(F.col("t"))).collect()
    assert [r[0] for r in got] == ["A", "A", None]
