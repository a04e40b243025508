"""Storage, payloads, cleaning, evaluation and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import cleaning, evaluate, popularity, serve
from corvane.sources import payloads, store, synthetic
from corvane.streaming import jobs

SCHEMA = "listing_id string, event_id string, section string, row string, seat_from string, seat_to string, source string, listing_price double, timestamp timestamp_ntz, event_datetime timestamp_ntz, artist_or_team string, venue_name string, city string, face_value double, venue_capacity int, quantity int, days_to_event int"


def listing(i, price=100.0, section="A", event="e", hours=0, **more):
    m = {"row": "1", "artist": "X", "city": "NYC", "face": None, "capacity": None} | more
    return (str(i), event, section, m["row"], None, None, "s", price, datetime(2025, 3, 1) + timedelta(hours=hours), datetime(2025, 4, 1), m["artist"], "V", m["city"], m["face"], m["capacity"], 1, 31)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_append_is_idempotent_and_prices_make_new_rows(spark, tmp_path):
    path = str(tmp_path / "listings")
    batch = frame(spark, [listing(1), listing(2), listing(3, 101.0)])
    assert sorted(r.listing_id for r in store.append_new(spark, batch, path).collect()) == ["1", "3"]
    store.append_new(spark, frame(spark, [listing(9), listing(10, 102.0)]), path)
    stored = store.read(spark, path, frame(spark, []).schema)
    assert sorted(r.listing_id for r in stored.collect()) == ["1", "10", "3"]
    assert (tmp_path / "listings/year=2025/month=03/day=01").exists()
    assert store.read(spark, str(tmp_path / "none"), stored.schema).count() == 0


def test_hash_parts(spark):
    df = frame(spark, [listing(1, section=" Floor "), listing(2, section="floor"), listing(3, 100.004), listing(4, 100.006)])
    h = {r.listing_id: r.h for r in df.select("listing_id", store.listing_hash().alias("h")).collect()}
    assert h["1"] == h["2"] and h["3"] != h["4"]


def test_latest_and_summary(spark):
    df = spark.createDataFrame([("e", "z", 1, 5), ("e", "z", 2, 6), ("e", "z", 2, 7)], "event_id string, seat_zone string, timestamp int, seq int")
    assert store.latest(df, ["event_id", "seat_zone"], "timestamp", "seq").collect()[0].seq == 6


def test_discovery_defaults(spark):
    raw = [{"id": "1", "name": "N", "dates": {"start": {"localDate": "2025-05-01"}}, "classifications": [{"segment": {"name": "Arts & Theatre"}}]}, {"id": "2", "name": "M", "dates": {"start": {"dateTime": "2025-05-01T20:00:00Z"}}, "_embedded": {"venues": [{"id": "v", "city": {"name": "C"}}], "attractions": [{"name": "A"}]}}, {"name": "no id"}]
    got = {r.event_id: r for r in payloads.discovery_events(spark.createDataFrame([(json.dumps(x),) for x in raw] + [("not json",)], "payload string")).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].event_type, got["1"].artist_or_team, got["1"].venue_name, got["1"].event_datetime) == ("theater", "N", "Unknown Venue", datetime(2025, 5, 1))
    assert (got["2"].event_type, got["2"].artist_or_team, got["2"].city, got["2"].country, got["2"].event_datetime) == ("concert", "A", "C", "US", datetime(2025, 5, 1, 20))


def test_marketplace_events(spark):
    page = lambda **k: json.dumps({"id": "1", "name": "n", "localDate": "2025-05-01T20:00:00[America/New_York]", "subCategoryId": 1, "performers": [{"name": "a", "master": False}, {"name": "b", "master": True}]} | k)
    rows = [("concerts", page()), ("sports", page()), ("concerts", page(id="2", subCategoryId=75)), ("concerts", page(id="3", performers=[{"name": "a", "master": False}]))]
    got = payloads.marketplace_events(spark.createDataFrame(rows, "category string, payload string")).collect()
    assert [(r.event_id, r.artist_or_team, r.category, r.event_datetime.hour) for r in got] == [("1", "b", "concerts", 20)]


def test_experiments_skip_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"version": "v1", "primary_mae": 3.0, "timestamp": "2025"}\nbroken\n{"version": "v1", "overall_mae": 5.0, "timestamp": "2026", "commit": "c"}\n')
    out = evaluate.leaderboard(payloads.experiments(spark, str(tmp_path / "log.jsonl"))).collect()
    assert [(r.version, r.folds, r.mae, r.last_commit) for r in out] == [("v1", 2, 4.0, "c")]


def test_trajectories(spark):
    c = spark.createDataFrame([("1", 100.0, 300.0, 2.0, 0.0, datetime(2025, 5, 1))], "event_id string, low double, high double, demand double, popularity double, event_date timestamp_ntz")
    got = {(r.seat_zone, r.days_to_event): r.price_avg for r in synthetic.trajectories(c, 0.0).collect()}
    assert len(got) == 32 and got["floor_vip", 90] == pytest.approx(300) and got["balcony", 0] == pytest.approx(150 * 2.0) and got["upper_tier", 30] == pytest.approx(180 * 1.2)


@pytest.mark.parametrize("rows", [[], [listing(1, None, None, row=None)] * 3, [listing(i, p) for i, p in enumerate([0.5, 1_000_000.0, 150.0, -5.0])]])
def test_pipeline_survives_edges(spark, rows):
    out = cleaning.listing_pipeline().process(frame(spark, rows))
    assert out.data.count() == len(rows) and out.metrics["input_rows"] == len(rows) and not [x for x in out.issues if x.startswith("[CRITICAL]")]


def test_pipeline_skips_failed_stages_and_reports(spark):
    broken = cleaning.Pipeline([("bad", lambda d: d.select("nothing"), {}), ("text", cleaning.normalised_text, {})], "listings")
    out = broken.process(frame(spark, [listing(1)]))
    assert out.issues[0].startswith("[CRITICAL] bad") and out.data.collect()[0].city_normalized == "new york"


def test_outliers_and_imputation(spark):
    df = frame(spark, [listing(i, p) for i, p in enumerate([0.5, 60_000.0, 100.0, 110.0, 105.0, 95.0, 500.0])])
    got = [r.outlier_reason for r in cleaning.flag_outliers(df).orderBy("listing_id").collect()]
    assert got[0] == "below_min" and got[1] == "above_max" and got[2] is None
    df = frame(spark, [listing(1, capacity=100, city="P"), listing(2, capacity=300, city="P"), listing(3, city="P"), listing(4, city="Q", face=7.0)])
    got = {r.listing_id: r for r in cleaning.impute(df).collect()}
    assert got["3"].venue_capacity == 200 and got["4"].venue_capacity == 15_000 and got["1"].face_value == 50.0 and not got["4"].face_value_imputed


def test_alerts():
    assert cleaning.alerts({"drop_rate": 0.06, "null_rate": 0.6}) == {"drop_rate": "warning", "null_rate": "critical", "outlier_rate": "ok", "duplicate_rate": "ok"}


def test_metrics(spark):
    df = spark.createDataFrame([("a", 100.0, 90.0), ("a", 200.0, 220.0), ("b", 0.0, 5.0)], "event_id string, actual double, predicted double")
    row = evaluate.regression(df).collect()[0]
    assert row.mae == pytest.approx(35 / 3) and row.mape == pytest.approx(10.0)
    seen = evaluate.seen_breakdown(df, df.where("event_id = 'a'")).collect()[0]
    assert seen.seen_mae == 15 and seen.unseen_mae == 5 and seen.unseen_event_pct == 50
    scores = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, score double")
    assert evaluate.classification(scores).collect()[0].auc == pytest.approx(0.875)
    assert evaluate.calibration(scores).orderBy("bin").collect()[0].bin == 1


def test_ranking_and_cold_start(spark):
    df = spark.createDataFrame([("1", "e", 100.0, 150.0), ("2", "e", 50.0, 100.0), ("3", "e", 0.0, 10.0), ("4", "x", 1.0, 10.0)], "listing_id string, event_id string, listing_price double, predicted double")
    out = serve.rank_by_value(df, df.where("event_id = 'e'")).orderBy("rank").collect()
    assert [(r.listing_id, r["rank"]) for r in out] == [("2", 1), ("1", 2)]
    e = spark.createDataFrame([("BTS", 1, "CONCERT"), ("Known", 2, "SPORTS")], "artist_or_team string, city_tier int, event_type string")
    past = spark.createDataFrame([("known", "balcony", 12.0)], "artist string, zone string, price double")
    got = {(r.artist_or_team, r.zone): r for r in serve.cold_start(e, past).collect()}
    assert got["BTS", "floor_vip"].estimate == pytest.approx(450 * 2.5 * 1.2) and got["Known", "balcony"].estimate == 12.0 and got["Known", "balcony"].confidence == 0.7
    assert got["Known", "floor_vip"].estimate is None


def test_coverage_and_popularity(spark):
    df = spark.createDataFrame([(x, s) for x, s in zip("abcde", [50.0, 30.0, 10.0, 5.0, 5.0])], "k string, score double")
    assert [r.k for r in popularity.covering(df, "k").orderBy("rank").collect()] == ["a", "b", "c"]
    counts = spark.createDataFrame([("a", None, None, None, None), ("b", 10**8, None, None, None)], "artist string, youtube_subscribers long, youtube_views long, lastfm_listeners long, lastfm_play_count long")
    assert {r.artist: (r.score, r.tier) for r in popularity.scored(counts).collect()} == {"a": (0.0, "low"), "b": (100.0, "high")}


def test_streams_equal_batch(spark, tmp_path):
    rows = frame(spark, [listing(i, 100.0 + i % 3, section="Floor", hours=i) for i in range(30)])
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.source(spark, str(tmp_path / "in"), rows.schema)
    jobs.append_exactly(stream, str(tmp_path / "store"), str(tmp_path / "c1"))
    jobs.append_exactly(stream, str(tmp_path / "store"), str(tmp_path / "c2"))  # again from the start: nothing new
    assert store.read(spark, str(tmp_path / "store"), rows.schema).count() == 3
    timed = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    kept = jobs.drained(jobs.anchored_dedup(timed, ["event_id"]), str(tmp_path / "o2"), str(tmp_path / "c3"))
    assert sorted(int(r.listing_id) for r in kept.collect()) == [0, 6, 12, 18, 24]
    zones = jobs.drained(jobs.zone_snapshots(timed), str(tmp_path / "o3"), str(tmp_path / "c4"))
    assert zones.count() < 30 and {r.n for r in zones.collect()} == {1}
    quotes = rows.select("event_id", "timestamp", F.col("listing_price").alias("q"))
    jobs.enriched(stream, quotes, ["event_id"], ["q"], str(tmp_path / "o4"), str(tmp_path / "c5"))
    assert spark.read.parquet(str(tmp_path / "o4")).where("quote_q = listing_price").count() == 30


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
    assert len(e.entry(spark).take(1)) == 1


def test_command_line(spark, tmp_path, capsys):
    from corvane import cli

    rows = [listing(i, 50.0 + i % 40 * 5, section=f"Section {100 + i % 3 * 100}", event=f"e{i % 12}", hours=i, artist=f"a{i % 4}", capacity=9000) for i in range(240)]
    path = str(tmp_path / "in")
    frame(spark, rows).withColumn("event_type", F.lit("concert")).withColumn("event_datetime", F.expr("event_datetime + make_dt_interval(cast(substr(event_id, 2) as int))")).write.parquet(path)
    assert cli.run(["preprocess", "--data", path, "--output", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 240
    assert cli.run(["train", "--data", path, "--model", "ridge"], spark) == 0
    metrics = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert metrics["n"] == 36 and metrics["features"] > 20
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"version": f"v{i}", "primary_mae": 30 - i / 10, "timestamp": f"2025-0{i}"}) for i in range(1, 6)))
    assert cli.run(["stalled", "--data", str(tmp_path / "log.jsonl")], spark) == 1
