"""Smoothing, fallbacks and leakage properties of the extractors."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import features
from corvane.operators.features import ColdStart, EventPricing, FeaturePipeline, ListingStructural, Performer, WithinEvent
from corvane.operators.splits import RelativeTarget

SCHEMA = "listing_id string, event_id string, listing_price double, section string, row string, artist_or_team string, city string, venue_name string, event_datetime timestamp_ntz, timestamp timestamp_ntz, seat_from string, seat_to string, days_to_event int, event_type string"


def frame(spark, rows):
    out = []
    for i, (event, price, more) in enumerate(rows):
        m = {"section": "Floor A", "row": "A", "artist": "x", "city": "Paris", "venue": "v", "hours": i} | more
        out.append((str(i), event, price, m["section"], m["row"], m["artist"], m["city"], m["venue"], datetime(2025, 5, 3), datetime(2025, 1, 1) + timedelta(hours=m["hours"]), None, None, 5, "concert"))
    return spark.createDataFrame(out, SCHEMA)


def values(df, name):
    return [r[name] for r in df.orderBy(F.col("listing_id").cast("int")).collect()]


def test_smoothed_median_and_fallback(spark):
    train = frame(spark, [("a", 100.0, {}), ("a", 200.0, {}), ("b", 400.0, {"artist": "y"})])
    made = EventPricing().fit(train)
    probe = frame(spark, [("a", 999.0, {}), ("new", 999.0, {}), ("new", 999.0, {"artist": "z"})])
    got = values(made.transform(probe), "event_median_price")
    assert got == pytest.approx([(2 * 150 + 20 * 200) / 22, (2 * 150 + 20 * 200) / 22, 200.0])


def test_own_price_is_taken_out_by_cents(spark):
    train = frame(spark, [("a", 100.0, {}), ("a", 200.0, {}), ("a", 300.0, {}), ("b", 50.0, {})])
    made = EventPricing().fit(train)
    mean = 650 / 4
    got = values(made.transform(train), "event_median_price")
    assert got[0] == pytest.approx((2 * 250 + 20 * mean) / 22) and got[3] == pytest.approx(mean)
    near = values(made.transform(frame(spark, [("a", 100.01, {})])), "event_median_price")
    assert near[0] == pytest.approx((3 * 200 + 20 * 150) / 23)  # a cent beside it is no training row
    flagged = EventPricing(loo="flag").fit(train)
    assert values(flagged.transform(frame(spark, [("a", 100.0, {})])), "event_median_price")[0] == pytest.approx((3 * 200 + 20 * 150) / 23)


def test_cold_start_takes_the_whole_event_out(spark):
    train = frame(spark, [("a", 100.0, {}), ("a", 100.0, {}), ("b", 300.0, {})])
    made = ColdStart().fit(train)
    g = (2 * math.log1p(100) + math.log1p(300)) / 3
    got = values(made.transform(train), "coldstart_arq_logmean")
    assert got[0] == pytest.approx((math.log1p(300) + 75 * g) / 76) and got[2] == pytest.approx((2 * math.log1p(100) + 75 * g) / 77)
    unseen = values(made.transform(frame(spark, [("q", 1.0, {"artist": "nobody", "venue": "w", "section": "zz"})])), "coldstart_arq_logmean")
    assert unseen == pytest.approx([g])


def test_within_event_prefix_and_ties(spark):
    train = frame(spark, [("a", float(10 * (i + 1)), {"hours": h}) for i, h in enumerate([0, 1, 1, 2, 3, 4, 5])])
    made = WithinEvent().fit(train)
    out = made.transform(train, True)
    assert values(out, "we_pos_in_sequence") == [0, 1, 1, 3, 4, 5, 6]
    assert values(out, "we_rolling5_dev")[5] == pytest.approx(math.log(60 / 30))
    later = made.transform(frame(spark, [("a", 35.0, {"hours": 1}), ("zz", 1.0, {})]), False)
    assert values(later, "we_pos_in_sequence") == [3, 0] and values(later, "we_history_support") == [7, 0]
    assert values(later, "we_zone_price_at_t")[0] == pytest.approx(math.log(35 / 20))


def test_structural_loo_only_on_training_rows(spark):
    train = frame(spark, [("a", 100.0, {}), ("a", 200.0, {})])
    made = ListingStructural().fit(train)
    assert values(made.transform(train, True), "event_section_row_median_price") == pytest.approx([(200 + 8 * 150) / 9, (100 + 8 * 150) / 9])
    assert values(made.transform(train, False), "event_section_row_median_price") == pytest.approx([150, 150])


def test_relative_target_of_a_single_row_is_global(spark):
    train = frame(spark, [("a", 100.0, {}), ("b", 300.0, {}), ("b", 500.0, {})])
    t = RelativeTarget().fit(train)
    base = {r.listing_id: r.target_base for r in t.base(train, True).collect()}
    assert base["0"] == pytest.approx(t.g) and base["1"] == pytest.approx((math.log1p(500) + 20 * t.g) / 21)


def test_performer_names_fold(spark):
    train = frame(spark, [("a", 100.0, {"artist": " Foo "}), ("b", 300.0, {"artist": "foo"})])
    made = Performer().fit(train)
    known = values(made.transform(frame(spark, [("c", 1.0, {"artist": "FOO"}), ("c", 1.0, {"artist": "bar"})])), "is_known_artist")
    assert known == [1, 0]


def test_pipeline_names_and_nulls(spark):
    train = frame(spark, [(None if i % 7 == 0 else f"e{i % 3}", None if i % 5 == 0 else 50.0 + i, {"section": None if i % 4 == 0 else "Balcony 2", "row": None, "artist": None if i % 6 == 0 else "x"}) for i in range(30)])
    made = FeaturePipeline(("snapshot",)).fit(train)
    out = made.transform(train, True)
    assert len(made.names) == 97 and out.count() == 30
    matrix = made.matrix(train)
    assert len(set(matrix.columns)) == 98 and {"days_to_event", "quantity", "is_single_ticket"} <= set(matrix.columns)
    row = out.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in made.names if n not in ("artist_zone_median_price",)]).collect()[0]
    assert not {k: v for k, v in row.asDict().items() if v}


def test_no_python_in_feature_plans(spark):
    train = frame(spark, [("a", 100.0, {}), ("b", 200.0, {})])
    for make in (features.EventPricing, features.ColdStart, features.WithinEvent, features.Regional):
        plan = make().fit(train).transform(train)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
