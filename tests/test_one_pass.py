"""Extractors in one pass over rows dealt by event give what fit and transform give, without shuffling the rows for each look-up."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane import queries as catalogue
from corvane.operators import features
from corvane.operators.stats import price_stats, price_stats_by_ranges
from corvane.plans.canonical import listings, listings_by_event

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "listing_id int, event_id string, listing_price double, section string, seat_zone string, artist_or_team string, city string, venue_name string, event_datetime timestamp_ntz, train boolean"


def odd_rows(spark):
    pick = random.Random(5)
    row = lambda i: (
        i, pick.choice(["a", "a", "b", "c", "d", "", None, f"e{i}"]), pick.choice([None, 0.0, 10.0, 10.004, 25.5, round(pick.random() * 90, 2)]), pick.choice(["Floor A", "Section 12", "Section 300", "Balcony", "", None]),
        pick.choice(["", "unknown", "lower", None]), pick.choice(["x", "y", "z", None, f"n{i}"]), pick.choice(["Paris", "New York, NY", "", None]), pick.choice(["v", "w", None]), pick.choice([None, datetime(2025, 1, 1) + timedelta(days=pick.randrange(300))]), pick.choice([True, True, False, None]),
    )
    return spark.createDataFrame([row(i) for i in range(400)], SCHEMA)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def same_values(made, df, train):
    got = {r.listing_id: r for r in made().fit_transform(df, train).collect()}
    want = made().fit(df.where(train)).transform(df).collect()
    assert len(got) == len(want) == df.count()
    for r in want:
        for name in made().names:
            assert got[r.listing_id][name] == (None if r[name] is None else pytest.approx(r[name], abs=1e-9)), (name, r)


@pytest.fixture
def no_broadcast(spark):
    """No table is small enough for the session's own limit, as in large runs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_by_event_are_the_listings(spark, no_broadcast):
    assert listings_by_event(spark, SF_DIR).exceptAll(listings(spark, SF_DIR)).isEmpty() and listings(spark, SF_DIR).exceptAll(listings_by_event(spark, SF_DIR)).isEmpty()


def test_cold_start_in_one_pass(spark):
    same_values(features.ColdStart, odd_rows(spark), F.col("train"))
    same_values(features.ColdStart, odd_rows(spark).drop("seat_zone"), F.col("train"))
    same_values(features.ColdStart, odd_rows(spark), F.lit(False))


def test_cold_start_deals_rows_once(spark, no_broadcast):
    df = catalogue.x07_cold_start(spark, SF_DIR)
    assert shuffles(df) == 2  # the rows, and the parts that are merged into them
    assert df.count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()


@pytest.mark.parametrize("made", [features.EventPricing, features.RelativePricing, lambda: features.EventPricing(loo="flag")])
def test_pricing_in_one_pass(spark, made):
    same_values(made, odd_rows(spark), F.col("train"))
    same_values(made, odd_rows(spark), F.lit(False))


@pytest.mark.parametrize("name", ["x05_event_pricing", "x06_relative_pricing"])
def test_pricing_deals_rows_once(spark, no_broadcast, name):
    assert shuffles(catalogue.queries()[name](spark, SF_DIR)) == 2


def test_price_stats_by_ranges(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["a", "b", None, f"k{i % 40}"]), pick.choice([None, 7.0, 9.5, round(pick.expovariate(0.01), 2)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, listing_price double")
    want = {r.k: r for r in price_stats(df, ["k"]).collect()}
    got = {r.k: r for r in price_stats_by_ranges(df, ["k"]).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k].n, got[k].median) == (r.n, r.median)
        assert (got[k].total, got[k].mean, got[k].std) == pytest.approx((r.total, r.mean, r.std))


def structural_rows(spark):
    pick = random.Random(8)
    odd = odd_rows(spark).collect()
    seat = lambda: pick.choice([None, "*", "4", "30"])
    return spark.createDataFrame([(*r, pick.choice(["1", "9", "30", "GA", None, "C"]), seat(), seat()) for r in odd], SCHEMA + ", row string, seat_from string, seat_to string")


def test_structure_in_one_pass(spark):
    same_values(features.ListingStructural, structural_rows(spark), F.col("train"))
    same_values(features.ListingStructural, structural_rows(spark), F.lit(False))


def test_structure_of_training_rows_in_one_pass(spark):
    df, made = structural_rows(spark), features.ListingStructural()
    train = df.where("train")
    want = {r.listing_id: r for r in made.fit(train).transform(train, True).collect()}
    got = {r.listing_id: r for r in features.ListingStructural().fit_transform(df, F.col("train"), is_train=True).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for name in made.names:
            assert got[k][name] == pytest.approx(r[name], abs=1e-9), (name, r)


@pytest.mark.parametrize("name", ["x10_listing_structural", "x10_listing_structural_train"])
def test_structure_deals_rows_once(spark, no_broadcast, name):
    assert shuffles(catalogue.queries()[name](spark, SF_DIR)) == 2
