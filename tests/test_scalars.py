"""Scalar rules by hand-computed values."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import scalars as S


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (S.zone, {"Main Floor": "floor_vip", "Club Level": "floor_vip", "110": "upper_tier", "Section 1001": "lower_tier", "Capitol": "floor_vip", "Section 50": "floor_vip", "Section 777": "balcony", "Section 250": "upper_tier", "": "upper_tier", None: "upper_tier", "Gallery": "balcony"}),
        (S.section_level, {"Floor 3": 0.0, "Section 150": 0.2, "212": 0.5, "Upper 350": 0.7, "499": 0.85, "512": 1.0, "Section 12": 0.5, "Orchestra": 0.2, "Loge 4": 0.5, "Balcony": 0.85, "Garden": 0.0}),
        (S.row_quality, {None: 0.5, "GA": 0.5, "A": 0.02, "z": 0.52, "AA": 0.02, "AB": 0.04, "ZZ": 1.0, "10": 0.2, "99": 1.0, "?": 0.5}),
        (S.row_number, {None: 10, "": 10, "GA": 0, "B2": 2, "C": 3, "AB": 2, "?": 10}),
        (S.row_bucket, {None: "unknown", "-": "unknown", "GA": "ga", "A": "front", "K": "mid", "Z": "back", "10": "mid"}),
        (S.seat_number, {None: -1, "*": -1, "12": 12, "+7": 7, "-3": -1, "9001": 999, "x": -1}),
        (S.city_name, {"Las Vegas, NV": "las vegas", " Paris ": "paris", "Foo, XX": "foo, xx"}),
        (S.region_key, {"Tokyo": "JP:tokyo", "Austin, TX": "US:austin"}),
        (S.count_of, {"1.5M subscribers": 1_500_000, "1,234,567 views": 1_234_567, "12k": 12_000, "none": 0, None: 0}),
        (S.word_count, {"": 0, "  a  b ": 2, "a\tb c": 3}),
    ],
)
def test_rules(spark, rule, cases):
    assert column(spark, list(cases), rule) == pytest.approx(list(cases.values())) if isinstance(next(iter(cases.values())), float) else column(spark, list(cases), rule) == list(cases.values())


def test_zone_prices(spark):
    (got,) = spark.range(1).select(S.zone_prices(F.lit(50.0), F.lit(250.0)).alias("x")).collect()
    assert {r.zone: r.price for r in got.x} == {"floor_vip": 250.0, "lower_tier": 190.0, "upper_tier": 140.0, "balcony": 100.0}
    (swapped,) = spark.range(1).select(S.zone_prices(F.lit(100.0), F.lit(0.0)).alias("x")).collect()
    assert {r.price for r in swapped.x} == {100.0}


def test_cents_round_half_even(spark):
    assert column(spark, [0.125, 0.135, 10.0], S.cents, "double") == [12, 14, 1000]


def test_urgency_and_capacity(spark):
    assert column(spark, [0, 5, 14, 30, 60, 61], S.urgency, "int") == [5, 4, 3, 2, 1, 0]
    assert column(spark, [None, 10, 5000, 39_999, 40_000], S.capacity_bucket, "int") == [2, 0, 1, 2, 3]
