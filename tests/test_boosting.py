"""Trees by histograms are those of Spark ML, and the statistics of stored rows those of any rows."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import features
from corvane.operators.boosting import Binned
from corvane.operators.models import vectors
from corvane.operators.stats import global_stats, medians_by_parts, price_cuts
from corvane.plans.shared import stored
from tests.test_one_pass import odd_rows


@pytest.fixture(scope="module")
def rows(spark):
    """Features of few values, so that the bins are those of Spark ML."""
    pick = random.Random(9)
    made = [(float(pick.randrange(12)), float(pick.randrange(30)) if pick.random() < 0.9 else None, float(pick.randrange(2)), 1.0, 1 + pick.randrange(3)) for _ in range(2000)]
    made = [(*r, (r[0] - 4) ** 2 / 9 + (r[1] or 3.0) * r[2] / 7 + pick.gauss(0, 0.3)) for r in made]
    return spark.createDataFrame(made, "a double, b double, c double, d double, w int, label double").withColumn("id", F.monotonically_increasing_id()).localCheckpoint()


def test_regression_is_that_of_spark_ml(rows):
    names = ["a", "b", "c", "d"]
    want = Pipeline(stages=[*vectors(names), GBTRegressor(featuresCol="x", labelCol="label", maxIter=5, maxDepth=4, seed=42)]).fit(rows).transform(rows)
    want = {r.id: r.prediction for r in want.select("id", "prediction").collect()}
    got = {r.id: r.prediction for r in Binned(names, rounds=5, depth=4).fit(rows).predict(rows).select("id", "prediction").collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_classification_is_that_of_spark_ml(rows):
    names, rows = ["a", "b", "c"], rows.withColumn("label", (F.col("label") > 2).cast("int"))
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=6, maxDepth=3, seed=42)
    want = Pipeline(stages=[*vectors(names), model]).fit(rows).transform(rows).select("id", vector_to_array("probability")[1].alias("p"))
    want = {r.id: r.p for r in want.collect()}
    got = {r.id: r.p for r in Binned(names, weight=F.col("w"), rounds=6, depth=3, loss="log").fit(rows).predict(rows, "p").select("id", "p").collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_no_rows_and_one_value(spark, rows):
    assert Binned(["a"], rounds=2, depth=2).fit(rows.where("false")).predict(rows.limit(1)).collect()[0].prediction == 0.0
    one = spark.createDataFrame([(None, 2.0), (float("nan"), 4.0)], "a double, label double")
    assert [r.prediction for r in Binned(["a"], rounds=1, depth=2).fit(one).predict(one).collect()] == [3.0, 3.0]


def test_statistics_of_stored_rows(spark):
    df = odd_rows(spark).where("artist_or_team is not null").withColumns({"_artist": S.folded(F.col("artist_or_team")), "_zone": S.zone(F.col("section")), "_venue": S.folded(F.col("venue_name"))})
    df = stored(df, "odd")
    g, cuts = global_stats(df, kept=True), price_cuts(df)
    for made, names in ((features.Performer, ("artists", "zones")), (features.Venue, ("venues",))):
        want, got = made().fit(df), made().fit_stored(df, g, cuts)
        for n in names:
            keys = [c for c in getattr(want, n).columns if c.startswith("_")]
            by = lambda t: {tuple(r[k] for k in keys): r.asDict() for r in t.collect()}  # noqa: B023, E731
            a, b = by(getattr(want, n)), by(getattr(got, n))
            assert a.keys() == b.keys()
            for k, r in a.items():
                assert b[k] == {c: x if x is None or isinstance(x, str) else pytest.approx(x) for c, x in r.items()}


def test_medians_by_parts(spark):
    pick = random.Random(3)
    df = stored(spark.createDataFrame([(f"k{pick.randrange(9) ** 2}", pick.choice([5.0, 7.5, round(pick.expovariate(0.01), 2)])) for _ in range(3000)], "k string, listing_price double"), "prices")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("listing_price").alias("m")).collect()}
    assert {r.k: r.median for r in medians_by_parts(df, ["k"], price_cuts(df)).collect()} == pytest.approx(want)
