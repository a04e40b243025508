"""Train, store, load, predict: a loaded model gives what the trained one gives; unknown events are told apart."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import models, predictor
from corvane.plans.canonical import listings

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WITHOUT = ("snapshot", "cold_start", "listing_structural", "interaction", "within_event", "regional")


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables here")
    path = str(tmp_path_factory.mktemp("rows"))
    listings(spark, SF_DIR).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("target", ["log", "relative"])
def test_a_stored_model_predicts_the_same(spark, rows, tmp_path, target):
    made = models.train(rows, lambda c, w: models.Ridge(c, weight=w), target, without=WITHOUT, log_prices=target == "log", least_importance=1e-9)
    predictor.save(made, str(tmp_path / "m"))
    again = predictor.load(spark, str(tmp_path / "m"))
    assert again.columns == made.columns and again.metrics.keys() == made.metrics.keys() and bool(made.log) == (target == "log")
    some = rows.where("not is_train").withColumn("predicted", F.lit("a column of the caller"))
    one, two = ({r.listing_id: r.predicted for r in predictor.predict(m, some, "keep").collect()} for m in (made, again))
    assert len(one) == some.count() and all(abs(one[k] - two[k]) < 1e-6 * max(1, abs(one[k])) for k in one)
    out = predictor.predict(again, rows.limit(20), "keep").toPandas()
    assert (out.price_lower_bound <= out.predicted).all() and out.baseline.gt(0).all() and out.confidence_score.between(0, 1).all()


def test_unknown_events_and_zones(spark, rows, tmp_path):
    made = models.train(rows, lambda c, w: models.Ridge(c, weight=w), without=WITHOUT)
    event = made.known.first().event_id
    known, other = rows.where(F.col("event_id") == event).limit(1), rows.limit(1).withColumn("event_id", F.lit("never"))
    both = known.unionByName(other)
    with pytest.raises(predictor.UnknownEvent, match="never"):
        predictor.predict(made, both)
    assert [r.event_id for r in predictor.predict(made, both, "drop").collect()] == [event]
    assert predictor.predict(made, both, "keep").count() == 2 and predictor.predict(made, both.limit(0)).count() == 0
    zones = predictor.predict_zones(made, known.drop("listing_id")).collect()
    assert sorted(r.zone for r in zones) == sorted(predictor.ZONE_SECTION) and all(r.predicted >= 0 for r in zones)
    with pytest.raises(ValueError):
        predictor.predict(made, both, "perhaps")


def test_command_line_stores_and_predicts(spark, rows, tmp_path):
    from corvane import cli

    data, model, out = (str(tmp_path / n) for n in ("data", "model", "out"))
    rows.write.parquet(data)
    without = ",".join(WITHOUT)
    assert cli.run(["train", "--data", data, "--output", model, "--model", "ridge", "--without", without], spark) == 0
    assert cli.run(["predict", "--data", data, "--model", model, "--output", out, "--unknown", "drop"], spark) == 0
    got = spark.read.parquet(out)
    assert 0 < got.count() <= rows.count() and set(predictor.PREDICTED) <= set(got.columns)
