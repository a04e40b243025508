"""Trained models as artefacts, and predictions from them: one batch of expressions for any number of rows.

An artefact is a folder: the model, one parquet table per fitted statistic, and one row of JSON for everything small
(fitted numbers, columns, target, metrics). Nothing is gathered on the driver but that row, and every path goes through
Spark, so the folder may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators import collect, models, serve, splits
from corvane.operators.features import FeaturePipeline

MODELS = {"boosted": models.Boosted, "forest": models.Forest, "ridge": models.Ridge}
#: A section that stands for each zone where a listing has none yet. Fixed values.
ZONE_SECTION = {"floor_vip": "Floor VIP", "lower_tier": "Lower Level 100", "upper_tier": "Upper Level 200", "balcony": "Balcony 400"}


class UnknownEvent(ValueError):
    """Rows name events that the training rows don't hold."""


def _stated(thing: object, folder: str, skip: tuple = ()) -> dict:
    """Writes the tables among an object's fitted values; gives its small values and the places of its tables."""
    small, tables = {}, []

    def write(value: DataFrame, attr: str, key=None) -> None:
        path = f"{folder}/{attr}" + ("" if key is None else "-" + "-".join(map(str, key)))
        value.write.mode("overwrite").parquet(path)
        tables.append({"attr": attr, "key": key and list(key), "path": path.removeprefix(folder)})

    for attr, value in vars(thing).items():
        if attr in skip:
            continue
        if isinstance(value, DataFrame):
            write(value, attr)
        elif isinstance(value, dict) and any(isinstance(v, DataFrame) for v in value.values()):
            for key, v in value.items():
                write(v, attr, key)
        else:
            small[attr] = value
    return {"small": small, "tables": tables}


def _restored(thing: object, state: dict, spark: SparkSession, folder: str) -> None:
    vars(thing).update(state["small"])
    for t in state["tables"]:
        found = spark.read.parquet(folder + t["path"])
        if t["key"] is None:
            setattr(thing, t["attr"], found)
        else:
            held = vars(thing).setdefault(t["attr"], {})
            held[tuple(t["key"])] = found


def save(made: models.Trained, path: str) -> None:
    """Writes a folder of artefacts; one that is there is overwritten part by part."""
    kind = next((k for k, c in MODELS.items() if type(made.model) is c), None)
    if kind is None:
        raise ValueError(f"a {type(made.model).__name__} can't be stored; there are {', '.join(MODELS)}")
    if not set(made.features.extractors) <= set(FeaturePipeline().extractors) | {"momentum"}:
        raise ValueError("features from a table of popularity counts can't be stored")
    spark = made.known.sparkSession
    made.model.save(f"{path}/model")
    made.known.write.mode("overwrite").parquet(f"{path}/known")
    meta = {
        "kind": kind, "columns": made.columns, "label": made.model.label, "weight": made.model.weight, "log": made.log, "metrics": made.metrics, "target": made.target_name,
        "extractors": {n: _stated(e, f"{path}/features/{n}", ("_held",)) for n, e in made.features.extractors.items()}, "transform": _stated(made.target, f"{path}/target"),
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> models.Trained:
    """What `save` wrote, ready to predict; nothing is fitted again."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    features = FeaturePipeline(tuple(n for n in FeaturePipeline().extractors if n not in meta["extractors"]), momentum="momentum" in meta["extractors"])
    for n, state in meta["extractors"].items():
        _restored(features.extractors[n], state, spark, f"{path}/features/{n}")
    target = splits.target(meta["target"])
    _restored(target, meta["transform"], spark, f"{path}/target")
    model = MODELS[meta["kind"]](meta["columns"], meta["label"], meta["weight"]).load(f"{path}/model")
    return models.Trained(model, features, meta["columns"], meta["metrics"], target, meta["target"], meta["log"], spark.read.parquet(f"{path}/known"))


def scored(made: models.Trained, rows: DataFrame) -> DataFrame:
    """rows with features and `predicted`, a price."""
    out = made.target.prepare(made.features.transform(rows, False))
    out = made.model.predict(collect.log_columns(out, made.log) if made.log else out)
    return out.withColumn("predicted", made.target.back(F.col("prediction")))


def cold_start_price(artist: Column, city: Column, kind: Column, zone: Column) -> Column:
    """The estimate that needs no history, for the zone of a row."""
    by_zone = serve.mapped(zone, serve.ZONE_PRICE, serve.ZONE_PRICE["upper_tier"])
    return by_zone * serve.category_factor(artist) * serve.mapped(S.city_tier(city), serve.CITY_FACTOR, 1.0) * serve.mapped(F.upper(kind), serve.TYPE_FACTOR, 1.0)


PREDICTED = ["predicted", "baseline", "price_lower_bound", "price_upper_bound", "confidence_score", "predicted_direction", "direction_probability"]


def predict(made: models.Trained, rows: DataFrame, unknown: str = "error") -> DataFrame:
    """rows with the columns PREDICTED: price, cold-start baseline, bounds, confidence, direction and its probability.

    Rows of events that training never saw (a null event too): `error` raises UnknownEvent before any feature is made,
    `drop` leaves them out, `keep` predicts them from the fallbacks of the statistics. A null artist, city or type
    counts as one of no category. Columns of rows that share a name with PREDICTED are replaced.
    """
    if unknown not in ("error", "drop", "keep"):
        raise ValueError(f"unknown is error, drop or keep, not {unknown}")
    keep = [c for c in rows.columns if c not in PREDICTED]
    if unknown == "error":
        missing = rows.join(made.known, "event_id", "left_anti").select("event_id").limit(5).collect()
        if missing:
            raise UnknownEvent(f"events not seen in training: {', '.join(sorted({str(r.event_id) for r in missing}))}")
    elif unknown == "drop":
        rows = rows.join(made.known, "event_id", "left_semi")
    out = scored(made, rows.select(*keep))
    empty = F.lit("")
    baseline = cold_start_price(F.coalesce("artist_or_team", empty), F.col("city"), F.coalesce("event_type", empty), S.zone(F.col("section")))
    return serve.with_bounds(out.withColumn("baseline", baseline)).select(*keep, *PREDICTED)


def predict_zones(made: models.Trained, events: DataFrame, unknown: str = "error") -> DataFrame:
    """Four rows per event row: `zone` and its prediction, for a section that stands for the zone, row 10."""
    zones = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(s).alias("section")) for z, s in ZONE_SECTION.items()]))
    rows = events.drop("zone", "section", "row").select("*", zones.alias("_z")).select("*", "_z.zone", "_z.section", F.lit("10").alias("row")).drop("_z")
    if "listing_id" not in rows.columns:
        rows = rows.withColumn("listing_id", F.concat_ws("-", "event_id", "zone"))
    for name, value in (("quantity", F.lit(2)), ("face_value", F.lit(None).cast("double")), ("seat_from", F.lit(None).cast("string")), ("seat_to", F.lit(None).cast("string")), ("listing_price", F.lit(None).cast("double"))):
        rows = rows if name in rows.columns else rows.withColumn(name, value)
    return predict(made, rows, unknown)
