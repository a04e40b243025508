"""Command line: python -m corvane.cli <command> --data DIR ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import cleaning, evaluate, labels, models, predictor, serve, splits
from corvane.sources import payloads


def session() -> SparkSession:
    return SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name, *flags):
        p = commands.add_parser(name)
        p.add_argument("--data", required=True, help="a parquet table of listings, or a JSON log for leaderboard and stalled")
        for flag, kind, default in flags:
            p.add_argument(f"--{flag}", type=kind, default=default) if kind is not bool else p.add_argument(f"--{flag}", action="store_true")

    command("preprocess", ("output", str, None), ("events", str, None), ("watermark", str, None), ("dry-run", bool, None))
    command("train", ("output", str, None), ("target", str, "log"), ("model", str, "boosted"), ("weights", str, None), ("without", str, "snapshot"), ("log-prices", bool, None), ("least-importance", float, None))
    command("predict", ("model", str, None), ("output", str, None), ("unknown", str, "error"), ("zones", bool, None))
    command("train-sale", ("window-hours", float, 24.0), ("absent", int, 2), ("labels", str, "absence"), ("snapshots", str, None))
    command("coverage")
    command("gate", ("share", float, 0.3))
    command("leaderboard", ("limit", int, 20), ("by", str, "mae"))
    command("stalled")
    command("cold-start")
    return out


def price_model(kind: str):
    makes = {"boosted": models.Boosted, "forest": models.Forest, "ridge": models.Ridge}
    if kind not in makes:
        raise SystemExit(f"no model named {kind}; there are {', '.join(makes)}")
    return lambda columns, weight: makes[kind](columns, weight=weight)


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    if args.command in ("leaderboard", "stalled"):
        runs = payloads.experiments(spark, args.data)
        if args.command == "stalled":
            runs = runs.select(F.coalesce("primary_mae", "overall_mae").alias("mae"), F.col("timestamp").alias("seq"))
            found = evaluate.stalled(runs).collect()[0]
            print(json.dumps(found.asDict()))
            return int(found.stalled)
        evaluate.leaderboard(runs, args.limit, args.by).show(args.limit, False)
        return 0
    rows = spark.read.option("mergeSchema", "true").parquet(args.data)
    if args.command == "preprocess":
        if args.watermark:
            rows = rows.where(F.concat_ws("/", "year", "month", "day") > args.watermark)
        result = cleaning.listing_pipeline(spark.read.parquet(args.events) if args.events else None).process(rows)
        print(json.dumps({"issues": result.issues, "metrics": result.metrics}, default=str))
        if args.output and not args.dry_run:
            result.data.write.mode("overwrite").parquet(args.output)
    elif args.command == "train":
        made = models.train(rows, price_model(args.model), args.target, weights=args.weights, without=tuple(x for x in args.without.split(",") if x), log_prices=args.log_prices, least_importance=args.least_importance)
        print(json.dumps(made.metrics | {"features": len(made.columns)}))
        if args.output:
            predictor.save(made, args.output)
    elif args.command == "predict":
        made = predictor.load(spark, args.model)
        out = (predictor.predict_zones if args.zones else predictor.predict)(made, rows, args.unknown)
        out.write.mode("overwrite").parquet(args.output) if args.output else out.show(40, False)
    elif args.command == "train-sale":
        labelled = labels.absence_labels(rows, args.window_hours, args.absent) if args.labels == "absence" else labels.depletion_labels(rows, spark.read.parquet(args.snapshots), int(args.window_hours))
        parts = splits.temporal_split(labelled.withColumnRenamed("sold", "label"), ["event_datetime", "listing_id"])
        one, two = (labels.sale_features(parts.where(f"split = '{s}'"), parts.where("split = 'train'"), ["event_id"]) for s in ("train", "test"))
        names = ["price_z", "price_to_median", "days_to_event"]
        out = models.SaleProbability(names).fit(one).predict(two, "score")
        print(json.dumps(evaluate.classification(out).collect()[0].asDict() | evaluate.ece(evaluate.calibration(out)).collect()[0].asDict()))
    elif args.command == "coverage":
        evaluate.events_per_artist(rows).show(50, False)
        evaluate.city_months(rows).orderBy(F.desc("events")).show(50, False)
    elif args.command == "gate":
        parts = splits.temporal_split(rows, ["event_datetime", "listing_id"])
        evaluate.low_count_gate(parts.where("split = 'train'"), parts.where("split = 'test'"), args.share).groupBy("gate_on", "unseen").count().show()
    elif args.command == "cold-start":
        serve.cold_start(rows).show(40, False)
    return 0


if __name__ == "__main__":
    sys.exit(run())
