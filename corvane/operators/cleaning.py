"""Validation and cleaning stages, the pipeline that runs them, and quality reports.

A stage takes rows to rows and names its metrics as aggregates; the pipeline computes all metrics of a stage in one
pass. A stage that can't be planned is logged as critical and skipped, as is one whose columns are missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import scalars as S
from corvane.operators.stats import exact_percentiles
from corvane.plans.canonical import broadcast_if_small
from corvane.plans.shared import freed, stored

REQUIRED = {"listings": ["event_id", "timestamp", "section", "listing_price"], "events": ["event_id", "event_type", "event_datetime", "artist_or_team", "venue_name", "city"], "snapshots": ["event_id", "seat_zone", "timestamp", "price_min"]}
ZONES = ["floor_vip", "lower_tier", "upper_tier", "balcony"]


@dataclass
class Result:
    data: DataFrame
    issues: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


def messages(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))


def validated_listings(df: DataFrame, now: Column) -> DataFrame:
    errors = {
        "event_id is missing": F.col("event_id").isNull() | (S.strip(F.col("event_id")) == ""), "price is not positive": F.col("listing_price").isNull() | (F.col("listing_price") <= 0),
        "section is missing": F.col("section").isNull() | (S.strip(F.col("section")) == ""), "quantity is below 1": F.col("quantity") < 1, "timestamp is in the future": F.col("timestamp") > now,
    }
    warnings = {"price is over 10000": F.col("listing_price") > 10_000, "markup is over 10": F.col("listing_price") > 10 * F.col("face_value"), "event is past": F.col("event_datetime") < now, "row is missing": F.col("row").isNull()}
    return df.withColumn("errors", messages(errors)).withColumn("warnings", messages(warnings)).withColumn("is_valid", F.size("errors") == 0)


def _empty(df: DataFrame, name: str) -> Column:
    """Null, empty or not a column at all."""
    return F.col(name).isNull() | (F.col(name) == "") if name in df.columns else F.lit(True)


def _checked(df: DataFrame, errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    return df.withColumn("errors", messages(errors)).withColumn("warnings", messages(warnings)).withColumn("is_valid", F.size("errors") == 0)


def validated_events(df: DataFrame, now: Column, venue: str = "venue_id", allow_past: bool = False) -> DataFrame:
    """errors, warnings and is_valid of event rows; a past event is only a warning."""
    errors = {"event_id is empty": _empty(df, "event_id"), "venue is empty": _empty(df, venue)}
    if "venue_capacity" in df.columns:
        errors["capacity is negative"] = F.col("venue_capacity") < 0
    past = F.lit(False) if allow_past else F.col("event_datetime") < now
    return _checked(df, errors, {"artist is empty": _empty(df, "artist_or_team"), "city is empty": _empty(df, "city"), "event is past": past})


def validated_snapshots(df: DataFrame, now: Column) -> DataFrame:
    """errors, warnings and is_valid of snapshot rows: prices in order, nothing negative; null prices break no order."""
    low, mid, high = F.col("price_min"), F.col("price_avg"), F.col("price_max")
    errors = {"event_id is empty": _empty(df, "event_id"), "average is below minimum": mid < low, "maximum is below minimum": high < low, "average is above maximum": mid > high}
    for c in ("days_to_event", "inventory_remaining"):
        if c in df.columns:
            errors[f"{c} is negative"] = F.col(c) < 0
    return _checked(df, errors, {"timestamp is in the future": F.col("timestamp") > now})


def offending(df: DataFrame, broken: Column, key: str, first: int = 100) -> DataFrame:
    """The least identifiers of rows that break a rule, `first` at most: a report, not the set of all of them."""
    return df.where(F.coalesce(broken, F.lit(False))).select(key).orderBy(key).limit(first)


#: Types that a column may have, by family.
FAMILIES = {"time": ("timestamp", "timestamp_ntz", "date"), "float": ("double", "float", "decimal", "tinyint", "smallint", "int", "bigint"), "int": ("tinyint", "smallint", "int", "bigint"), "text": ("string",)}
EXPECTED = {"timestamp": "time", "event_datetime": "time", "listing_price": "float", "face_value": "float", "price_min": "float", "price_avg": "float", "price_max": "float", "quantity": "int", "event_id": "text", "section": "text", "city": "text"}


def type_issues(df: DataFrame, expected: dict[str, str] | None = None) -> list[str]:
    """Columns whose type isn't of the family expected; whole numbers pass as floats. Read off the schema alone."""
    kinds = dict(df.dtypes)
    return [f"column {c} has type {kinds[c]}, not {f}" for c, f in (expected or EXPECTED).items() if c in kinds and kinds[c].split("(")[0] not in FAMILIES[f]]


def mostly_null(df: DataFrame, columns: list[str], most: float = 0.5) -> DataFrame:
    """Columns of which more than `most` is null."""
    return null_rates(df, columns).where(F.col("null_rate") > most)


def batch_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    bad = F.count_if(~F.col("is_valid"))
    return df.agg(n.alias("n"), (n - bad).alias("n_valid"), bad.alias("n_invalid"), F.count_if(F.size("warnings") > 0).alias("n_warned"), F.when(n > 0, bad / n).otherwise(0.0).alias("error_rate"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_null, null_rate: one aggregate, then one row per column."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("_n") - F.col(c)).alias("n_null")) for c in columns]))
    return row.select("_n", cells.alias("x")).select("x.column_name", "x.n_null", F.when(F.col("_n") > 0, F.col("x.n_null") / F.col("_n")).otherwise(0.0).alias("null_rate"))


def schema_issues(df: DataFrame, dataset: str) -> list[str]:
    return [f"column {c} is missing" for c in REQUIRED[dataset] if c not in df.columns]


def referential(df: DataFrame, events: DataFrame | None, zone: str | None = None) -> DataFrame:
    """One row: empty sections, unknown zones, rows whose event isn't known."""
    section = F.count_if(F.col("section").isNull() | (S.strip(F.col("section")) == "")) if "section" in df.columns else F.lit(0)
    zones = F.count_if(~F.col(zone).isin(ZONES)) if zone else F.lit(0)
    if events is not None:
        df = df.join(events.select(F.col("event_id")).distinct().withColumn("_known", F.lit(True)), "event_id", "left")
        orphans = F.count_if(F.col("_known").isNull() & F.col("event_id").isNotNull())
    else:
        orphans = F.lit(0)
    return df.agg(section.alias("empty_sections"), zones.alias("invalid_zones"), orphans.alias("orphans"))


def temporal(df: DataFrame, now: Column, allow_past: bool = False) -> DataFrame:
    """One row: future times, past events (0 where they are allowed), days_to_event off by two or more."""
    off = F.abs(S.floor_days(F.col("event_datetime"), F.col("timestamp")) - F.col("days_to_event")) >= 2
    return df.agg(F.count_if(F.col("timestamp") > now).alias("future_times"), (F.lit(0).cast("long") if allow_past else F.count_if(F.col("event_datetime") < now)).alias("past_events"), F.count_if(off).alias("days_off"))


def normalised_text(df: DataFrame) -> DataFrame:
    empty = F.lit("")
    return df.withColumns({"artist_normalized": S.folded(F.coalesce("artist_or_team", empty)), "venue_normalized": S.folded(F.coalesce("venue_name", empty)), "city_normalized": S.nickname_city(F.col("city"))})


def flag_outliers(df: DataFrame, price: str = "listing_price", low: float = 1.0, high: float = 50_000.0, k: float = 1.5) -> DataFrame:
    """is_outlier, outlier_reason: outside [low, high] first, then outside the quartiles by k times their distance."""
    q = exact_percentiles(df, price, [0.25, 0.75])
    p = F.col(price)
    reason = F.when(p < low, "below_min").when(p > high, "above_max")
    if q[0] is not None:
        a, b = q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])
        reason = reason.when(p < a, "iqr_low").when(p > b, "iqr_high")
    return df.withColumn("outlier_reason", reason).withColumn("is_outlier", reason.isNotNull())


DUPLICATE_KEY = ["event_id", "section", "row", "seat_from", "seat_to"]


def flag_duplicates(df: DataFrame, hours: float = 6.0, key: list[str] | None = None, seq: str = "listing_id", once: bool = False) -> DataFrame:
    """is_duplicate: within `hours` of the last kept row of the same key. Null event, section or row: never flagged.

    The anchor is the last kept row, which no fixed frame gives: rows of a key are folded in order of time. A key is one
    seat of one event, so a fold sees the sightings of one listing.
    """
    key = key or DUPLICATE_KEY
    hard = [k for k in key if not k.startswith("seat_")]
    if seq not in df.columns:  # a row is named by what it holds and, if it is repeated in full, by its turn
        content = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
        named = df.withColumn("_content", content)
        named = named.withColumn(seq, F.concat_ws("-", "_content", F.row_number().over(W.partitionBy("_content").orderBy("_content")))).drop("_content")
        return flag_duplicates(named, hours, key, seq, once).drop(seq).select(*df.columns, "is_duplicate")
    soft = [F.coalesce(k, F.lit("")).alias(f"_{k}") for k in key if k not in hard]
    whole = F.lit(True)
    for k in hard:
        whole = whole & F.col(k).isNotNull()
    points = df.where(whole).select(*hard, *soft, F.struct(S.micros(F.col("timestamp")).alias("t"), F.col(seq).alias("id")).alias("x"))
    names = [*hard, *[f"_{k}" for k in key if k not in hard]]
    limit = int(hours * 3.6e9)
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.array().cast(f"array<{dict(df.dtypes)[seq]}>").alias("out"))

    def step(held, x):
        near = F.coalesce(x["t"] - held["anchor"] < limit, F.lit(False))
        return F.struct(F.when(near, held["anchor"]).otherwise(x["t"]).alias("anchor"), F.when(near, F.array_append(held["out"], x["id"])).otherwise(held["out"]).alias("out"))

    groups = points.groupBy(*names).agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") > 1)
    dropped = groups.select(F.explode(F.aggregate("xs", start, step, lambda held: held["out"])).alias(seq), F.lit(True).alias("is_duplicate"))
    if once:
        dropped = broadcast_if_small(stored(dropped, "duplicates"))
        freed(df.sparkSession)
    return df.join(dropped, seq, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def impute(df: DataFrame, default_capacity: int = 15_000) -> DataFrame:
    """Capacity from the city's median, else the default; face value as half the price; with flags."""
    city = df.where("city is not null").groupBy("city").agg(F.median("venue_capacity").alias("_mid"))
    out = df.join(city, "city", "left") if "venue_capacity" in df.columns else df
    if "venue_capacity" in df.columns:
        out = out.withColumn("capacity_imputed", F.col("venue_capacity").isNull()).withColumn("venue_capacity", F.coalesce(F.col("venue_capacity").cast("double"), "_mid", F.lit(float(default_capacity)))).drop("_mid")
    if "face_value" in df.columns:
        out = out.withColumn("face_value_imputed", F.col("face_value").isNull()).withColumn("face_value", F.coalesce("face_value", F.col("listing_price") * 0.5))
    return out


def typed(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    out = df
    for c in numbers:
        out = out.withColumn(c, F.col(c).try_cast("double"))
    for c in times:
        out = out.withColumn(c, F.col(c).try_cast("timestamp_ntz"))
    return out


def zoned(df: DataFrame) -> DataFrame:
    return df.withColumn("normalized_seat_zone", S.zone(F.col("section")))


def timed(df: DataFrame) -> DataFrame:
    """hour_of_day, fractional days_to_event (two places) and is_weekend."""
    days = S.r2(S.seconds(F.col("event_datetime"), F.col("timestamp")) / 86400)
    return df.withColumns({"hour_of_day": F.hour("timestamp"), "days_to_event": days, "is_weekend": F.weekday("event_datetime").isin(5, 6)})


Stage = tuple[str, Callable[[DataFrame], DataFrame], dict[str, Column]]


class Pipeline:
    """Stages in order; issues carry the stage's name."""

    def __init__(self, stages: list[Stage], dataset: str | None = None):
        self.stages, self.dataset = stages, dataset

    def process(self, df: DataFrame) -> Result:
        result = Result(df, schema_issues(df, self.dataset) if self.dataset else [])
        for name, stage, metrics in self.stages:
            try:
                out = stage(result.data)
                row = out.agg(F.count(F.lit(1)).alias("output_rows"), *[c.alias(k) for k, c in metrics.items()]).collect()[0].asDict()
            except Exception as error:  # noqa: BLE001  a failed stage is reported and skipped
                result.issues.append(f"[CRITICAL] {name}: {str(error).splitlines()[0][:200]}")
                continue
            result.data = out
            result.metrics |= {f"{name}.{k}": v for k, v in row.items()}
            result.issues += [f"[{name}] {k}: {v}" for k, v in row.items() if k != "output_rows" and v]
        result.metrics["input_rows"] = df.count()
        return result


def listing_pipeline(events: DataFrame | None = None) -> Pipeline:
    stages: list[Stage] = [
        ("types", lambda d: typed(d, ["listing_price"], ["timestamp", "event_datetime"]), {}),
        ("text", normalised_text, {}),
        ("zones", zoned, {"unmappable": F.count_if(F.col("section").isNull() | (F.col("section") == ""))}),
        ("times", timed, {}),
        ("impute", impute, {}),
        ("outliers", flag_outliers, {"outliers": F.count_if(F.col("is_outlier"))}),
        ("duplicates", lambda d: flag_duplicates(d, once=True), {"duplicates": F.count_if(F.col("is_duplicate"))}),
    ]
    if events is not None:
        known = broadcast_if_small(stored(events.select("event_id").distinct(), "known-events")).withColumn("_known", F.lit(True))
        stages.append(("references", lambda d: d.join(known, "event_id", "left").withColumn("has_event", F.coalesce("_known", F.lit(False))).drop("_known"), {"orphans": F.count_if(~F.col("has_event"))}))
    return Pipeline(stages, "listings")


THRESHOLDS = {"drop_rate": (0.05, 0.20), "null_rate": (0.10, 0.50), "outlier_rate": (0.05, 0.15), "duplicate_rate": (0.05, 0.20)}


def alerts(rates: dict[str, float]) -> dict[str, str]:
    """ok, warning or critical for each rate."""
    return {k: "critical" if rates.get(k, 0) > c else "warning" if rates.get(k, 0) > w else "ok" for k, (w, c) in THRESHOLDS.items()}


def against_baseline(now: Column, baseline: Column, least: float) -> Column:
    """improved, degraded or stable, for numbers where more is better."""
    return F.when(now - baseline > least, "improved").when(baseline - now > least, "degraded").otherwise("stable")


def sequence_in(df: DataFrame, key: str, order: list) -> Column:
    return F.row_number().over(W.partitionBy(key).orderBy(*order))
