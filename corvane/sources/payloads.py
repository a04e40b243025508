"""Parsers of nested payloads: JSON text in a landing zone to flat tables. Transport is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISCOVERY = (
    "id string, name string, dates struct<start: struct<dateTime: string, localDate: string>>, classifications array<struct<segment: struct<name: string>>>, "
    "_embedded struct<venues: array<struct<id: string, name: string, city: struct<name: string>, country: struct<countryCode: string>>>, attractions: array<struct<name: string>>>"
)
CONCERT = "id string, eventDate string, artist struct<name: string>, venue struct<name: string, city: struct<name: string, country: struct<code: string>>>, tour struct<name: string>, url string"
#: Tickets come with short or long keys.
MARKET = "event string, tickets array<struct<i: string, id: string, sectionName: string, s: string, row: string, r: string, quantity: string, q: string, allInPricePerTicket: string, p: string, ls: string, hs: string>>"


def event_type(segment: Column) -> Column:
    s = F.lower(segment)
    return F.when(s.contains("sport"), "sports").when(s.rlike("art|theatre|theater"), "theater").otherwise("concert")


def timestamp_of(text: Column) -> Column:
    """ISO times with `Z`, an offset or a [Zone] suffix; a date alone is midnight."""
    t = F.regexp_replace(F.regexp_replace(text, r"\[.*$", ""), "Z$", "")
    return F.to_timestamp_ntz(F.when(t.contains("T"), t).otherwise(F.concat(t, F.lit("T00:00:00"))))


def discovery_events(raw: DataFrame) -> DataFrame:
    """raw (payload): event metadata with defaults for what is missing; rows without an identifier are dropped."""
    e = F.from_json("payload", DISCOVERY)
    rows = raw.select(e.alias("e")).where("e.id is not null")
    venue = F.get(F.col("e._embedded.venues"), 0)
    artist = F.get(F.col("e._embedded.attractions"), 0)["name"]
    start = F.coalesce(F.nullif(F.col("e.dates.start.dateTime"), F.lit("")), F.col("e.dates.start.localDate"))
    return rows.select(
        F.col("e.id").alias("event_id"), event_type(F.coalesce(F.get(F.col("e.classifications"), 0)["segment"]["name"], F.lit(""))).alias("event_type"), timestamp_of(start).alias("event_datetime"), F.coalesce(artist, F.col("e.name"), F.lit("Unknown")).alias("artist_or_team"),
        F.coalesce(venue["id"], F.lit("unknown")).alias("venue_id"), F.coalesce(venue["name"], F.lit("Unknown Venue")).alias("venue_name"), F.coalesce(venue["city"]["name"], F.lit("Unknown")).alias("city"), F.coalesce(venue["country"]["countryCode"], F.lit("US")).alias("country"),
    )


def concerts(raw: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """raw (payload): past concerts; dates are DD-MM-YYYY, rows without a date are dropped."""
    c = raw.select(F.from_json("payload", CONCERT).alias("c"))
    day = F.to_date(F.when(F.col("c.eventDate").rlike(r"^\d{2}-\d{2}-\d{4}$"), F.col("c.eventDate")), "dd-MM-yyyy")
    out = c.select(
        F.coalesce("c.id", F.lit("")).alias("event_id"), F.col("c.artist.name").alias("artist_name"), day.alias("event_date"), F.coalesce("c.venue.name", F.lit("Unknown Venue")).alias("venue_name"), F.coalesce("c.venue.city.name", F.lit("Unknown City")).alias("city"),
        F.coalesce("c.venue.city.country.code", F.lit("US")).alias("country"), F.col("c.tour.name").alias("tour_name"),
    ).where("event_date is not null")
    if first_year:
        out = out.where(F.year("event_date") >= first_year)
    return out.where(F.year("event_date") <= last_year) if last_year else out


def marketplace_listings(raw: DataFrame, most: int = 500) -> DataFrame:
    """raw (payload): one row per ticket group; long keys, then short ones, then defaults. Groups whose numbers don't parse are dropped."""
    t = raw.select(F.from_json("payload", MARKET).alias("m")).select(F.col("m.event").alias("event_id"), F.explode(F.slice("m.tickets", 1, most)).alias("t"))
    quantity = F.coalesce(F.nullif(F.coalesce("t.quantity", "t.q", F.lit("1")), F.lit("")), F.lit("1")).try_cast("int")
    price = F.coalesce(F.nullif(F.coalesce("t.allInPricePerTicket", "t.p", F.lit("0")), F.lit("")), F.lit("0")).try_cast("double")
    out = t.select(
        "event_id", F.coalesce("t.i", "t.id", F.lit("")).alias("listing_id"), F.coalesce("t.sectionName", "t.s", F.lit("Unknown")).alias("section"), F.coalesce("t.row", "t.r", F.lit("GA")).alias("row"),
        F.nullif(F.col("t.ls"), F.lit("")).alias("seat_from"), F.nullif(F.col("t.hs"), F.lit("")).alias("seat_to"), quantity.alias("quantity"), price.alias("price_per_ticket"), (price * quantity).alias("total_price"),
    )
    return out.where("quantity is not null and price_per_ticket is not null")


PARKING = 75


def marketplace_events(raw: DataFrame) -> DataFrame:
    """raw (category, payload): events of browse pages; parking and events without a master performer go, the first category of an event counts."""
    schema = "id string, name string, localDate string, subCategoryId int, performers array<struct<name: string, master: boolean>>"
    e = raw.select("category", F.from_json("payload", schema).alias("e")).where("e.id is not null").where(F.coalesce(F.col("e.subCategoryId"), F.lit(0)) != PARKING)
    master = F.get(F.filter("e.performers", lambda p: p["master"]), 0)["name"]
    rows = e.select("category", F.col("e.id").alias("event_id"), F.col("e.name").alias("event_name"), timestamp_of(F.col("e.localDate")).alias("event_datetime"), master.alias("artist_or_team")).where("artist_or_team is not null")
    return rows.groupBy("event_id").agg(F.min_by(F.struct("event_name", "event_datetime", "artist_or_team", "category"), "category").alias("r")).select("event_id", "r.*")


def experiments(spark, path: str) -> DataFrame:
    """A log of runs, one JSON object a line; lines that don't parse are skipped."""
    schema = "version string, primary_mae double, overall_mae double, seen_mae double, unseen_mae double, q4_mae double, commit string, timestamp string, fold_idx int, features_n int"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# payloads made of the part table, for tests and queries


def sample_discovery(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    day = F.date_format(F.expr("date'1998-01-01' + cast(p_partkey % 500 as int)"), "yyyy-MM-dd")
    start = F.when(p % 3 == 0, F.struct(F.concat(day, F.lit("T19:30:00Z")).alias("dateTime"), F.lit(None).cast("string").alias("localDate"))).otherwise(F.struct(F.lit(None).cast("string").alias("dateTime"), day.alias("localDate")))
    kind = F.when(p % 4 == 0, "Sports").when(p % 4 == 1, "Arts & Theatre").otherwise("Music")
    venue = F.array(F.struct(F.concat(F.lit("v"), F.col("p_size")).alias("id"), F.col("p_type").alias("name"), F.struct(F.when(p % 5 != 0, F.col("p_brand")).alias("name")).alias("city")))
    embedded = F.struct(F.when(p % 7 != 0, venue).alias("venues"), F.when(p % 2 == 0, F.array(F.struct(F.col("p_brand").alias("name")))).alias("attractions"))
    return part.select(F.to_json(F.struct(F.concat(F.lit("d"), p).alias("id"), F.col("p_name").alias("name"), F.struct(start.alias("start")).alias("dates"), F.when(p % 6 != 0, F.array(F.struct(F.struct(kind.alias("name")).alias("segment")))).alias("classifications"), embedded.alias("_embedded"))).alias("payload"))


def sample_concerts(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    day = F.date_format(F.expr("date'1998-01-01' + cast(p_partkey % 1400 as int)"), "dd-MM-yyyy")
    return part.select(F.to_json(F.struct(F.concat(F.lit("c"), p).alias("id"), F.when(p % 9 != 0, day).otherwise("").alias("eventDate"), F.struct(F.col("p_brand").alias("name")).alias("artist"), F.when(p % 4 != 0, F.struct(F.col("p_type").alias("name"))).alias("venue"), F.when(p % 2 == 0, F.struct(F.col("p_name").alias("name"))).alias("tour"))).alias("payload"))


def sample_marketplace(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    names = ["i", "id", "sectionName", "s", "row", "r", "quantity", "q", "allInPricePerTicket", "p", "ls", "hs"]

    def ticket(**given):
        return F.struct(*[given.get(n, F.lit(None)).cast("string").alias(n) for n in names])

    long = ticket(i=F.concat(p, F.lit("a")), sectionName=F.col("p_type"), row=F.lit("B"), quantity=F.col("p_size"), allInPricePerTicket=F.col("p_retailprice"), ls=F.lit("3"), hs=F.lit("4"))
    short = ticket(id=F.concat(p, F.lit("b")), s=F.col("p_brand"), q=F.when(p % 5 == 0, "many").otherwise(""), p=F.col("p_size") * 2)
    return part.select(F.to_json(F.struct(F.concat(F.lit("m"), p).alias("event"), F.array(long, short).alias("tickets"))).alias("payload"))
