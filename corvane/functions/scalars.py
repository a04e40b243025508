"""Scalar library over columns: zones, sections, rows, seats, places, dates, counts. All native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zones in the order in which their words are tried, and their price ratios and codes.
ZONE_WORDS = {
    "floor_vip": ["floor", "vip", "pit", "field", "courtside", "front row", "premium", "platinum", "club", "suite"],
    "lower_tier": ["lower", "100", "orchestra", "main floor", "loge", "terrace", "box"],
    "upper_tier": ["upper", "200", "300", "400", "mezzanine", "club level", "press level"],
    "balcony": ["balcony", "gallery", "nosebleed", "500", "rear", "obstructed", "limited view"],
}
ZONE_RATIO = {"floor_vip": 1.0, "lower_tier": 0.70, "upper_tier": 0.45, "balcony": 0.25}
ZONE_CODE = {"floor_vip": 3, "lower_tier": 2, "upper_tier": 1, "balcony": 0}
SYNTHETIC_ZONE_RATIO = {"floor_vip": 1.0, "lower_tier": 0.65, "upper_tier": 0.40, "balcony": 0.25}
# Words that tell what a section is.
PREMIUM_WORDS = ["vip", "platinum", "premium", "pit", "field", "courtside", "front row", "suite"]
NAMED_WORDS = ["orchestra", "loge", "club", "terrace", "garden", "mezzanine", "parterre", "promenade", "pavilion", "lodge", "loggia", "tier", "dress circle", "grand tier", "founder", "diamond", "platinum", "gold", "silver"]
GA_WORDS = ["ga", "general admission", "standing", "standing room", "floor standing"]
VIP_WORDS = ["vip", "premium", "platinum", "suite", "box", "skybox", "sky box", "luxury", "lounge"]
FLOOR_WORDS = ["floor", "pit", "field", "courtside", "infield", "on ice", "ice"]
OBSTRUCTED_WORDS = ["limited view", "obstructed", "restricted view", "partial view"]
GROUND_LEVEL_WORDS = ["floor", "pit", "field", "courtside", "infield", "ga", "general admission", "standing"]
NUMBER_LEVELS = [(100, 199, 0.2), (200, 299, 0.5), (300, 399, 0.7), (400, 499, 0.85), (500, 9999, 1.0)]
WORD_LEVELS = [
    (["orchestra", "parterre", "lower", "dress circle"], 0.2),
    (["mezzanine", "loge", "club", "terrace", "promenade", "grand tier"], 0.5),
    (["upper", "balcony", "gallery", "nosebleed", "founder", "tier"], 0.85),
]
# Places.
FIRST_TIER_CITIES = ["new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose", "las vegas", "miami", "boston", "atlanta", "san francisco"]
SECOND_TIER_CITIES = ["seattle", "denver", "washington", "nashville", "austin", "detroit", "portland", "charlotte", "orlando", "minneapolis", "tampa", "pittsburgh", "st. louis", "baltimore", "salt lake city"]
FOREIGN_CITIES = {
    "bangkok": "TH", "seoul": "KR", "london": "GB", "tokyo": "JP", "paris": "FR", "berlin": "DE", "sydney": "AU", "toronto": "CA", "mexico city": "MX", "são paulo": "BR", "mumbai": "IN", "singapore": "SG",
    "manila": "PH", "jakarta": "ID", "ho chi minh city": "VN", "taipei": "TW", "hong kong": "HK", "kuala lumpur": "MY", "dubai": "AE", "amsterdam": "NL", "dusseldorf": "DE", "glasgow": "GB", "manchester": "GB",
}
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
CITY_NICKNAMES = {"nyc": "new york", "la": "los angeles", "sf": "san francisco", "dc": "washington", "nola": "new orleans", "vegas": "las vegas", "philly": "philadelphia"}


def r4(x: Column) -> Column:
    """Four places, by the same IEEE steps in any engine. The border lies a little off the half, where means of prices don't fall."""
    return F.floor(x * 10000 + 0.5003) / 10000


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def folded(s: Column) -> Column:
    return strip(F.lower(s))


def any_of(words: list[str]) -> str:
    """An alternation of literal words."""
    return "|".join(w.replace(".", r"\.") for w in words)


def any_in(s: Column, words: list[str]) -> Column:
    """Whether s holds any of the words: plain searches, several times as fast as one pattern of alternatives."""
    return reduce(or_, [s.contains(w) for w in words])


def has(s: Column, words: list[str]) -> Column:
    return any_in(F.lower(s), words)


def r2(x: Column) -> Column:
    """Two places, halves to the even digit."""
    return F.rint(x * 100) / 100


def position(x: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are below x, by binary search."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(held, at + s - 1) < x, F.lit(False)), at + s).otherwise(at))


def cents(price: Column) -> Column:
    return F.rint(price * 100).cast("long")


def title_artist(title):
    """What stands before the first " at " of a listing's title; the whole title without one."""
    return F.substring_index(title, " at ", 1)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between, negative ones downwards."""
    return F.floor(seconds(later, earlier) / 86400)


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps without zone, with fractions."""
    return (micros(later) - micros(earlier)) / 1e6


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def first_number(s: Column, pattern: str = r"\b([0-9]{1,4})\b") -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).cast("int")


def zone(section: Column) -> Column:
    """The seat zone: the first zone whose words occur, else by `section <number>`, else upper tier."""
    name = F.lower(F.coalesce(section, F.lit("")))
    number = F.regexp_extract(name, r"section\s*([0-9]+)", 1).try_cast("double")
    out = F
    for z, words in ZONE_WORDS.items():
        out = out.when(any_in(name, words), z)
    return out.when(number < 100, "floor_vip").when(number < 200, "lower_tier").when(number < 500, "upper_tier").when(number.isNotNull(), "balcony").otherwise("upper_tier")


def by_zone(zone_name: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[zone_name], F.lit(default))


def zone_prices(low: Column, high: Column, ratios: dict = ZONE_RATIO) -> Column:
    """array of (zone, price): the price range dealt to the zones."""
    top = F.when(high <= 0, low).otherwise(high)
    a, b = F.least(low, top), F.greatest(low, top)
    return F.array(*[F.struct(F.lit(z).alias("zone"), r2(a + (b - a) * r).alias("price")) for z, r in ratios.items()])


def section_level(section: Column) -> Column:
    s = F.lower(section)
    n = first_number(s)
    out = F.when(any_in(s, GROUND_LEVEL_WORDS), 0.0)
    for low, high, level in NUMBER_LEVELS:
        out = out.when(n.between(low, high), level)
    for words, level in WORD_LEVELS:
        out = out.when(any_in(s, words), level)
    return out.otherwise(0.5)


def _letters(r: Column) -> Column:
    """A = 1 ... Z = 26, AA = 1, AB = 2 ...: the place of a row of one or two letters."""
    one = F.ascii(r) - 64
    two = (F.ascii(r) - 65) * 26 + F.ascii(F.substring(r, 2, 1)) - 64
    return F.when(r.rlike("^[A-Z]$"), one).when(r.rlike("^[A-Z]{2}$"), two)


def row_quality(row: Column) -> Column:
    r = F.upper(strip(row))
    n = first_number(r, "([0-9]+)").cast("double")
    return F.when(row.isNull() | r.isin("", "GA", "GENERAL", "STANDING", "N/A", "-"), 0.5).when(_letters(r).isNotNull(), F.least(_letters(r) * 0.02, F.lit(1.0))).when(n.isNotNull(), F.least(n / 50.0, F.lit(1.0))).otherwise(0.5)


def row_number(row: Column) -> Column:
    r = F.upper(strip(row))
    n = first_number(r, "([0-9]+)")
    return F.when(row.isNull() | (r == ""), 10).when(r.isin("GA", "GENERAL", "STANDING"), 0).otherwise(F.coalesce(n, _letters(r), F.lit(10)))


def row_bucket(row: Column) -> Column:
    r = F.upper(strip(row))
    q = row_quality(row)
    return F.when(row.isNull() | r.isin("", "N/A", "-"), "unknown").when(r.isin("GA", "GENERAL", "STANDING"), "ga").when(q < 0.2, "front").when(q < 0.5, "mid").otherwise("back")


BUCKET_CODE = {"front": 0, "mid": 1, "back": 2, "ga": 3, "unknown": 4}


def seat_number(seat: Column) -> Column:
    """The number of a seat up to 999, -1 if it has none."""
    s = strip(seat)
    return F.when(s.rlike(r"^\+?[0-9]+$"), F.least(F.regexp_replace(s, r"\+", "").cast("double"), F.lit(999.0)).cast("int")).otherwise(-1)


def section_hash(section: Column) -> Column:
    return F.conv(F.right(F.md5(folded(section).cast("binary")), F.lit(2)), 16, 10).cast("int") % 32


def section_number(section: Column) -> Column:
    n = first_number(F.lower(section))
    return F.when(n <= 999, n).otherwise(0)


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(strip(s), r"\s+"), lambda w: w != ""))


def city_name(city: Column) -> Column:
    """Lower case, without `, ST` of a state."""
    return strip(F.regexp_replace(folded(city), r",\s(" + "|".join(STATES).lower() + r")\s*$", ""))


def country_of(name: Column) -> Column:
    """The country of what city_name gives."""
    table = F.create_map(*[F.lit(x) for kv in FOREIGN_CITIES.items() for x in kv])
    return F.coalesce(table[name], F.lit("US"))


def country(city: Column) -> Column:
    return country_of(city_name(city))


def region_of(name: Column) -> Column:
    """The region of what city_name gives."""
    return F.concat(country_of(name), F.lit(":"), name)


def region_key(city: Column) -> Column:
    return region_of(city_name(city))


def city_tier(city: Column) -> Column:
    c = city_name(city)
    return F.when(c.isin(FIRST_TIER_CITIES), 1).when(c.isin(SECOND_TIER_CITIES), 2).otherwise(3)


def nickname_city(city: Column) -> Column:
    """Lower case, nicknames written out, null as empty."""
    c = folded(F.coalesce(city, F.lit("")))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CITY_NICKNAMES.items() for x in kv])[c], c)


def capacity_bucket(capacity: Column) -> Column:
    return F.when(capacity.isNull(), 2).when(capacity < 5000, 0).when(capacity < 15000, 1).when(capacity < 40000, 2).otherwise(3)


def urgency(days: Column) -> Column:
    return F.when(days <= 1, 5).when(days <= 7, 4).when(days <= 14, 3).when(days <= 30, 2).when(days <= 60, 1).otherwise(0)


def event_code(event_type: Column) -> Column:
    return F.when(event_type == "sports", 1).when(event_type == "theater", 2).when(event_type == "comedy", 3).otherwise(0)


def count_of(text: Column) -> Column:
    """`1.5M subscribers`, `1,234 views` to a number; 0 if there is none."""
    t = strip(F.regexp_replace(F.regexp_replace(F.lower(text), "subscribers?|views?", ""), ",", ""))
    scale = F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).when(t.endswith("b"), 1e9).otherwise(1.0)
    number = F.regexp_replace(t, "[kmb]$", "").try_cast("double")
    return F.coalesce((number * scale).cast("long"), F.lit(0).cast("long"))


def log_share(value: Column, most: float) -> Column:
    """0 to 100 on a logarithmic scale up to `most`."""
    return F.when(value <= 0, 0.0).when(value >= most, 100.0).otherwise(F.log10(value + 1) / F.log10(F.lit(most + 1.0)) * 100)


def popularity_tier(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
