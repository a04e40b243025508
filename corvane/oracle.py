"""The catalogue's queries in plain SQL over the same tables."""

from __future__ import annotations

from corvane.functions import scalars as S
from corvane.operators.serve import CATEGORY, CITY_FACTOR, TYPE_FACTOR, ZONE_PRICE
from corvane.plans.canonical import LISTINGS_SQL, SNAPSHOTS_SQL
from corvane.sources.synthetic import DAYS


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5003::DOUBLE) / 10000"


def r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def words(column: str, of: list[str]) -> str:
    return f"regexp_matches(lower({column}), '{S.any_of(of)}')"


def zone(section: str) -> str:
    name = f"lower(coalesce({section}, ''))"
    number = f"TRY_CAST(nullif(regexp_extract({name}, 'section\\s*([0-9]+)', 1), '') AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{S.any_of(w)}') THEN '{z}'" for z, w in S.ZONE_WORDS.items()) + f" WHEN {number} < 100 THEN 'floor_vip' WHEN {number} < 200 THEN 'lower_tier' WHEN {number} < 500 THEN 'upper_tier' WHEN {number} IS NOT NULL THEN 'balcony' ELSE 'upper_tier' END"


def case(x: str, table: dict, default) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def folded(x: str) -> str:
    return strip(f"lower({x})")


def cents(x: str) -> str:
    return f"CAST(round_even({x} * 100, 0) AS BIGINT)"


def seconds(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1e6)"


def city_name(c: str) -> str:
    return strip(f"regexp_replace({folded(c)}, ',\\s({'|'.join(S.STATES).lower()})\\s*$', '')")


def quoted(items: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def country(c: str) -> str:
    return case(city_name(c), S.FOREIGN_CITIES, "US")


def region(c: str) -> str:
    return f"{country(c)} || ':' || {city_name(c)}"


def city_tier(c: str) -> str:
    return f"CASE WHEN {city_name(c)} IN {quoted(S.FIRST_TIER_CITIES)} THEN 1 WHEN {city_name(c)} IN {quoted(S.SECOND_TIER_CITIES)} THEN 2 ELSE 3 END"


def number_of(x: str, pattern: str = r"\b([0-9]{1,4})\b") -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{pattern}', 1), '') AS INTEGER)"


def letters(r: str) -> str:
    return f"CASE WHEN regexp_matches({r}, '^[A-Z]$') THEN ascii({r}) - 64 WHEN regexp_matches({r}, '^[A-Z]{{2}}$') THEN (ascii({r}) - 65) * 26 + ascii(substr({r}, 2, 1)) - 64 END"


def row_quality(row: str) -> str:
    r = f"upper({strip(row)})"
    n = f"CAST({number_of(r, '([0-9]+)')} AS DOUBLE)"
    return f"CASE WHEN {row} IS NULL OR {r} IN ('', 'GA', 'GENERAL', 'STANDING', 'N/A', '-') THEN 0.5::DOUBLE WHEN ({letters(r)}) IS NOT NULL THEN least(({letters(r)}) * 0.02::DOUBLE, 1.0::DOUBLE) WHEN {n} IS NOT NULL THEN least({n} / 50.0, 1.0::DOUBLE) ELSE 0.5::DOUBLE END"


def row_number(row: str) -> str:
    r = f"upper({strip(row)})"
    return f"CASE WHEN {row} IS NULL OR {r} = '' THEN 10 WHEN {r} IN ('GA', 'GENERAL', 'STANDING') THEN 0 ELSE coalesce({number_of(r, '([0-9]+)')}, {letters(r)}, 10) END"


def row_bucket(row: str) -> str:
    r = f"upper({strip(row)})"
    return f"CASE WHEN {row} IS NULL OR {r} IN ('', 'N/A', '-') THEN 'unknown' WHEN {r} IN ('GA', 'GENERAL', 'STANDING') THEN 'ga' WHEN {row_quality(row)} < 0.2 THEN 'front' WHEN {row_quality(row)} < 0.5 THEN 'mid' ELSE 'back' END"


def seat(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip(x)}, '^\\+?[0-9]+$') THEN CAST(least(CAST(replace({strip(x)}, '+', '') AS DOUBLE), 999) AS INTEGER) ELSE -1 END"


def section_level(s: str) -> str:
    n = number_of(f"lower({s})")
    return f"CASE WHEN {words(s, S.GROUND_LEVEL_WORDS)} THEN 0.0::DOUBLE " + " ".join(f"WHEN {n} BETWEEN {a} AND {b} THEN {v}::DOUBLE" for a, b, v in S.NUMBER_LEVELS) + " " + " ".join(f"WHEN {words(s, w)} THEN {v}::DOUBLE" for w, v in S.WORD_LEVELS) + " ELSE 0.5::DOUBLE END"


def section_number(s: str) -> str:
    n = number_of(f"lower({s})")
    return f"CASE WHEN {n} <= 999 THEN {n} ELSE 0 END"


def section_hash(s: str) -> str:
    return f"CAST(('0x' || right(md5({folded(s)}), 2)) AS INTEGER) % 32"


def word_count(s: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({strip(s)}, '\\s+'), lambda w: w <> '')) AS INTEGER)"


def clip(x: str, a: float, b: float) -> str:
    return f"greatest(least({x}, {b}::DOUBLE), {a}::DOUBLE)"


def smooth(n: str, x: str, m: float, prior: str) -> str:
    return f"(({n}) * ({x}) + ({prior}) * {m}::DOUBLE) / (({n}) + {m}::DOUBLE)"


SKEW = "CASE WHEN count(listing_price) < 3 OR skewness(listing_price) IS NULL OR isnan(skewness(listing_price)) THEN 0.0 ELSE skewness(listing_price) END"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


L = LISTINGS_SQL
TRAIN = "train AS (SELECT * FROM listings WHERE is_train)"
GLOBAL = f"g AS (SELECT avg(listing_price) AS mean, median(listing_price) AS median, stddev_samp(listing_price) AS std, quantile_cont(listing_price, 0.75) - quantile_cont(listing_price, 0.25) AS iqr, {SKEW} AS skew, avg(CASE WHEN listing_price > 200 THEN 1.0::DOUBLE ELSE 0.0 END) AS premium FROM train)"
SQL: dict[str, str] = {}


def listing_sql(columns: str, extra: str = "", tail: str = "", distinct: str = "") -> str:
    return with_(L) + f"SELECT {distinct}{columns} FROM listings {extra} {tail}"


def stats(keys: str, source: str = "train") -> str:
    where = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"SELECT {keys}, count(listing_price) AS n, sum(listing_price) AS total, avg(listing_price) AS mean, median(listing_price) AS median, coalesce(stddev_samp(listing_price), 0.0) AS std FROM {source} WHERE {where} AND listing_price IS NOT NULL GROUP BY {keys}"


# sources

HASH = f"""md5(concat_ws('|', coalesce(event_id, ''), coalesce({folded('section')}, ''), coalesce({folded('"row"')}, ''), coalesce(seat_from, ''), coalesce(seat_to, ''), coalesce({folded('source')}, ''),
 coalesce(CAST({cents('listing_price')} // 100 AS STRING) || '.' || lpad(CAST({cents('listing_price')} % 100 AS STRING), 2, '0'), '')))"""
SQL["s12_listing_hash"] = listing_sql(f"listing_id, {HASH} AS listing_hash")
SQL["s14_dedup_append"] = with_(L, "floored AS (SELECT * REPLACE (floor(listing_price) + 0.0 AS listing_price) FROM listings)", f"hashed AS (SELECT *, {HASH} AS hash FROM floored)", "fresh AS (SELECT hash, min(listing_id) AS listing_id, min(event_id) AS event_id FROM hashed WHERE NOT is_train AND hash NOT IN (SELECT hash FROM hashed WHERE is_train) GROUP BY hash)") + "SELECT event_id, count(*) AS n_new, min(listing_id) AS first_id FROM fresh GROUP BY event_id"
EVENTS = "ev AS (SELECT event_id, min(event_type) AS event_type, min(event_datetime) AS event_datetime, min(artist_or_team) AS artist_or_team, min(venue_name) AS venue_name, min(city) AS city FROM listings GROUP BY event_id)"
SQL["s07_events_filter"] = with_(L, EVENTS) + "SELECT event_id, event_type, event_datetime, city FROM ev WHERE event_type = 'sports' AND event_datetime BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '1999-06-01'"
SQL["s11_latest_snapshot"] = with_(SNAPSHOTS_SQL) + "SELECT event_id, seat_zone, timestamp, price_avg, CAST(inventory_remaining AS DOUBLE) AS inventory_remaining FROM snapshots QUALIFY row_number() OVER (PARTITION BY event_id, seat_zone ORDER BY timestamp DESC, seq) = 1"
SQL["s15_listings_filter"] = listing_sql("listing_id, event_id, listing_price, timestamp", "WHERE listing_price BETWEEN 100 AND 110")
SQL["s17_latest_listings"] = listing_sql("listing_id, timestamp", "", "ORDER BY timestamp DESC, listing_id LIMIT 100")
SQL["s21_summary"] = listing_sql(f"count(*) AS n_listings, count(DISTINCT event_id) AS n_events, count(DISTINCT artist_or_team) AS n_artists, min(listing_price) AS min_price, max(listing_price) AS max_price, {r4('avg(listing_price)')} AS avg_price")
SQL["s26_event_payloads"] = """SELECT 'd' || p_partkey AS event_id, CASE WHEN p_partkey % 6 = 0 THEN 'concert' WHEN p_partkey % 4 = 0 THEN 'sports' WHEN p_partkey % 4 = 1 THEN 'theater' ELSE 'concert' END AS event_type,
 CAST(DATE '1998-01-01' + CAST(p_partkey % 500 AS INTEGER) AS TIMESTAMP) + CASE WHEN p_partkey % 3 = 0 THEN INTERVAL '19 hours 30 minutes' ELSE INTERVAL '0 hours' END AS event_datetime, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS artist_or_team,
 CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE 'v' || p_size END AS venue_id, CASE WHEN p_partkey % 7 = 0 THEN 'Unknown Venue' ELSE p_type END AS venue_name, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'Unknown' ELSE p_brand END AS city, 'US' AS country FROM part"""
SQL["s27_concert_payloads"] = """SELECT * FROM (SELECT 'c' || p_partkey AS event_id, p_brand AS artist_name, DATE '1998-01-01' + CAST(p_partkey % 1400 AS INTEGER) AS event_date, CASE WHEN p_partkey % 4 = 0 THEN 'Unknown Venue' ELSE p_type END AS venue_name, 'Unknown City' AS city, 'US' AS country,
 CASE WHEN p_partkey % 2 = 0 THEN p_name END AS tour_name FROM part WHERE p_partkey % 9 <> 0) WHERE year(event_date) BETWEEN 1999 AND 2000"""
SQL["s28_marketplace_payloads"] = """SELECT 'm' || p_partkey AS event_id, p_partkey || 'a' AS listing_id, p_type AS section, 'B' AS "row", '3' AS seat_from, '4' AS seat_to, p_size AS quantity, p_retailprice AS price_per_ticket, p_retailprice * p_size AS total_price FROM part
 UNION ALL SELECT 'm' || p_partkey, p_partkey || 'b', p_brand, 'GA', NULL, NULL, 1, CAST(p_size * 2 AS DOUBLE), CAST(p_size * 2 AS DOUBLE) FROM part WHERE p_partkey % 5 <> 0"""
FACTOR = "CASE WHEN d > 60 THEN 1.0::DOUBLE WHEN d > 30 THEN 1.0::DOUBLE + 0.2::DOUBLE * (60 - d) / 30 WHEN d > 14 THEN 1.2::DOUBLE + 0.3::DOUBLE * (30 - d) / 16 WHEN d > 7 THEN 1.5::DOUBLE + 0.3::DOUBLE * (14 - d) / 7 ELSE 1.8::DOUBLE + (2.5::DOUBLE - 1.8::DOUBLE) * (7 - d) / 7 END"
SQL["s33_synthetic_prices"] = f"""SELECT 'syn_c' || p_partkey AS event_id, z.zone AS seat_zone, CAST(d AS INTEGER) AS days_to_event, TIMESTAMP '1998-01-01 20:00:00' + to_days(CAST(p_partkey AS INTEGER)) - to_days(CAST(d AS INTEGER)) AS timestamp,
 {r4(f"(p_retailprice + (p_retailprice * 3 - p_retailprice) * z.ratio) * ({FACTOR}) * (1 + p_size / 50 * 0.5::DOUBLE) * 1.0::DOUBLE")} AS price_avg
 FROM part, (VALUES {", ".join(f"('{z}', {r}::DOUBLE)" for z, r in S.SYNTHETIC_ZONE_RATIO.items())}) AS z(zone, ratio), (SELECT unnest({DAYS}) AS d)"""

# projections

FLOOR_DAYS = f"CAST(floor({seconds('event_datetime', 'timestamp')} / 86400) AS BIGINT)"
SQL["p01_listing_projection"] = listing_sql(
    f"""listing_id, CAST(greatest(0, {FLOOR_DAYS}) AS INTEGER) AS days, CASE WHEN face_value > 0 THEN {r2('listing_price / face_value')} END AS markup_ratio,
 CASE WHEN seat_from IS NULL THEN 'Section ' || section || ', Row ' || coalesce("row", '') WHEN seat_to IS NULL OR seat_from = seat_to THEN 'Section ' || section || ', Row ' || coalesce("row", '') || ', Seat ' || seat_from ELSE 'Section ' || section || ', Row ' || coalesce("row", '') || ', Seats ' || seat_from || '-' || seat_to END AS seat_description,
 listing_price * quantity AS total_price"""
)
SQL["p04_price_filter_cap"] = with_(L, "f AS (SELECT * FROM listings WHERE listing_price >= 10)", "c AS (SELECT quantile_cont(listing_price, 0.95) AS cap FROM f)") + f"SELECT artist_or_team, count(*) AS n, {r4('max(least(listing_price, cap))')} AS max_price, {r4('min(least(listing_price, cap))')} AS min_price FROM f, c GROUP BY artist_or_team"
SQL["p05_post_event_filter"] = listing_sql("event_id, count(*) AS n, max(timestamp) AS last_at", "WHERE timestamp < event_datetime", "GROUP BY event_id")
SQL["p06_keyword_filter"] = "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'ring|blue w|bolt')"
SQL["p10_geo_region"] = listing_sql(f"city, {city_name('city')} AS city_name, {country('city')} AS country, {region('city')} AS region_key, {city_tier('city')} AS city_tier, coalesce({case(folded('city'), S.CITY_NICKNAMES, '').replace(chr(39) * 2 + ' END', 'NULL END')}, {folded('city')}) AS nickname_city", distinct="DISTINCT ")
SQL["p13_zone_map"] = listing_sql(f"section, {zone('section')} AS zone, {case('(' + zone('section') + ')', S.ZONE_RATIO, 0.5)}::DOUBLE AS ratio", distinct="DISTINCT ")
SQL["p14_zone_prices"] = f"""WITH b AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS low, CASE WHEN p_retailprice - 1000 <= 0 THEN p_size * 10.0::DOUBLE ELSE p_retailprice - 1000 END AS high FROM part)
 SELECT p_partkey, z.zone AS zone, {r2("least(low, high) + (greatest(low, high) - least(low, high)) * z.ratio")} AS price FROM b, (VALUES {", ".join(f"('{z}', {r}::DOUBLE)" for z, r in S.ZONE_RATIO.items())}) AS z(zone, ratio)"""
SQL["p16_types"] = listing_sql("count(*) AS n, count(CASE WHEN quantity <> 3 THEN listing_price END) AS n_numbers")
SQL["p18_temporal"] = listing_sql(f"listing_id, CAST(hour(timestamp) AS INTEGER) AS hour_of_day, {r2(seconds('event_datetime', 'timestamp') + ' / 86400')} AS days_exact, CASE WHEN isodow(event_datetime) >= 6 THEN 1 ELSE 0 END AS is_weekend")
SQL["p19_zero_variance"] = "SELECT 'constant' AS column_name, CAST(1 AS BIGINT) AS n_distinct UNION ALL SELECT 'nothing', 0"
_MESSAGES = {
    "errors": [("event_id is missing", "event_id IS NULL"), ("price is not positive", "listing_price IS NULL OR listing_price <= 0"), ("section is missing", "section IS NULL"), ("quantity is below 1", "quantity < 1"), ("timestamp is in the future", "timestamp > TIMESTAMP '2000-01-01'")],
    "warnings": [("price is over 10000", "listing_price > 10000"), ("markup is over 10", "listing_price > 10 * face_value"), ("event is past", "event_datetime < TIMESTAMP '2000-01-01'"), ("row is missing", '"row" IS NULL')],
}
VALID = "checked AS (SELECT *, " + ", ".join("concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in rules) + f") AS {name}" for name, rules in _MESSAGES.items()) + " FROM listings)"
SQL["p22_validation"] = with_(L, VALID) + "SELECT errors, warnings, count(*) AS n FROM checked GROUP BY ALL"
SQL["p22_batch_summary"] = with_(L, VALID) + f"SELECT count(*) AS n, count(*) FILTER (errors = '') AS n_valid, count(*) FILTER (errors <> '') AS n_invalid, count(*) FILTER (warnings <> '') AS n_warned, {r4('count(*) FILTER (errors <> ' + chr(39) * 2 + ') / count(*)')} AS error_rate FROM checked"
_EVENT_RULES = {"errors": [("event_id is empty", "event_id IS NULL"), ("venue is empty", "venue_name IS NULL")], "warnings": [("city is empty", "event_type = 'sports' OR city IS NULL OR city = ''"), ("event is past", "event_datetime < TIMESTAMP '2000-01-01'")]}
_TOP = "CASE WHEN seq % 5 = 0 THEN price_min * 0.9 ELSE price_max END"
_SNAPSHOT_RULES = {
    "errors": [("average is below minimum", "price_avg < price_min"), ("maximum is below minimum", f"{_TOP} < price_min"), ("average is above maximum", f"price_avg > {_TOP}"), ("inventory_remaining is negative", "inventory_remaining < 0")],
    "warnings": [("timestamp is in the future", "timestamp > TIMESTAMP '2024-01-16'")],
}


def _counted(rules: dict, rows: str) -> str:
    return "SELECT " + ", ".join("concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in r) + f") AS {name}" for name, r in rules.items()) + f", count(*) AS n FROM {rows} GROUP BY ALL"


_ONE_EVENT = "e AS (SELECT event_id, min(event_type) AS event_type, min(event_datetime) AS event_datetime, min(venue_name) AS venue_name, min(city) AS city FROM listings GROUP BY 1)"
SQL["p22_event_validation"] = with_(L, _ONE_EVENT) + _counted(_EVENT_RULES, "e")
SQL["p22_snapshot_validation"] = with_(SNAPSHOTS_SQL) + _counted(_SNAPSHOT_RULES, "snapshots")
SQL["t05_offending_rows"] = listing_sql("listing_id", 'WHERE "row" IS NULL', "ORDER BY listing_id LIMIT 100")
SQL["s06_event_lookup"] = with_(L, _ONE_EVENT) + "SELECT event_id, event_type, event_datetime, city FROM e WHERE event_id = 'E7'"
SQL["s08_event_ids"] = listing_sql("DISTINCT event_id")
SQL["s18_listing_event_ids"] = listing_sql("DISTINCT event_id")
SQL["s20_load_snapshots"] = with_(SNAPSHOTS_SQL) + "SELECT event_id, seat_zone, timestamp, price_min, price_avg, price_max, CAST(inventory_remaining AS DOUBLE) AS inventory_remaining FROM snapshots"
SQL["f19_title_artist"] = "SELECT p_partkey, split_part(p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' live' ELSE ' at ' END || p_name, ' at ', 1) AS artist FROM part"
SQL["k13_gate_auc"] = listing_sql(r4('0.5 + (avg(CAST("row" IS NULL AS DOUBLE)) FILTER (is_train) - avg(CAST("row" IS NULL AS DOUBLE)) FILTER (NOT is_train)) / 2') + " AS auc")
SQL["p23_null_rates"] = with_(L) + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS n_null, {r4(f'(count(*) - count({chr(34)}{c}{chr(34)})) / count(*)')} AS null_rate FROM listings" for c in ("event_id", "row", "seat_from", "face_value", "days_to_event"))
SQL["p24_referential"] = with_(L, EVENTS) + "SELECT count(*) FILTER (section IS NULL OR section = '') AS empty_sections, CAST(0 AS BIGINT) AS invalid_zones, count(*) FILTER (event_id NOT IN (SELECT event_id FROM ev WHERE event_type <> 'sports')) AS orphans FROM listings"
SQL["p25_temporal_validation"] = listing_sql(f"count(*) FILTER (timestamp > TIMESTAMP '2000-01-01') AS future_times, count(*) FILTER (event_datetime < TIMESTAMP '2000-01-01') AS past_events, count(*) FILTER (abs({FLOOR_DAYS} - days_to_event) >= 2) AS days_off")

# joins

SQL["j01_dimension"] = with_(L) + "SELECT venue_name, count(*) AS n, count(s_name) AS n_matched, max(s_acctbal) AS balance FROM listings LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) ON venue_name = s_name GROUP BY venue_name"
ASOF = "SELECT p.seq, p.event_id, p.seat_zone, p.timestamp, q.price_min, q.price_avg, q.price_max, q.inventory_remaining, q.timestamp AS matched_at FROM (SELECT * FROM snapshots WHERE kind = 'view') p ASOF LEFT JOIN (SELECT * FROM snapshots WHERE kind {kind}) q ON p.event_id = q.event_id AND p.seat_zone = q.seat_zone AND p.timestamp >= q.timestamp"
SQL["j02_asof_snapshot"] = with_(SNAPSHOTS_SQL, "a AS (" + ASOF.format(kind="= 'purchase'") + ")") + "SELECT seq, event_id, seat_zone, price_min AS quote_price_min, CAST(inventory_remaining AS DOUBLE) AS quote_inventory_remaining, matched_at FROM a"
SNAP = with_(
    SNAPSHOTS_SQL, "a AS (" + ASOF.format(kind="<> 'view'") + ")",
    "st AS (SELECT event_id, seat_zone, count(*) AS n, min(timestamp) AS t0, arg_min(inventory_remaining, timestamp) FILTER (inventory_remaining IS NOT NULL) AS inv0, arg_min(price_avg, timestamp) FILTER (price_avg IS NOT NULL) AS avg0, arg_min(price_min, timestamp) FILTER (price_min IS NOT NULL) AS min0 FROM snapshots WHERE kind <> 'view' GROUP BY event_id, seat_zone)",
    f"""sf AS (SELECT seq, matched_at IS NOT NULL AS hit, coalesce((inventory_remaining - inv0) / greatest({seconds('matched_at', 't0')} / 3600, 1.0), 0) AS inv_rate, (coalesce(price_avg, price_min, 0) - coalesce(avg0, min0, 0)) / greatest(coalesce(avg0, min0, 0), 1) AS trend, ln(1 + n) AS log_count,
 (coalesce(price_max, price_avg, 0) - coalesce(price_min, 0)) / greatest(coalesce(price_avg, 0), 1) AS price_range FROM a LEFT JOIN st USING (event_id, seat_zone))""",
    "s4 AS (SELECT seq, " + ", ".join(f"CASE WHEN hit THEN {c} ELSE 0.0 END AS {c}" for c in ("inv_rate", "trend", "log_count", "price_range")) + " FROM sf)",
)
SQL["j02_snapshot_features"] = SNAP + "SELECT seq, " + ", ".join(f"{r4(c)} AS {c}" for c in ("inv_rate", "trend", "log_count", "price_range")) + " FROM s4"
SQL["j06_known_events"] = with_(L) + "SELECT artist_or_team, count(*) AS n FROM listings WHERE NOT is_train AND event_id IN (SELECT event_id FROM listings WHERE is_train AND artist_or_team < 'Brand#2') GROUP BY artist_or_team"
SQL["j07_unseen"] = with_(L) + "SELECT event_id, count(*) AS n FROM listings WHERE NOT is_train AND event_id NOT IN (SELECT event_id FROM listings WHERE is_train AND listing_price > 900) GROUP BY event_id"
SQL["j12_outer_keys"] = with_(L, "a AS (SELECT artist_or_team, count(face_value) AS n FROM listings WHERE is_train AND artist_or_team < 'Brand#20' GROUP BY 1)", "b AS (SELECT artist_or_team, count(face_value) AS n FROM listings WHERE NOT is_train AND artist_or_team > 'Brand#12' GROUP BY 1)", "j AS (SELECT artist_or_team, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS baseline FROM a FULL JOIN b USING (artist_or_team))") + "SELECT *, CASE WHEN now - baseline > 5 THEN 'improved' WHEN baseline - now > 5 THEN 'degraded' ELSE 'stable' END AS trend FROM j"

# aggregations

SQL["a01_group_stats"] = with_(L, "s AS (" + stats("event_id", "listings") + ")") + f"SELECT event_id, n, median, {r4('mean')} AS mean, {r4('std')} AS std FROM s"
SQL["a05_distribution"] = listing_sql(f"artist_or_team, {r4('quantile_cont(listing_price, 0.02)')} AS p2, {r4('quantile_cont(listing_price, 0.95)')} AS p95, {r4('quantile_cont(listing_price, 0.75) - quantile_cont(listing_price, 0.25)')} AS iqr, {r4(clip(SKEW, -3.0, 3.0))} AS skew", "", "GROUP BY artist_or_team")
SQL["a09_zone_snapshots"] = with_(L, f"z AS (SELECT *, {zone('section')} AS seat_zone FROM listings)") + f"SELECT event_id, seat_zone, timestamp, min(listing_price) AS price_min, {r4('avg(listing_price)')} AS price_avg, max(listing_price) AS price_max, CAST(sum(quantity) AS BIGINT) AS inventory_remaining FROM z GROUP BY event_id, seat_zone, timestamp"
SQL["a16_listing_stability"] = with_(SNAPSHOTS_SQL, "p AS (SELECT event_id || '-' || kind AS id, count(DISTINCT timestamp) AS times FROM snapshots GROUP BY 1)") + f"SELECT count(*) AS n_ids, count(*) FILTER (times >= 2) AS n_stable, {r4('count(*) FILTER (times >= 2) / count(*)')} AS stability FROM p"
COUNTS = "counts AS (SELECT p_brand AS artist, max(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 10000 END) AS youtube_subscribers, max(CASE WHEN p_size < 48 THEN p_partkey * 1000000 END) AS youtube_views, min(CASE WHEN p_size > 3 THEN p_partkey * 1000 END) AS lastfm_listeners, max(p_size * 100000) AS lastfm_play_count FROM part WHERE p_brand <> 'Brand#3' GROUP BY p_brand)"


def share(c: str, most: float) -> str:
    return f"CASE WHEN {c} <= 0 THEN 0.0::DOUBLE WHEN {c} >= {most} THEN 100.0 ELSE log10(CAST({c} AS DOUBLE) + 1) / log10({most} + 1.0::DOUBLE) * 100 END"


_W = {"youtube_subscribers": (0.30, "1e8"), "youtube_views": (0.20, "1e10"), "lastfm_listeners": (0.30, "5e7"), "lastfm_play_count": (0.20, "5e8")}
_TOTAL = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0 END" for c, (w, _) in _W.items())
_PARTS = " + ".join(f"coalesce(({share(c, m)}) * {w}::DOUBLE, 0.0)" for c, (w, m) in _W.items())
SCORED = COUNTS + f", sc0 AS (SELECT *, CASE WHEN {_TOTAL} = 0 THEN 0.0::DOUBLE ELSE greatest(least(({_PARTS}) / ({_TOTAL}), 100.0), 0.0) END AS score FROM counts), scored AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS tier FROM sc0)"
SQL["a19_popularity_scores"] = with_(SCORED) + f"SELECT artist, {r4('score')} AS score, tier FROM scored"

# windows

SQL["w05_dedup_6h"] = with_(
    SNAPSHOTS_SQL, "o AS (SELECT seq, event_id, kind, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY event_id, kind ORDER BY timestamp, seq) AS r FROM snapshots)"
).replace("WITH ", "WITH RECURSIVE ", 1) + ", f AS (SELECT seq, event_id, kind, r, t AS anchor, false AS dup FROM o WHERE r = 1 UNION ALL SELECT o.seq, o.event_id, o.kind, o.r, CASE WHEN o.t - f.anchor < 21600000000 THEN f.anchor ELSE o.t END, o.t - f.anchor < 21600000000 FROM f JOIN o ON o.event_id = f.event_id AND o.kind = f.kind AND o.r = f.r + 1) SELECT seq, dup AS is_duplicate FROM f"
SQL["w08_rank_by_value"] = with_(L, TRAIN, "s AS (" + stats("event_id") + ")") + f"SELECT listing_id, event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY s.median / listing_price DESC, listing_id) AS INTEGER) AS rank, {r4('s.median / listing_price')} AS value_score, {r4('s.median - listing_price')} AS savings_estimate FROM listings JOIN s USING (event_id) WHERE listing_price > 0"
SQL["w09_coverage_cut"] = "WITH c AS (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS score FROM customer GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(sum(score) OVER (ORDER BY score DESC, c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(score) OVER () AS total FROM c WINDOW w AS (ORDER BY score DESC, c_nationkey)) SELECT c_nationkey, score, rank FROM r WHERE before < 0.8::DOUBLE * total OR rank <= 3"
SQL["w10_stall"] = "WITH l AS (SELECT o_orderkey AS seq, o_orderkey % 3 / 10 AS mae FROM orders ORDER BY seq DESC LIMIT 4), g AS (SELECT lag(mae) OVER (ORDER BY seq) - mae AS gain FROM l) SELECT count(*) AS n_runs, count(*) >= 4 AND count(*) FILTER (gain < 1.0) = 3 AS stalled FROM g"
SQL["w12_round_robin"] = "WITH t AS (SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS INTEGER) AS turn FROM customer) SELECT *, CAST(row_number() OVER (ORDER BY turn, c_mktsegment) AS INTEGER) AS position FROM t"

# scalars

SQL["f02_section_scalars"] = listing_sql(f"section, {section_level('section')} AS level, {section_hash('section')} AS hash, {section_number('section')} AS number, {word_count('section')} AS words", distinct="DISTINCT ")
SQL["f03_rows_and_seats"] = listing_sql(f'"row", seat_from, {row_quality(chr(34) + "row" + chr(34))} AS quality, {row_number(chr(34) + "row" + chr(34))} AS number, {row_bucket(chr(34) + "row" + chr(34))} AS bucket, {seat("seat_from")} AS seat', distinct="DISTINCT ")
SQL["f11_counts"] = "SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN (p_size + 0.5) * 1000000 WHEN 1 THEN CAST(CAST(p_size AS STRING) || CAST(100 + p_size AS STRING) AS BIGINT) WHEN 2 THEN p_size * 1000 ELSE 0 END AS BIGINT) AS count_value FROM part"
SQL["f14_date_parts"] = listing_sql("event_datetime, CAST(isodow(event_datetime) - 1 AS INTEGER) AS dow, CAST(month(event_datetime) AS INTEGER) AS month, CAST(hour(event_datetime) AS INTEGER) AS hour, CAST(isoyear(event_datetime) AS INTEGER) AS iso_year, CAST(weekofyear(event_datetime) AS INTEGER) AS iso_week, CAST(quarter(event_datetime) AS INTEGER) AS quarter, strftime(event_datetime, '%Y-%m') AS period", distinct="DISTINCT ")

# features: r is every listing with its keys


def feature_sql(select: dict[str, str], *parts: str, source: str = "r", key: str = "listing_id", rounded: tuple | None = None) -> str:
    """Rounds what the Spark side gives as doubles."""
    columns = ", ".join(f"{r4(x) if rounded is None or n in rounded else x} AS {n}" for n, x in select.items())
    return with_(L, TRAIN, GLOBAL, *parts) + f"SELECT {key}, {columns} FROM {source}"


A_KEY = folded("artist_or_team")
SQL["x01_performer"] = feature_sql(
    {
        "artist_avg_price": "coalesce(a.mean, g.mean)", "artist_median_price": "coalesce(a.median, g.median)", "artist_price_std": "coalesce(a.std, g.std)", "artist_event_count": "coalesce(a.events, 0)::DOUBLE", "artist_listing_count": "coalesce(a.n, 0)::DOUBLE",
        "artist_premium_ratio": "coalesce(a.premium, g.premium)", "is_known_artist": "CASE WHEN a.n IS NULL THEN 0 ELSE 1 END", "artist_zone_median_price": "coalesce(z.median, a.median, g.median)",
    },
    f"a AS (SELECT {A_KEY} AS k, count(*) AS n, {smooth('count(*)', 'avg(listing_price)', 50, 'any_value(g.mean)')} AS mean, {smooth('count(*)', 'median(listing_price)', 50, 'any_value(g.median)')} AS median, coalesce(stddev_samp(listing_price), 0.0) AS std, count(DISTINCT event_id) AS events, avg(CASE WHEN listing_price > 200 THEN 1.0::DOUBLE ELSE 0.0 END) AS premium FROM train, g GROUP BY 1)",
    f"z0 AS (SELECT {A_KEY} AS k, {zone('section')} AS zone, count(*) AS n, median(listing_price) AS mid FROM train GROUP BY 1, 2)",
    f"z AS (SELECT z0.k, zone, {smooth('z0.n', 'mid', 20, 'a.median')} AS median FROM z0 JOIN a ON a.k = z0.k)",
    f"r AS (SELECT *, {A_KEY} AS k, {zone('section')} AS zone FROM listings)",
    source="r LEFT JOIN a ON a.k = r.k LEFT JOIN z ON z.k = r.k AND z.zone = r.zone, g",
    rounded=("artist_avg_price", "artist_median_price", "artist_price_std", "artist_event_count", "artist_listing_count", "artist_premium_ratio", "artist_zone_median_price"),
)
SQL["x02_event"] = feature_sql(
    {
        "event_type_encoded": "CASE event_type WHEN 'sports' THEN 1 WHEN 'theater' THEN 2 WHEN 'comedy' THEN 3 ELSE 0 END", "city_tier": city_tier("city"), "day_of_week": "CAST(isodow(event_datetime) - 1 AS INTEGER)", "is_weekend": "CASE WHEN isodow(event_datetime) >= 6 THEN 1 ELSE 0 END",
        "month": "CAST(month(event_datetime) AS INTEGER)", "is_summer": "CASE WHEN month(event_datetime) IN (6, 7, 8) THEN 1 ELSE 0 END", "is_holiday_season": "CASE WHEN month(event_datetime) IN (11, 12) THEN 1 ELSE 0 END",
        "venue_capacity_bucket": "CASE WHEN venue_capacity IS NULL THEN 2 WHEN venue_capacity < 5000 THEN 0 WHEN venue_capacity < 15000 THEN 1 WHEN venue_capacity < 40000 THEN 2 ELSE 3 END", "market_saturation": "ln(1 + coalesce(w.n, 0))",
    },
    f"w AS (SELECT {city_name('city')} AS c, isoyear(event_datetime) AS y, weekofyear(event_datetime) AS wk, count(DISTINCT event_id) AS n FROM train GROUP BY 1, 2, 3)",
    source=f"listings r LEFT JOIN w ON w.c = {city_name('r.city')} AND w.y = isoyear(r.event_datetime) AND w.wk = weekofyear(r.event_datetime)", rounded=("market_saturation",),
)
ZONED = f"r AS (SELECT *, {zone('section')} AS zone FROM listings)"
ROW = '"row"'
SQL["x03_seating"] = feature_sql(
    {"seat_zone_encoded": case("zone", S.ZONE_CODE, 1), "zone_price_ratio": f"({case('zone', S.ZONE_RATIO, 0.5)})::DOUBLE", "row_numeric": row_number(ROW), "is_floor": f"CASE WHEN {words('section', ['floor', 'pit', 'field', 'courtside'])} THEN 1 ELSE 0 END", "is_ga": f"CASE WHEN {words('section', ['ga', 'general admission'])} THEN 1 ELSE 0 END", "is_premium": f"CASE WHEN {words('section', S.PREMIUM_WORDS)} AND lower(section) NOT LIKE '%general admission%' THEN 1 ELSE 0 END"},
    ZONED, rounded=("zone_price_ratio",),
)
D = "coalesce(days_to_event, 30)"
URGENCY = f"CASE WHEN {D} <= 1 THEN 5 WHEN {D} <= 7 THEN 4 WHEN {D} <= 14 THEN 3 WHEN {D} <= 30 THEN 2 WHEN {D} <= 60 THEN 1 ELSE 0 END"
SQL["x04_time_series"] = feature_sql({"days_to_event_filled": D, "days_to_event_squared": f"{D} * {D}", "days_to_event_sqrt": f"sqrt({D} + 1)", "urgency_bucket": URGENCY, "is_last_week": f"CASE WHEN {D} <= 7 THEN 1 ELSE 0 END", "is_last_day": f"CASE WHEN {D} <= 1 THEN 1 ELSE 0 END"}, ZONED, rounded=("days_to_event_sqrt",))

PRICING = (
    "es AS (" + stats("event_id") + ")",
    f"e AS (SELECT event_id, n, total, es.mean, es.std, {smooth('n', 'es.median', 20, 'g.median')} AS median FROM es, g)",
    f"ed AS (SELECT event_id, quantile_cont(listing_price, 0.75) - quantile_cont(listing_price, 0.25) AS iqr, {clip(SKEW, -3.0, 3.0)} AS skew FROM train GROUP BY event_id HAVING count(*) >= 3)",
    f"tz AS (SELECT *, {zone('section')} AS zone FROM train)",
    f"ez AS (SELECT tz.event_id, zone, {smooth('count(*)', 'median(listing_price)', 20, 'any_value(e.median)')} AS median, CASE WHEN count(*) >= 5 THEN {clip('(max(listing_price) - min(listing_price)) / greatest(median(listing_price), 1.0)', 0.0, 10.0)} END AS range FROM tz JOIN e USING (event_id) GROUP BY 1, 2)",
    f"esec AS (SELECT tz.event_id, tz.section, {smooth('count(*)', 'median(listing_price)', 20, 'any_value(ez.median)')} AS median FROM tz JOIN ez ON ez.event_id = tz.event_id AND ez.zone = tz.zone GROUP BY 1, 2)",
    "ars AS (" + stats("artist_or_team") + ")",
    f"a AS (SELECT artist_or_team, n, ars.mean, ars.std, {smooth('n', 'ars.median', 20, 'g.median')} AS median FROM ars, g)",
    f"az AS (SELECT tz.artist_or_team, zone, {smooth('count(*)', 'median(listing_price)', 20, 'any_value(a.median)')} AS median FROM tz JOIN a USING (artist_or_team) GROUP BY 1, 2)",
    f"mem AS (SELECT DISTINCT event_id, {cents('listing_price')} AS cents FROM train)",
    f"r AS (SELECT *, {zone('section')} AS zone, {cents('listing_price')} AS cents FROM listings)",
)
JOINED = "r LEFT JOIN e ON e.event_id = r.event_id LEFT JOIN ed ON ed.event_id = r.event_id LEFT JOIN ez ON ez.event_id = r.event_id AND ez.zone = r.zone LEFT JOIN esec ON esec.event_id = r.event_id AND esec.section = r.section LEFT JOIN a ON a.artist_or_team = r.artist_or_team LEFT JOIN az ON az.artist_or_team = r.artist_or_team AND az.zone = r.zone"
PRICED = f"""p AS (SELECT r.listing_id, CASE WHEN mem.cents IS NOT NULL THEN CASE WHEN e.n > 1 THEN {smooth('e.n - 1', '(e.total - r.listing_price) / (e.n - 1)', 20, 'g.mean')} ELSE g.mean END ELSE coalesce(e.median, a.median, g.median) END AS ev,
 coalesce(e.mean, a.mean, g.mean) AS mean, coalesce(e.std, a.std, g.std) AS std, coalesce(e.n, a.n, 1) AS n, ez.median AS ez, az.median AS az, esec.median AS sec, coalesce(ed.iqr, g.iqr) AS iqr, coalesce(ed.skew, g.skew) AS skew, coalesce(ez.range, 0.5) AS range
 FROM {JOINED} LEFT JOIN mem ON mem.event_id = r.event_id AND mem.cents = r.cents, g)"""
SQL["x05_event_pricing"] = feature_sql(
    {
        "event_median_price": "ev", "event_zone_median_price": "coalesce(ez, az, ev)", "event_listing_count": "ln(1 + n)", "event_price_cv": f"CASE WHEN mean > 0 THEN {clip('std / mean', 0.0, 3.0)} ELSE 0.0 END", "event_zone_price_ratio": f"CASE WHEN ev > 0 THEN {clip('coalesce(ez, az, ev) / ev', 0.1, 10.0)} ELSE 1.0 END",
        "event_section_median_price": "coalesce(sec, ez, az, ev)", "event_price_iqr": "iqr", "event_price_skewness": "skew", "zone_price_range_ratio": "range",
    },
    *PRICING, PRICED, source="p",
)
RELATIVE = f"q AS (SELECT r.listing_id, coalesce(a.median, g.median) AS ar, coalesce(e.median, a.median, g.median) AS ev, coalesce(ez.median, e.median, a.median, g.median) AS ez, coalesce(esec.median, ez.median, e.median, a.median, g.median) AS es FROM {JOINED}, g)"
SQL["x06_relative_pricing"] = feature_sql({"section_price_deviation": "CASE WHEN ez > 0 THEN (es - ez) / ez ELSE 0.0 END", "zone_price_deviation": "CASE WHEN ev > 0 THEN (ez - ev) / ev ELSE 0.0 END", "section_zone_residual": "es - ez", "zone_event_residual": "ez - ev", "event_artist_residual": "ev - ar"}, *PRICING, RELATIVE, source="q")

COLD = {"arq": (75, [["k_a", "k_r", "k_q"], ["k_a", "k_r"], ["k_a"]]), "vdow": (100, [["k_v", "k_d"], ["k_v"]]), "sz": (50, [["k_h", "k_z"], ["k_z"]])}
_keys = f"SELECT *, coalesce(artist_or_team, '') AS k_a, {region('city')} AS k_r, year(event_datetime) || 'Q' || quarter(event_datetime) AS k_q, coalesce(venue_name, '') AS k_v, isodow(event_datetime) - 1 AS k_d, {section_hash('section')} AS k_h, 'unknown' AS k_z, {cents('listing_price')} AS cents FROM listings"
_parts, _joins, _mean, _support = [f"kd AS ({_keys})", "kt AS (SELECT * FROM kd WHERE is_train)", "gl AS (SELECT avg(ln(1 + listing_price)) AS g FROM kt)", "mem AS (SELECT DISTINCT event_id, cents FROM kt)"], "", {}, {}
for _c, (_m, _levels) in COLD.items():
    _steps = "gl.g"
    for _i, _k in reversed(list(enumerate(_levels))):
        _ks = ", ".join(_k)
        _on = " AND ".join(f"{{t}}.{x} = r.{x}" for x in _k)
        _parts += [f"p_{_c}{_i} AS (SELECT {_ks}, event_id, count(*) AS n, sum(ln(1 + coalesce(listing_price, 0))) AS s FROM kt GROUP BY {_ks}, event_id)", f"g_{_c}{_i} AS (SELECT {_ks}, sum(n) AS n, sum(s) AS s FROM p_{_c}{_i} GROUP BY {_ks})"]
        _joins += f" LEFT JOIN g_{_c}{_i} ON {_on.format(t=f'g_{_c}{_i}')} LEFT JOIN p_{_c}{_i} ON {_on.format(t=f'p_{_c}{_i}')} AND p_{_c}{_i}.event_id = r.event_id"
        _out = lambda x, c=_c, i=_i: f"CASE WHEN mem.cents IS NOT NULL THEN coalesce(p_{c}{i}.{x}, 0) ELSE 0 END"
        _n, _s = f"(coalesce(g_{_c}{_i}.n, 0) - {_out('n')})", f"(g_{_c}{_i}.s - {_out('s')})"
        _steps = f"CASE WHEN {_n} > 0 THEN ({_s} + {_m} * gl.g) / ({_n} + {_m}) ELSE {_steps} END"
    _mean[f"coldstart_{_c}_logmean"], _support[f"coldstart_{_c}_support"] = _steps, f"coalesce(g_{_c}0.n, 0)::DOUBLE"
SQL["x07_cold_start"] = feature_sql(_mean | _support, *_parts, source=f"kd r LEFT JOIN mem ON mem.event_id = r.event_id AND mem.cents = r.cents{_joins}, gl", key="r.listing_id")


def within(rows: str, before: str) -> str:
    """History as lists per event and per event and section; `before` compares a history time h.t with the row's."""
    recent = "list_median(list_slice(px, greatest(k - 4, 1), k))"
    return feature_sql(
        {
            "we_pos_in_sequence": "k::DOUBLE", "we_time_since_first_hours": "CASE WHEN k > 0 THEN (t - first) / 3.6e9 ELSE 0.0 END", "we_age_percentile": "k / greatest(size, 1)", "we_rolling5_dev": f"CASE WHEN k >= 5 AND {recent} > 0 AND price > 0 THEN ln(price / {recent}) ELSE 0.0 END",
            "we_zone_price_at_t": "CASE WHEN len(zpx) > 0 AND list_median(zpx) > 0 THEN ln(price / list_median(zpx)) ELSE 0.0 END", "we_history_support": "size::DOUBLE",
        },
        "h AS (SELECT event_id, list({'t': epoch_us(timestamp), 'p': listing_price} ORDER BY epoch_us(timestamp), listing_price) AS xs, min(epoch_us(timestamp)) AS first FROM train GROUP BY event_id)",
        "hz AS (SELECT event_id, section, list({'t': epoch_us(timestamp), 'p': listing_price}) AS xs FROM train GROUP BY event_id, section)",
        f"w AS (SELECT r.listing_id, r.listing_price AS price, epoch_us(r.timestamp) AS t, h.first, coalesce(len(h.xs), 0) AS size, list_transform(h.xs, lambda x: x.p) AS px, coalesce(len(list_filter(h.xs, lambda x: x.t {before} epoch_us(r.timestamp))), 0) AS k, list_transform(list_filter(hz.xs, lambda x: x.t {before} epoch_us(r.timestamp)), lambda x: x.p) AS zpx FROM {rows} r LEFT JOIN h ON h.event_id = r.event_id LEFT JOIN hz ON hz.event_id = r.event_id AND hz.section = r.section)",
        source="w",
    )


SQL["x08_within_event"] = within("listings", "<=")
SQL["x08_within_event_train"] = within("train", "<")
SQL["x09_section"] = feature_sql(
    {
        "section_number": section_number("r.section"), "section_level": section_level("r.section"), "row_quality": row_quality(ROW), "is_named_section": f"CASE WHEN {words('r.section', S.NAMED_WORDS)} OR NOT regexp_matches(r.section, '[0-9]') THEN 1 ELSE 0 END",
        **{n: f"CASE WHEN {words('r.section', w)} THEN 1 ELSE 0 END" for n, w in (("sec_is_ga", S.GA_WORDS), ("sec_is_vip", S.VIP_WORDS), ("sec_is_floor", S.FLOOR_WORDS), ("is_obstructed", S.OBSTRUCTED_WORDS))}, "section_name_hash": section_hash("r.section"),
        "has_row_info": f"CASE WHEN {ROW} IS NOT NULL AND {strip(ROW)} <> '' THEN 1 ELSE 0 END", "section_word_count": word_count("r.section"), "venue_section_count": "coalesce(v.n, 0.0)",
    },
    "v AS (SELECT venue_name, ln(1 + count(DISTINCT section)) AS n FROM train GROUP BY 1)", source="listings r LEFT JOIN v ON v.venue_name = r.venue_name", rounded=("section_level", "row_quality", "venue_section_count"),
)


def structural(is_train: bool) -> str:
    own = f"CASE WHEN mem.cents IS NOT NULL THEN CASE WHEN q.n = 1 THEN prior ELSE {smooth('q.n - 1', '(q.total - listing_price) / (q.n - 1)', 8, 'prior')} END ELSE {smooth('q.n', 'q.mean', 8, 'prior')} END" if is_train else smooth("q.n", "q.mean", 8, "prior")
    s, t = seat("seat_from"), seat("seat_to")
    return feature_sql(
        {
            "seat_number": "CASE WHEN s = -1 THEN 0 ELSE s END", "seat_span": "CASE WHEN s <> -1 AND t <> -1 THEN greatest(least(t - s + 1, 50), 1) ELSE 1 END", "is_low_seat_number": "CASE WHEN s <> -1 AND s <= 5 THEN 1 ELSE 0 END", "is_unknown_seat": "CASE WHEN s = -1 THEN 1 ELSE 0 END",
            "row_bucket_encoded": case("bucket", S.BUCKET_CODE, 4), "event_section_row_median_price": "value", "event_section_row_listing_count": "ln(1 + coalesce(n, 0))", "row_bucket_section_count": "coalesce(sections, 0)::DOUBLE",
        },
        "es AS (" + stats("event_id") + ")", "ss AS (" + stats("event_id, section") + ")", f"pr AS (SELECT ss.event_id, ss.section, {smooth('ss.n', 'ss.mean', 20, 'es.mean')} AS prior FROM ss JOIN es ON es.event_id = ss.event_id)",
        f"tb AS (SELECT *, {row_bucket(ROW)} AS bucket FROM train)", "q AS (SELECT event_id, section, bucket, count(*) AS n, sum(listing_price) AS total, avg(listing_price) AS mean FROM tb GROUP BY 1, 2, 3)",
        f"mem AS (SELECT DISTINCT event_id, section, bucket, {cents('listing_price')} AS cents FROM tb)", "sp AS (SELECT event_id, bucket, least(count(DISTINCT section), 50) AS sections FROM tb GROUP BY 1, 2)",
        f"b AS (SELECT *, {row_bucket(ROW)} AS bucket, {cents('listing_price')} AS cents, {s} AS s, {t} AS t FROM {'train' if is_train else 'listings'})",
        f"j AS (SELECT b.listing_id, b.s, b.t, b.bucket, q.n, sp.sections, coalesce(pr.prior, es.mean, g.mean) AS prior, CASE WHEN q.n IS NULL THEN coalesce(pr.prior, es.mean, g.mean) ELSE {own.replace('prior', 'coalesce(pr.prior, es.mean, g.mean)').replace('listing_price', 'b.listing_price')} END AS value FROM b LEFT JOIN es ON es.event_id = b.event_id LEFT JOIN pr ON pr.event_id = b.event_id AND pr.section = b.section LEFT JOIN q ON q.event_id = b.event_id AND q.section = b.section AND q.bucket = b.bucket LEFT JOIN sp ON sp.event_id = b.event_id AND sp.bucket = b.bucket LEFT JOIN mem ON mem.event_id = b.event_id AND mem.section = b.section AND mem.bucket = b.bucket AND mem.cents = b.cents, g)",
        source="j", rounded=("event_section_row_median_price", "event_section_row_listing_count", "row_bucket_section_count"),
    )


SQL["x10_listing_structural"] = structural(False)
SQL["x10_listing_structural_train"] = structural(True)
SQL["x11_snapshot"] = SNAP + f", m AS (SELECT avg(CASE WHEN seq % 5 <> 0 THEN trend END) AS t FROM s4) SELECT seq, {r4('inv_rate')} AS snapshot_inventory_change_rate, {r4('CASE WHEN seq % 5 <> 0 THEN trend ELSE m.t END')} AS snapshot_zone_price_trend, {r4('log_count')} AS snapshot_count, {r4('price_range')} AS snapshot_price_range FROM s4, m"
_R = f"SELECT *, {A_KEY} AS k, {city_name('city')} AS c, {country('city')} AS cc, {region('city')} AS rk FROM "
SQL["x12_regional"] = feature_sql(
    {
        "artist_regional_avg_price": "coalesce(rg.mean, ct.mean, ar.mean, 150.0)", "artist_regional_median_price": "coalesce(rg.median, ct.median, ar.median, 150.0)", "artist_regional_listing_count": "ln(1 + coalesce(rg.n, ct.n, ar.n, 0))", "regional_price_ratio": "CASE WHEN coalesce(rg.mean, ct.mean, ar.mean) IS NOT NULL AND ar.mean > 0 THEN coalesce(rg.mean, ct.mean, ar.mean) / ar.mean ELSE 1.0 END",
        "artist_country_avg_price": "coalesce(ct.mean, 150.0)", "country_popularity_ratio": "CASE WHEN ct.mean IS NOT NULL AND ar.mean > 0 THEN ct.mean / ar.mean ELSE 1.0 END", "regional_market_strength": "coalesce(mk.n / mx.most, 0.5)",
    },
    f"rt AS ({_R} train)", f"rr AS ({_R} listings)", "ar AS (SELECT k, count(*) AS n, avg(listing_price) AS mean, median(listing_price) AS median FROM rt GROUP BY 1)",
    f"rg AS (SELECT rt.k, rk, count(*) AS n, {smooth('count(*)', 'avg(listing_price)', 75, 'any_value(ar.mean)')} AS mean, {smooth('count(*)', 'median(listing_price)', 75, 'any_value(ar.median)')} AS median FROM rt JOIN ar USING (k) GROUP BY 1, 2)",
    f"ct AS (SELECT k, cc, count(*) AS n, {smooth('count(*)', 'avg(listing_price)', 75, 'any_value(g.mean)')} AS mean, {smooth('count(*)', 'median(listing_price)', 75, 'any_value(g.median)')} AS median FROM rt, g GROUP BY 1, 2)",
    "mk AS (SELECT c, count(DISTINCT artist_or_team) AS n FROM rt GROUP BY 1)", "mx AS (SELECT max(n) AS most FROM mk)",
    source="rr r LEFT JOIN ar ON ar.k = r.k LEFT JOIN rg ON rg.k = r.k AND rg.rk = r.rk LEFT JOIN ct ON ct.k = r.k AND ct.cc = r.cc LEFT JOIN mk ON mk.c = r.c, mx",
)
SQL["x13_popularity"] = feature_sql(
    {"popularity_score": "coalesce(score, 0.0)", "popularity_tier_encoded": "CASE tier WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END", **{f"{c}_log": f"CASE WHEN {c} > 0 THEN log10(CAST({c} AS DOUBLE)) ELSE 0.0 END" for c in ("youtube_subscribers", "youtube_views", "lastfm_listeners", "lastfm_play_count")}, "popularity_data_available": "CASE WHEN score IS NULL THEN 0 ELSE 1 END"},
    SCORED, source=f"listings r LEFT JOIN scored ON {folded('scored.artist')} = {folded('r.artist_or_team')}", rounded=("popularity_score", "youtube_subscribers_log", "youtube_views_log", "lastfm_listeners_log", "lastfm_play_count_log"),
)
SQL["x14_listing_context"] = listing_sql("listing_id, CASE WHEN source = 'stubhub' THEN 1 ELSE 0 END AS source_encoded, quantity AS quantity_filled, CASE WHEN quantity = 1 THEN 1 ELSE 0 END AS is_single_ticket, CASE WHEN quantity = 2 THEN 1 ELSE 0 END AS is_pair")
V_KEY = folded("venue_name")
VENUE = f"v AS (SELECT {V_KEY} AS k, {smooth('count(*)', 'avg(listing_price)', 75, 'any_value(g.mean)')} AS mean, {smooth('count(*)', 'median(listing_price)', 75, 'any_value(g.median)')} AS median, {smooth('count(*)', 'coalesce(stddev_samp(listing_price), any_value(g.std))', 75, 'any_value(g.std)')} AS std FROM train, g GROUP BY 1)"
SQL["x15_venue"] = feature_sql({"venue_avg_price": "coalesce(v.mean, g.mean)", "venue_median_price": "coalesce(v.median, g.median)", "venue_price_std": "coalesce(v.std, g.std)", "is_known_venue": "CASE WHEN v.mean IS NULL THEN 0.0 ELSE 1.0 END"}, VENUE, source=f"listings r LEFT JOIN v ON v.k = {folded('r.venue_name')}, g")
_RATIO = f"({case('(' + zone('r.section') + ')', S.ZONE_RATIO, 0.5)})::DOUBLE"
SQL["x16_interaction"] = feature_sql(
    {"artist_zone_price": "avg_price * ratio", "popularity_zone": "0.0::DOUBLE * ratio", "urgency_zone": "urgency * ratio", "artist_city_tier": "avg_price * tier", "days_to_event_log": "ln(1 + greatest(days, 0))", "price_per_urgency": "avg_price / (days + 1)", "artist_venue_price": "avg_price * venue / greatest(mid, 1.0)"},
    f"a AS (SELECT {A_KEY} AS k, {smooth('count(*)', 'avg(listing_price)', 50, 'any_value(g.mean)')} AS mean FROM train, g GROUP BY 1)", VENUE, f"md AS (SELECT median(v.median) AS mid FROM train JOIN v ON v.k = {folded('train.venue_name')})",
    f"x AS (SELECT r.listing_id, coalesce(a.mean, g.mean) AS avg_price, {_RATIO} AS ratio, {URGENCY} AS urgency, {city_tier('r.city')} AS tier, {D} AS days, coalesce(v.median, g.median) AS venue, mid FROM listings r LEFT JOIN a ON a.k = {folded('r.artist_or_team')} LEFT JOIN v ON v.k = {folded('r.venue_name')}, g, md)", source="x",
)
SQL["x17_momentum"] = listing_sql(f"listing_id, {r4('coalesce(face_value, 0.0)')} AS price_momentum_7d, 0.0::DOUBLE AS price_momentum_30d, 1.0::DOUBLE AS price_vs_initial, 0.0::DOUBLE AS price_volatility")

# labels

SQL["l02_absence_label"] = with_(
    SNAPSHOTS_SQL, "d AS (SELECT event_id, event_id || '-' || kind AS listing_id, timestamp FROM snapshots WHERE timestamp < TIMESTAMP '2024-01-29')",
    "sc AS (SELECT DISTINCT event_id, timestamp FROM d)", "lists AS (SELECT event_id, list(timestamp ORDER BY timestamp) AS ts, max(timestamp) AS last, count(*) AS n FROM sc GROUP BY 1)", "seen AS (SELECT listing_id, list(DISTINCT timestamp) AS own FROM d GROUP BY 1)",
    "x AS (SELECT d.listing_id, d.timestamp, list_transform(list_filter(ts, lambda t: t > d.timestamp AND t <= d.timestamp + INTERVAL '72 hours'), lambda t: {'t': t, 'gone': NOT list_contains(own, t)}) AS f FROM d JOIN lists USING (event_id) JOIN seen USING (listing_id) WHERE n >= 5 AND d.timestamp <= last - INTERVAL '72 hours')",
    "y AS (SELECT listing_id, timestamp, list_filter(list_transform(range(1, len(f)), lambda i: CASE WHEN f[i].gone AND f[i + 1].gone THEN f[i].t END), lambda t: t IS NOT NULL) AS hits FROM x)",
) + f"SELECT listing_id, timestamp, CASE WHEN len(hits) > 0 THEN 1 ELSE 0 END AS sold, CASE WHEN len(hits) > 0 THEN {r4(seconds('hits[1]', 'timestamp') + ' / 3600')} END AS hours FROM y"
SQL["l03_depletion_label"] = with_(
    SNAPSHOTS_SQL, "inv AS (SELECT event_id, timestamp, sum(inventory_remaining) AS inventory FROM snapshots WHERE kind <> 'view' AND inventory_remaining IS NOT NULL GROUP BY 1, 2)", "ok AS (SELECT event_id FROM inv GROUP BY 1 HAVING count(*) >= 5)", "i AS (SELECT * FROM inv WHERE event_id IN (SELECT event_id FROM ok))",
    "pr AS (SELECT seq, event_id, timestamp, timestamp + INTERVAL '48 hours' AS later FROM snapshots WHERE kind = 'view' AND timestamp < TIMESTAMP '2024-01-29')", "a AS (SELECT pr.seq, pr.event_id, pr.later, i.inventory AS a FROM pr ASOF JOIN i ON pr.event_id = i.event_id AND pr.timestamp >= i.timestamp)",
    "b AS (SELECT a.seq, a.a, i.inventory AS b FROM a ASOF JOIN i ON a.event_id = i.event_id AND a.later >= i.timestamp)", "c AS (SELECT seq, CASE WHEN a <= 0 THEN 0.0 ELSE (a - b) / a END AS depletion FROM b)",
) + f"SELECT seq, {r4('depletion')} AS depletion, CASE WHEN depletion > 0.3 THEN 1 ELSE 0 END AS sold FROM c"
SQL["l04_sale_features"] = with_(L, TRAIN, "s AS (SELECT event_id, median(listing_price) AS mid, stddev_samp(listing_price) AS std FROM train GROUP BY 1)") + f"SELECT listing_id, {r4('CASE WHEN std > 0 THEN (listing_price - mid) / std ELSE 0.0 END')} AS price_z, {r4('CASE WHEN mid > 0 THEN listing_price / mid ELSE 1.0 END')} AS price_to_median, {r4('CASE WHEN face_value > 0 THEN listing_price / face_value ELSE 1.0 END')} AS price_to_predicted FROM listings LEFT JOIN s USING (event_id) WHERE NOT is_train"

# splits, weights, targets

SQL["k01_temporal_split"] = with_(L, "o AS (SELECT listing_id, row_number() OVER (ORDER BY event_datetime, listing_id) AS r, count(*) OVER () AS n FROM listings)") + "SELECT listing_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o"
SQL["k02_stratified_split"] = with_(L, "o AS (SELECT listing_id, row_number() OVER (PARTITION BY artist_or_team ORDER BY event_datetime, listing_id) AS r, count(*) OVER (PARTITION BY artist_or_team) AS n FROM listings)", "c AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS a FROM o)") + "SELECT listing_id, CASE WHEN n < 10 OR r <= a THEN 'train' WHEN r <= greatest(a + 1, floor(n * (0.7::DOUBLE + 0.15::DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM c"
SQL["k03_group_folds"] = with_(L, "f AS (SELECT event_id, min(event_datetime) AS t FROM listings GROUP BY 1)", "o AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n FROM f)", "k AS (SELECT event_id, i, greatest(1, n // 6) AS z, n, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS fold FROM o)") + "SELECT event_id, fold, CASE WHEN i < fold * z THEN 'train' WHEN i < fold * z + z THEN 'val' ELSE 'test' END AS part FROM k WHERE (fold + 1) * z < n AND i < fold * z + 2 * z"
SQL["k05_contiguous_folds"] = with_(L, "f AS (SELECT DISTINCT event_id FROM listings)", "o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM f)") + "SELECT event_id, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE (n % 5) + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM o"
SQL["k07_winsorise"] = with_(L, f"z AS (SELECT *, {zone('section')} AS zone FROM listings)", "q AS (SELECT quantile_cont(listing_price, 0.05) AS ga, quantile_cont(listing_price, 0.95) AS gb FROM z)", "b AS (SELECT zone, count(*) AS n, quantile_cont(listing_price, 0.02) AS a, quantile_cont(listing_price, 0.98) AS b FROM z GROUP BY 1)") + f"SELECT listing_id, {r4('least(greatest(listing_price, CASE WHEN n >= 20 THEN a ELSE ga END), CASE WHEN n >= 20 THEN b ELSE gb END)')} AS listing_price FROM z JOIN b USING (zone), q"
SQL["k08_outliers"] = with_(L, "q AS (SELECT quantile_cont(listing_price, 0.25) AS a, quantile_cont(listing_price, 0.75) AS b FROM listings)") + "SELECT CASE WHEN listing_price < 1 THEN 'below_min' WHEN listing_price > 50000 THEN 'above_max' WHEN listing_price < a - 1.5::DOUBLE * (b - a) THEN 'iqr_low' WHEN listing_price > b + 1.5::DOUBLE * (b - a) THEN 'iqr_high' ELSE 'none' END AS reason, count(*) AS n FROM listings, q GROUP BY 1"
SQL["k10_impute"] = listing_sql("listing_id, coalesce(CAST(venue_capacity AS DOUBLE), median(venue_capacity) OVER (PARTITION BY city), 15000.0) AS venue_capacity, venue_capacity IS NULL AS capacity_imputed, coalesce(face_value, listing_price * 0.5::DOUBLE) AS face_value, face_value IS NULL AS face_value_imputed")
_RAW = {
    "inverse_artist_freq": "1.0::DOUBLE / count(*) OVER (PARTITION BY artist_or_team)", "sqrt_price": "sqrt(listing_price)", "log_price": "ln(1 + listing_price)",
    "inverse_price_quartile": "least(max(qn) OVER () / qn, 4.0::DOUBLE)", "low_count_upweight": "CASE WHEN an < amid THEN 2.0::DOUBLE ELSE 1.0 END",
}
_Q = "q AS (SELECT quantile_cont(listing_price, 0.25) AS q1, quantile_cont(listing_price, 0.5) AS q2, quantile_cont(listing_price, 0.75) AS q3 FROM train), t1 AS (SELECT *, CASE WHEN listing_price <= q1 THEN 1 WHEN listing_price <= q2 THEN 2 WHEN listing_price <= q3 THEN 3 ELSE 4 END AS qt FROM train, q), t2 AS (SELECT *, count(*) OVER (PARTITION BY qt) AS qn FROM t1)"
_A = "ac AS (SELECT artist_or_team, count(DISTINCT event_id) AS an FROM train GROUP BY 1), am AS (SELECT median(an) AS amid FROM ac), t3 AS (SELECT t2.*, an, amid FROM t2 JOIN ac USING (artist_or_team), am)"
for _h, _x in _RAW.items():
    SQL[f"k11_weights_{_h}"] = with_(L, TRAIN, _Q, _A, f"w AS (SELECT listing_id, {_x} AS w FROM t3)", "s AS (SELECT count(*) / sum(w) AS f FROM w)") + f"SELECT listing_id, {r4('w * f')} AS weight FROM w, s"
SQL["k12_coverage_buckets"] = with_(L, "n AS (SELECT artist_or_team, count(DISTINCT event_id) AS n FROM listings GROUP BY 1)") + "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' ELSE '11+' END AS bucket, count(*) AS artists FROM n GROUP BY 1"
SQL["k12_city_months"] = listing_sql("city || ' | ' || strftime(event_datetime, '%Y-%m') AS city_month, count(DISTINCT event_id) AS events, count(DISTINCT event_id) < 5 AS thin", "", "GROUP BY 1")
SQL["k13_low_count_gate"] = with_(L, "p AS (SELECT artist_or_team, count(DISTINCT event_id) AS n FROM listings WHERE is_train AND artist_or_team <> 'Brand#7' GROUP BY 1)", "c AS (SELECT quantile_cont(n, 0.3) AS cut FROM p)", "t AS (SELECT DISTINCT artist_or_team FROM listings WHERE NOT is_train)") + "SELECT artist_or_team, coalesce(n, 0) AS train_events, coalesce(n, 0) <= cut AS gate_on, coalesce(n, 0) = 0 AS unseen FROM t LEFT JOIN p USING (artist_or_team), c"
_LOO = f"CASE WHEN n = 1 THEN g ELSE (s - ln(1 + listing_price) + 20 * g) / (n - 1 + 20) END"
SQL["g04_relative_target"] = with_(L, TRAIN, "gl AS (SELECT avg(ln(1 + listing_price)) AS g FROM train)", "e AS (SELECT event_id, count(*) AS n, sum(ln(1 + listing_price)) AS s FROM train GROUP BY 1)", f"t AS (SELECT listing_id, listing_price, {_LOO} AS b FROM train JOIN e USING (event_id), gl)") + f"SELECT listing_id, {r4('b')} AS target_base, {r4('ln(1 + listing_price) - b')} AS residual FROM t"
SQL["g01_targets"] = listing_sql(f"listing_id, {r4('ln(1 + listing_price)')} AS log_price, {r4('exp(ln(1 + listing_price)) - 1')} AS log_back, {r4('sqrt(listing_price)')} AS root_price, {r4('sqrt(listing_price) * sqrt(listing_price)')} AS root_back")

# evaluation

PREDICTED = f"med AS (SELECT event_id, median(listing_price) AS m FROM listings WHERE is_train AND listing_price < 900 GROUP BY 1), pred AS (SELECT listings.*, {zone('section')} AS zone, listing_price AS actual, coalesce(m, 500.0) AS predicted FROM listings LEFT JOIN med USING (event_id) WHERE NOT is_train)"
SQL["e01_regression"] = with_(L, PREDICTED) + f"SELECT count(*) AS n, {r4('avg(abs(actual - predicted))')} AS mae, {r4('sqrt(avg((actual - predicted) ** 2))')} AS rmse, {r4('1 - sum((actual - predicted) ** 2) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*))')} AS r2, {r4('avg(abs((actual - predicted) / actual)) * 100')} AS mape FROM pred"
SQL["e02_quartiles"] = with_(L, PREDICTED, "q AS (SELECT quantile_cont(actual, 0.25) AS a, quantile_cont(actual, 0.5) AS b, quantile_cont(actual, 0.75) AS c FROM pred)") + f"SELECT CASE WHEN actual <= a THEN 'Q1' WHEN actual <= b THEN 'Q2' WHEN actual <= c THEN 'Q3' ELSE 'Q4' END AS quartile, count(*) AS n, {r4('avg(abs(actual - predicted))')} AS mae FROM pred, q GROUP BY 1"
SQL["e03_zones"] = with_(L, PREDICTED) + f"SELECT zone AS normalized_seat_zone, count(*) AS n, {r4('avg(abs(actual - predicted))')} AS mae FROM pred GROUP BY 1"
SQL["e04_seen_unseen"] = with_(L, PREDICTED, "s AS (SELECT DISTINCT event_id FROM listings WHERE is_train AND event_type <> 'sports')", "t AS (SELECT 0.9::DOUBLE * quantile_cont(actual, 0.95) AS top FROM pred)", "f AS (SELECT pred.*, abs(actual - predicted) AS e, event_id IN (SELECT event_id FROM s) AS seen, top FROM pred, t)") + f"""SELECT count(*) FILTER (seen) AS n_seen, count(*) FILTER (NOT seen) AS n_unseen, {r4('avg(e)')} AS overall_mae, {r4('avg(e) FILTER (seen)')} AS seen_mae, {r4('avg(e) FILTER (NOT seen)')} AS unseen_mae, {r4('avg(e) FILTER (actual >= top)')} AS q4_mae,
 {r4('count(DISTINCT event_id) FILTER (NOT seen) / count(DISTINCT event_id) * 100')} AS unseen_event_pct FROM f"""
CLASSIFIED = "cl AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_orderkey * 7919 % 1000 / 1000 AS score FROM orders)"
SQL["e05_classification"] = with_(CLASSIFIED, "rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM cl)", "c AS (SELECT count(*) AS n, sum(label) AS p, count(*) - sum(label) AS q, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS rs, count(*) FILTER (score >= 0.5) AS said, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM rk)", "d AS (SELECT *, tp / said AS pr, tp / p AS rc FROM c)") + f"SELECT n, {r4('(rs - p * (p + 1) / 2) / (p * q)')} AS auc, {r4('pr')} AS precision, {r4('rc')} AS recall, {r4('2 * pr * rc / (pr + rc)')} AS f1 FROM d"
BINS = "bins AS (SELECT CAST(greatest(ceil(score * 10), 1) AS INTEGER) AS bin, count(*) AS n, avg(score) AS ms, avg(label) AS ps FROM cl GROUP BY 1)"
SQL["e06_calibration"] = with_(CLASSIFIED, BINS) + f"SELECT bin, n, {r4('ms')} AS mean_score, {r4('ps')} AS positives FROM bins"
SQL["e06_ece"] = with_(CLASSIFIED, BINS) + f"SELECT {r4('avg(abs(ps - ms))')} AS ece FROM bins"
SQL["e07_leaderboard"] = f"WITH r AS (SELECT 'v' || (o_custkey % 40) AS version, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 1000 ELSE o_totalprice / 900 END AS m, o_orderdate AS t, 'c' || o_orderkey AS c FROM orders), v AS (SELECT version, count(*) AS folds, avg(m) AS mae, coalesce(stddev_samp(m), 0.0) AS sd, max(t) AS last_at, max({{'t': t, 'c': c}}).c AS last_commit FROM r GROUP BY 1 ORDER BY mae, version LIMIT 20) SELECT version, folds, last_at, last_commit, {r4('mae')} AS mae, {r4('sd')} AS mae_std FROM v"
_E = "(actual - predicted)"
_HUBER = f"CASE WHEN abs{_E} <= 50 THEN 0.5::DOUBLE * {_E} * {_E} ELSE 50 * (abs{_E} - 25) END"
SQL["m13_asymmetric_huber"] = with_(L, PREDICTED) + f"SELECT zone AS normalized_seat_zone, {r4(f'avg(CASE WHEN {_E} > 0 THEN 2 * ({_HUBER}) ELSE {_HUBER} END)')} AS loss FROM pred GROUP BY 1"

# serving

_WAY = "CASE WHEN predicted > (actual + 1) * 1.05::DOUBLE THEN 'UP' WHEN predicted < (actual + 1) * 0.95::DOUBLE THEN 'DOWN' ELSE 'STABLE' END"
SQL["i01_bounds"] = with_(L, PREDICTED) + f"SELECT listing_id, {r4('predicted * 0.85::DOUBLE')} AS price_lower_bound, {r4('predicted * 1.15::DOUBLE')} AS price_upper_bound, {r4('CASE WHEN predicted > 0 THEN ' + clip('1 - least((predicted * 1.15::DOUBLE - predicted * 0.85::DOUBLE) / predicted, 1.0)', 0.0, 1.0) + ' ELSE 0.5 END')} AS confidence_score, {_WAY} AS predicted_direction, {r4(f'CASE WHEN ({_WAY}) = {chr(39)}STABLE{chr(39)} THEN 0.6::DOUBLE ELSE least(0.9::DOUBLE, 0.5::DOUBLE + abs(predicted - (actual + 1)) / (actual + 1)) END')} AS direction_probability FROM pred"
_CAT = "CASE " + " ".join(f"WHEN regexp_matches({folded('artist')}, '{S.any_of(names)}') THEN {f}::DOUBLE" for f, names in CATEGORY) + " ELSE 1.0 END"
SQL["i02_cold_start"] = with_(
    L, EVENTS, SCORED, f"x AS (SELECT event_id, CASE WHEN event_type = 'sports' THEN 'BTS world' ELSE artist_or_team END AS artist, {city_tier('city')} AS ct, upper(event_type) AS et FROM ev)", "y AS (SELECT x.*, tier FROM x LEFT JOIN (SELECT artist AS ak, tier FROM scored WHERE score > 30) ON lower(ak) = lower(artist))"
) + f"""SELECT event_id, z.zone AS zone, CASE WHEN tier IS NULL THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS confidence, CASE WHEN tier IS NULL THEN 'heuristic_keyword_fallback' ELSE 'heuristic_popularity_service' END AS estimate_source,
 {r4(f"z.price * (coalesce(CASE tier WHEN 'high' THEN 2.5::DOUBLE WHEN 'medium' THEN 1.5::DOUBLE WHEN 'low' THEN 1.0::DOUBLE END, {_CAT}) * ({case('ct', CITY_FACTOR, 1.0)})::DOUBLE * ({case('et', TYPE_FACTOR, 1.0)})::DOUBLE)")} AS estimate FROM y, (VALUES {", ".join(f"('{z}', {p}::DOUBLE)" for z, p in ZONE_PRICE.items())}) AS z(zone, price)"""  # fmt: skip
SQL["i04_discovered"] = "WITH k AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 20) SELECT name FROM k UNION ALL SELECT DISTINCT upper(p_brand) FROM part WHERE lower(p_brand) NOT IN (SELECT lower(name) FROM k)"
SQL["i04_allocation"] = with_(SCORED) + "SELECT tier, count(*) AS artists, CAST(sum(CASE tier WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END) AS BIGINT) AS max_events FROM scored GROUP BY tier"

# quality

SQL["q03_quality_rates"] = with_(L, "q AS (SELECT quantile_cont(listing_price, 0.25) AS a, quantile_cont(listing_price, 0.75) AS b FROM listings)") + f"SELECT count(*) AS n, {r4('count(*) FILTER (listing_price < 1 OR listing_price > 50000 OR listing_price < a - 1.5::DOUBLE * (b - a) OR listing_price > b + 1.5::DOUBLE * (b - a)) / count(*)')} AS outlier_rate, {r4('1 - count(face_value) / count(*)')} AS null_rate FROM listings, q"

# streams

SQL["r02_stream_distinct"] = "SELECT DISTINCT 'E' || user_id AS event_id, event_type AS seat_zone FROM events"
SQL["r05_stream_dedup_6h"] = SQL["w05_dedup_6h"].replace("SELECT seq, dup AS is_duplicate FROM f", "SELECT seq FROM f WHERE NOT dup")
SQL["r06_stream_disappearances"] = with_(
    "sc AS (SELECT DISTINCT user_id, ts FROM events)", "n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM sc)", "o AS (SELECT DISTINCT e.user_id, e.event_type, e.ts, n.r FROM events e JOIN n ON n.user_id = e.user_id AND n.ts = e.ts)",
    "m AS (SELECT user_id, max(r) AS last FROM n GROUP BY 1)", "g AS (SELECT o.*, coalesce(lead(r) OVER (PARTITION BY o.user_id, event_type ORDER BY r), m.last + 1) - r - 1 AS gap FROM o JOIN m ON m.user_id = o.user_id)",
) + "SELECT 'E' || g.user_id || '-' || event_type AS listing_id, g.ts AS last_seen, n.ts AS missed_at FROM g JOIN n ON n.user_id = g.user_id AND n.r = g.r + 1 WHERE gap >= 2"

# collection runs

SQL["p07_urgent"] = with_(L, EVENTS) + "SELECT event_id, event_datetime FROM ev WHERE event_datetime < TIMESTAMP '1998-03-15'"
SQL["p09_aliases"] = with_(L, "x AS (SELECT CASE WHEN quantity = 2 THEN 'Drake' ELSE artist_or_team END AS artist, quantity = 3 AS is_festival FROM listings)") + "SELECT artist, is_festival, count(*) AS n FROM x GROUP BY ALL"
SQL["s34_ingest_counts"] = with_(L, "floored AS (SELECT * REPLACE (floor(listing_price) + 0.0 AS listing_price) FROM listings)", f"hashed AS (SELECT *, {HASH} AS hash, timestamp > TIMESTAMP '2000-01-01' OR listing_price <= 0 AS bad FROM floored)", "c AS (SELECT count(*) AS fetched, count(*) FILTER (bad) AS errors, count(DISTINCT hash) FILTER (NOT bad AND hash NOT IN (SELECT hash FROM hashed WHERE is_train)) AS saved FROM hashed WHERE NOT is_train)") + "SELECT fetched, saved, fetched - errors - saved AS skipped, errors FROM c"
SQL["s35_pending"] = "SELECT DISTINCT p_brand AS artist FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)"
SQL["k04_temporal_folds"] = with_(L, "p AS (SELECT *, CASE WHEN r <= fold * z THEN 'train' WHEN r <= fold * z + z THEN 'val' END AS part FROM (SELECT timestamp, r, z, fold FROM (SELECT timestamp, row_number() OVER (ORDER BY timestamp, listing_id) AS r, count(*) OVER () // 4 AS z FROM listings), (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS fold)))") + "SELECT fold, part, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at FROM p WHERE part IS NOT NULL GROUP BY fold, part"
SQL["q02_snapshot_pipeline"] = with_(SNAPSHOTS_SQL) + "SELECT seq % 23 <> 0 AS zone_known, price_min <= coalesce(price_avg, price_min) AND coalesce(price_avg, price_max, price_min) <= coalesce(price_max, price_avg, price_min) AS price_ordered, count(*) AS n FROM snapshots GROUP BY ALL"
SQL["w01_prefix_counts"] = "WITH RECURSIVE one AS (" + SQL["x08_within_event"] + ") SELECT we_history_support, count(*) AS n, max(we_pos_in_sequence) AS furthest FROM one GROUP BY 1"
