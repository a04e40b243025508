"""Catalogue queries against the same SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from corvane import queries as catalogue
from corvane.operators import collect, popularity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = [
    "s12_listing_hash", "s14_dedup_append", "s28_marketplace_payloads", "p10_geo_region", "p22_validation", "j02_asof_snapshot", "a05_distribution", "a19_popularity_scores", "w05_dedup_6h", "w09_coverage_cut", "f03_rows_and_seats", "x01_performer", "x05_event_pricing", "x07_cold_start",
    "x08_within_event_train", "x10_listing_structural_train", "x12_regional", "x16_interaction", "l02_absence_label", "l03_depletion_label", "k02_stratified_split", "k03_group_folds", "k11_weights_inverse_price_quartile", "e04_seen_unseen", "e07_leaderboard", "i02_cold_start", "r06_stream_disappearances",
]


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    number = lambda c: pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c)
    df = df.apply(lambda c: c.astype("float64") if number(c) else c).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got, want = plain(catalogue.queries()[name](spark, SF_DIR).toPandas()), plain(duck.sql(catalogue.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


def test_every_query_has_sql_or_a_reason():
    without = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert without == {"q01_listing_pipeline", "m01_ridge", "m02_boosted_bands", "m12_sale_probability", "u04_greedy_dedup"}  # sequential folds and fitted models


def test_greedy_dedup_brute_force(spark, duck):
    rows = duck.sql("select p_partkey, p_partkey % 90, p_type, p_size % 11, p_brand from part where p_partkey < 400 order by 1").fetchall()
    want, ids, days = [], set(), set()
    for seq, i, venue, day, batch in rows:
        if (batch, i) in ids or (batch, venue, day) in days:
            continue
        want.append(seq)
        ids.add((batch, i))
        days.add((batch, venue, day))
    assert sorted(r.seq for r in catalogue.queries()["u04_greedy_dedup"](spark, SF_DIR).collect()) == want


def test_round_robin_over_a_whole_table(spark):
    path = "/root/testdata/sf0.01/customer.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = spark.read.parquet(path).select("c_custkey", "c_mktsegment")
    out = popularity.round_robin(rows, "c_mktsegment", ["c_custkey"])
    turns, want = {}, []
    for key, segment in sorted(map(tuple, rows.collect())):
        turns[segment] = turns.get(segment, 0) + 1
        want.append((turns[segment], segment, key))
    assert len(want) > 1000
    assert sorted((r.position, r.turn, r.c_mktsegment, r.c_custkey) for r in out.collect()) == [(i, *x) for i, x in enumerate(sorted(want), 1)]
    assert "windowspecdefinition(turn" not in out._jdf.queryExecution().toString()  # no window over all rows


def test_greedy_dedup_over_a_whole_table(spark):
    path = "/root/testdata/sf0.01/part.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = duckdb.sql(f"select p_partkey, p_partkey % 90, p_type, p_size % 11, p_brand from '{path}' order by 1").fetchall()
    want, taken = [], set()
    for seq, i, venue, day, batch in rows:
        keys = {(batch, i), (batch, venue.lower(), day)}
        if not keys & taken:
            want.append(seq)
            taken |= keys
    assert max(want) > 400
    got = catalogue.queries()["u04_greedy_dedup"](spark, "/root/testdata/sf0.01")
    assert sorted(r.seq for r in got.collect()) == want
    assert "collect_list" not in got._jdf.queryExecution().toString()
    day = pd.Timestamp("2025-01-01 20:00").to_pydatetime()
    odd = [(1, "a", None, day), (1, "a", None, day), (2, None, "v", day), (3, "", "V", day), (4, "", "", None), (5, None, None, day), (6, "b", "w", day), (7, "b", "u", day), (8, "c", "u", day)]
    made = spark.createDataFrame(odd, "seq int, id string, venue string, event_datetime timestamp")
    assert sorted(r.seq for r in collect.first_of_both(made, ["seq"]).collect()) == [1, 2, 4, 5, 6, 8]
    assert collect.first_of_both(made.limit(0), ["seq"]).columns == made.columns
