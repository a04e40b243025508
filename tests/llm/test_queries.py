"""The contract columns of each query on the smallest tables, and exact dedup against its SQL."""

import os

import duckdb
import pytest

from corvane.llm import queries as llm

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op9_substring_dedup": {"doc_id": "bigint", "start": "bigint", "end": "bigint", "kept": "boolean"},
    "op10_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.fixture(scope="module", autouse=True)
def tables():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables here")


def test_names():
    assert set(llm.queries()) == set(COLUMNS) and set(llm.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    df = llm.queries()[name](spark, SF_DIR)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    got = df.toPandas()
    ids = set(range(200))
    assert set(got.doc_id) == ids if name != "op9_substring_dedup" else set(got.doc_id) <= ids
    assert len(got) == 200 or name in ("op1_packing", "op9_substring_dedup")


def test_exact_dedup_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF_DIR}/documents.parquet'")
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = c.sql(llm.OP5_SQL).df()[key].sort_values("doc_id").values.tolist()
    assert llm.queries()["op5_exact_dedup"](spark, SF_DIR).toPandas()[key].sort_values("doc_id").values.tolist() == want
