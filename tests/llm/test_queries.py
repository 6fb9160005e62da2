"""The queries with SQL against DuckDB, and ids against the library, on the small tables."""

import os

import duckdb
import pytest

from tessera.llm import queries as Q
from tessera.llm.encode import TOKENIZERS
from tessera.llm.pack import _tiktoken


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, name):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    want = c.sql(Q.SQL[name])
    got = Q.QUERIES[name](spark, folder).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_all_ids(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    e = _tiktoken(TOKENIZERS, "byte_bpe_50k")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = Q.QUERIES["p8_ids"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == (e.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else [])
