import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.search import Phrase, QuerySpec, clamp, phrases, snippet, time_argument

ROWS = [
    ("u1", "Alpha delta", "the quay crane lifts the quay crane", "a.pdf"),
    ("u2", None, "crane quay résumé", "delta-alpha.txt"),
    ("u3", "Beta", "a a a a", "alpha.txt"),
    ("u4", "", None, None),
    ("u5", "gamma", "quay, crane; warehouse", "b.pdf"),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(ROWS + ROWS[:1], "id string, title string, text string, file_name string")


def found(units, q, **kw):
    return {r["id"] for r in search.match(search.index(units), phrases(q, **kw)).collect()}


def test_matching(units):
    assert found(units, "quay crane") == {"u1", "u2", "u5"}
    assert found(units, "quay-crane") == {"u1", "u5"}
    assert found(units, "ware", prefix=True) == {"u5"}
    assert found(units, "RESUME") == {"u2"}
    assert found(units, "alpha ---") == {"u1", "u2", "u3"}
    assert found(units, "--- !!") == set()
    assert found(units, "alpha", scope="filename") == {"u2", "u3"}
    assert found(units, "alpha beta", scope="filename") == set()
    assert found(units, "alpha beta", scope="filename", compat=True) == {"u3"}


def test_same_ranking_as_sqlite(units):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, text, file_name)")
    db.executemany("INSERT INTO f VALUES (?,?,?,?)", ROWS)
    for q, expr, kw in (("quay crane", '"quay" "crane"', {}), ("quay-crane", '"quay-crane"', {}), ("alpha", '"alpha"', {}), ("war", '"war"*', {"prefix": True}), ("a", '"a"', {})):
        want = {i: -r for i, r in db.execute("SELECT id, rank FROM f WHERE f MATCH ?", (expr,))}
        got = {r["id"]: r["score"] for r in search.match(search.index(units), phrases(q, **kw)).collect()}
        assert got.keys() == want.keys()
        for i in got:
            assert got[i] == pytest.approx(want[i], abs=1e-5)


def test_overlapping_phrase(units):
    rows = search.index(units).filter("id = 'u3'").select(search._occurrences(F.col("s_text"), Phrase(("a", "a"))).alias("n"))
    assert rows.first()["n"] == 3


def test_no_rows(spark, units):
    assert search.match(search.index(units.limit(0)), phrases("a")).collect() == []


def test_arguments():
    assert [clamp(x, 1, 100, 50) for x in (None, 0, float("nan"), 7, 1000, -3)] == [50, 50, 50, 7, 100, 1]
    assert time_argument(1_700_000_000) == 1_700_000_000_000 and time_argument("1700000000000") == 1_700_000_000_000
    assert time_argument("2024-01-01") == 1_704_067_200_000 and time_argument("soon") is None and time_argument("") is None
    assert QuerySpec("x", 0).size == 50


def test_fusion(spark):
    legs = [spark.createDataFrame(r, "unit_id string, leg string, leg_pos int, rank0 int") for r in ([("a", "fts", 0, 0), ("b", "fts", 0, 1)], [("b", "semantic", 2, 0), ("c", "semantic", 2, 4)])]
    got = {r["unit_id"]: r for r in search.fuse(legs).collect()}
    assert got["b"]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and got["b"]["legs"] == ["fts", "semantic"] and got["b"]["first_rank"] == 1
    assert got["c"]["score"] == pytest.approx(1 / 65, abs=1e-9)


def test_vectors(spark):
    nan = float("nan")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.6, 0.8]), ("c", None), ("d", [nan, 1.0]), ("e", [1.0])], "unit_id string, vector array<float>")
    q = spark.createDataFrame([([0.0, 1.0],)], "q array<float>")
    assert [(r[0], r[1]) for r in search.nearest_units(v, q, 5, dim=2).collect()] == [("a", 1.0), ("b", 0.8)]
    assert search.nearest_units(v, q.limit(0), 5, dim=2).collect() == []


def test_several_query_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.6, 0.8]), ("c", [0.8, 0.6]), ("d", None)], "unit_id string, vector array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, [0.8, 0.6])], "query long, q array<float>")
    got = {(r["query"], r["unit_id"], round(r["score"], 3)) for r in search.nearest_units(v, q, 2, dim=2, by="query").collect()}
    assert got == {(1, "a", 1.0), (1, "b", 0.8), (2, "b", 1.0), (2, "c", 0.96), (3, "c", 1.0), (3, "b", 0.96)}
    assert search.nearest_units(v, q, None, dim=2, by="query").count() == 9
    assert search.nearest_units(v, q.limit(0), 2, dim=2, by="query").collect() == []


def test_snippet():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen quay crane end"
    assert "[quay crane]" in snippet(text, phrases("quay-crane"))
    assert snippet("only this", phrases("zzz")) == "only this" and snippet(None, phrases("a")) == ""


def test_filters(spark):
    df = spark.createDataFrame([("a/x.txt", 5), ("ab/x.txt", 6), ("x.txt", None)], "path string, mtime long")
    assert {r[0] for r in df.filter(search.in_groups(F.col("path"), ("a",))).collect()} == {"a/x.txt"}
    assert {r[0] for r in df.filter(search.in_groups(F.col("path"), ("__ungrouped__",))).collect()} == {"x.txt"}
    assert df.filter(search.in_groups(F.col("path"), ())).count() == 3
    assert {r[0] for r in df.filter(search.in_window(F.col("mtime"), 5, 5)).collect()} == {"a/x.txt"}
    assert df.filter(search.in_window(F.col("mtime"), None, None)).count() == 3
