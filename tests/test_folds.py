import random

import pandas as pd

from tessera.operators import folds
from tessera.operators.layout import Piece, blocks_of, columns_of, in_margin, lines_of, page_blocks, table_starts


def test_windows(spark):
    seg = [(0, 9000, "a"), (10000, 29000, "b"), (29999, 31000, "c"), (30000, 40000, "d"), (61000, 62000, "e"), (62000, 63000, " ")]
    df = spark.createDataFrame([("x", *s) for s in seg], "k string, s long, e long, t string")
    got = folds.transcript_windows(df, "k", "s", "e", "t").orderBy("window_no").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 31000, "a b c"), (30000, 40000, "d"), (61000, 62000, "e")]


def test_debounce(spark):
    assert folds.debounce([0, 1000, 2500, 4000, 4900, 5600], 2000, 5000) == [(0, 5000, 5), (5600, 7600, 1)]
    assert folds.debounce([], 2000, 5000) == []
    rng = random.Random(3)
    events = [(u, t) for u in "abc" for t in sorted(rng.choices(range(0, 400_000), k=60))]
    df = spark.createDataFrame([*events, ("a", None)], "u string, t long")
    got = {tuple(r) for r in folds.debounced(df, "u", "t", 2000, 5000, day_ms=20_000).collect()}
    want = {(u, *b) for u in "abc" for b in folds.debounce([t for v, t in events if v == u], 2000, 5000)}
    assert got == want
    assert folds.debounced(df.limit(0), "u", "t").collect() == []


def test_batches_and_caps(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([10, 10, 90, 200, 5, 5])], "g string, o int, n int")
    assert [r["batch_no"] for r in folds.batches(df, "g", "o", "n", 2, 100).orderBy("o").collect()] == [1, 1, 2, 3, 4, 4]
    df = spark.createDataFrame([("z", i, n) for i, n in enumerate([50, 60, 40, 10, 1])], "a string, o long, n long")
    assert [r["accepted"] for r in folds.accepted_entries(df, "a", "o", "n", 3, 100).orderBy("o").collect()] == [True, False, True, True, False]


def test_interleave(spark):
    s = "unit_id string, asset_id string, rank0 int"
    o = spark.createDataFrame([("o0", "A", 0), ("o1", "A", 1), ("o2", "B", 2), ("o3", "B", 3)], s)
    t = spark.createDataFrame([("t0", "C", 0), ("o2", "B", 1), ("t2", "A", 2)], s)
    assert [r["unit_id"] for r in folds.interleave(o, t).orderBy("slot").collect()] == ["o0", "t0", "o2", "o3", "t2"]


def test_completions(spark):
    assert folds.completions_of("quay", "The quayside, a Quay-crane. quay") == ["quayside", "Quay-crane"]
    assert folds.completions_of("港口", "港 口起重机，港口 ") == ["港 口起重机"]
    assert folds.completions_of("a b", "xx A\u3000B c") == [] and folds.completions_of(" ", "a") == [] and folds.completions_of("a", None) == []
    assert folds.completions_of("ab", "abc abd abe abf abg") == ["abc", "abd", "abe", "abf"]
    df = spark.createDataFrame([("quayside quayside",), ("quays",), (None,)], "t string")
    assert [tuple(r) for r in folds.completions(df, "t", "quay").collect()] == [("quayside", 2), ("quays", 1)]


def p(text, left, top, width=50, height=10, size=10.0):
    return Piece(text, left, top, left + width, top + height, size, False)


def test_layout():
    lines = lines_of([p("world", 60, 11), p("hello", 0, 10), p("hello", 0, 10), p("next", 0, 24)])
    assert [x.text for x in lines] == ["hello world", "next"]
    assert [b.text for b in blocks_of(lines)] == ["hello world next"]
    assert len(columns_of([p("a", 10, 0, 200), p("b", 400, 0, 150)], 600)) == 2


def test_page_blocks(spark):
    rows = [("d", 1, t, x, y, w, 10.0, 10.0, False) for t, x, y, w in (("Title over all", 20.0, 10.0, 560.0), ("left one", 20.0, 100.0, 200.0), ("left two", 20.0, 112.0, 200.0), ("right one", 400.0, 90.0, 180.0))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc", "page", "text", "left", "top", "width", "height", "size", "bold"]))
    assert [r["text"] for r in page_blocks(df, 600.0, 800.0).orderBy("block").collect()] == ["Title over all", "right one", "left one left two"]


def test_tables_and_margins():
    cells = [p(f"c{i}{k}", 10 + 60 * k, 20 * i, 40) for i in range(4) for k in range(2)]
    assert table_starts(lines_of(cells)) == [10, 70]
    assert table_starts(lines_of([p(f"l{i}", 10, 20 * i, 200) for i in range(5)])) == [] and table_starts([]) == []
    # A row after the table takes over its columns, a block of symbols is dropped, a paragraph stays whole.
    rows = [p(f"c{i}{k}", 10 + 60 * k, 12 * i, 40) for i in range(3) for k in range(2)] + [p("x", 10, 100, 40), p("y", 70, 100, 40), p("× ✓", 10, 200, 30), p("plain words", 10, 300, 90)]
    assert [b.text for b in blocks_of(lines_of(rows))] == ["c00 c10 c20", "c01 c11 c21", "x", "y", "plain words"]
    assert in_margin(p("Head", 0, 5), 800, 10) == "header" and in_margin(p("3 / 10", 0, 780), 800, 10) == "footer"
    assert in_margin(p("x" * 200, 0, 780), 800, 10) is None and in_margin(p("body", 0, 400), 800, 10) is None
