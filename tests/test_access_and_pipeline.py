from tessera.operators import access, library, pipeline


def test_levels(spark):
    assets = spark.createDataFrame([("1", "a/b/x", "internal", "u9"), ("2", "a/y", "internal", None), ("3", "z", "internal", "me"), ("4", "p/q/r", "internal", None), ("5", "c/x", "public", None), ("6", "a/b/w", "public", None), ("7", "a/b/v", "internal", None)], "id string, path string, visibility string, uploaded_by string")
    entries = spark.createDataFrame(
        [("group", "g", "dir", "a", "write"), ("user", "me", "dir", "a/b", "read"), ("group", "g", "asset", "6", "deny"), ("user", "me", "asset", "7", "read"), ("group", "g", "asset", "7", "deny"), ("user", "you", "asset", "2", "deny"), ("group", "g", "dir", "c", "deny")],
        "subject_type string, subject_id string, target_type string, target_id string, level string",
    )
    members = spark.createDataFrame([("me", "g")], "user_id string, group_id string")
    public = spark.createDataFrame([("p",)], "dir string")
    levels = access.levels(assets, entries, members, "me", public)
    # nearest folder before the further one; denial without fall-through; user before group; public ancestor; root without entry
    assert {r[0]: r[1] for r in levels.collect()} == {"1": "read", "2": "write", "3": "none", "4": "read", "5": "none", "6": "none", "7": "read"}
    assert {r[0] for r in access.readable(assets, levels, "me").collect()} == {"1", "2", "3", "4", "7"}
    assert {r[0] for r in access.writable(assets, levels, "me").collect()} == {"2", "3"}
    assert access.readable(assets, levels, "root", admin=True).count() == 7


def test_root_entry(spark):
    assets = spark.createDataFrame([("1", "a/x", "internal", None), ("2", "y", "internal", None)], "id string, path string, visibility string, uploaded_by string")
    entries = spark.createDataFrame([("user", "me", "dir", "", "read")], "subject_type string, subject_id string, target_type string, target_id string, level string")
    none = spark.createDataFrame([], "user_id string, group_id string")
    assert {r[1] for r in access.levels(assets, entries, none, "me").collect()} == {"read"}


def test_log(spark):
    log = spark.createDataFrame([(1, "upsert", "a"), (2, "remove", "a"), (3, "upsert", "a"), (4, "upsert", "b"), (5, "remove", "b"), (5, "remove", "b")], "version long, op string, unit_id string")
    assert {(r[0], r[1], r[2]) for r in pipeline.last_ops(log).collect()} == {("a", "upsert", 3), ("b", "remove", 5)}
    assert pipeline.last_ops(log, 5).collect() == [] and pipeline.current_version(log.limit(0)).first()[0] == 0


def test_reconcile(spark):
    found = "path string, size_bytes long, mtime_ms long, content_hash string, kind string, oversized boolean"
    disk = spark.createDataFrame(
        [("same", 1, 1, "h", "pdf", False), ("touched", 1, 2, "h", "pdf", False), ("changed", 1, 1, "n", "pdf", False), ("big", 1, 1, "n", "pdf", True), ("kind", 1, 1, None, "other", False), ("new", 1, 1, None, "pdf", None), ("odd", 1, 1, None, "other", False)], found
    )
    known = [("same", "h", "done"), ("touched", "h", "done"), ("changed", "o", "done"), ("big", "o", "done"), ("kind", None, "done"), ("gone", "h", "done"), ("others", "h", "failed")]
    rows = [(p, 1, 1, h, "pdf", p == "big", st, "s2" if p == "others" else "s1") for p, h, st in known]
    assets = spark.createDataFrame([*rows, rows[0]], found + ", extraction_status string, source_id string")
    got = {r[0]: tuple(r)[1:] for r in pipeline.reconcile(disk, assets, "s1").collect()}
    assert got == {
        "same": ("skip", "done", False), "touched": ("update", "done", False), "changed": ("update", "pending", True), "big": ("skip", "done", False), "kind": ("update", "skipped", False),
        "new": ("insert", "pending", True), "odd": ("insert", "skipped", False), "gone": ("delete", "done", False), "others": ("skip", "failed", False),
    }
    assert pipeline.reconcile(disk.limit(0), assets.limit(0)).count() == 0


def test_log_entries_run_on(spark):
    log = spark.createDataFrame([(7, "upsert", "x")], "version long, op string, unit_id string")
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "unit_id string")
    got = [tuple(r) for r in pipeline.entries(log, one("b", "a"), one("c", "a")).orderBy("version").collect()]
    assert got == [(8, "remove", "a"), (9, "remove", "b"), (10, "upsert", "a"), (11, "upsert", "c")]
    assert pipeline.entries(log, one().limit(0), one().limit(0)).count() == 0


def test_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r[0] for r in pipeline.closure(start, edges).collect()} == {"a", "b", "c"}


def test_preflight_and_prefix(spark):
    assets = spark.createDataFrame([("p/a", "h1"), ("p/b", None)], "path string, content_hash string")
    up = spark.createDataFrame([(1, "p/a", "h1"), (2, "p/b", "zz"), (3, "p/c", "h2"), (4, None, "h1"), (5, "", "q")], "pos int, path string, hash string")
    assert {r[0]: r[2] for r in library.preflight(up, assets).collect()} == {1: "same-hash", 2: "same-name", 3: "ok", 4: "error", 5: "error"}
    metas = spark.createDataFrame([(2, "p", "late"), (1, "p", "first")], "pos int, prefix string, meta string")
    assert {r["path"]: r["meta"] for r in library.first_prefix(assets.select("path"), metas).collect()} == {"p/a": "first", "p/b": "first"}


def test_neighbours_and_rename(spark):
    units = spark.createDataFrame([(f"u{i}", "a", i) for i in (1, 2, 3, 5)], "id string, asset_id string, ordinal int")
    got = library.neighbours(units, units.filter("id = 'u2'"), 1, 3).collect()
    assert {(r["unit_id"], r["offset"]) for r in got} == {("u1", -1), ("u2", 0), ("u3", 1), ("u5", 3)}
    a = spark.createDataFrame([("x/a",), ("xy/a",)], "path string")
    assert {r[0] for r in library.renamed(a, "x", "z/w").collect()} == {"z/w/a", "xy/a"}
