"""The persisted index: generations, replacement, deletion, healing, and the same hits as a search of the texts."""

from tessera.operators import inverted, search


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, asset_id string, title string, text string, file_name string")


ROWS = [("u1", "a", "Quay crane", "The quay crane moves. Quay-crane again.", "x.pdf"), ("u2", "a", None, "crane and quay", "quay.pdf"), ("u3", "b", "", None, "crane.txt"), ("u4", "b", "Crâne", "the quays", None)]


def hits(index, text, **kw):
    return {r["key"]: round(r["score"], 6) for r in index.match(search.phrases(text, **kw)).collect()}


def test_index_matches_like_a_scan(spark, tmp_path):
    units = frame(spark, [*ROWS, ROWS[0]])
    index = inverted.build(spark, units, str(tmp_path / "i"))
    for text, kw in (("crane", {}), ("quay-crane", {}), ("qua", {"prefix": True}), ("q", {"prefix": True}), ("quay crane", {"scope": "content"}), ("crane crane", {}), ("pdf", {"scope": "filename"}), ("absent", {}), ("--", {})):
        want = {r["id"]: round(r["score"], 6) for r in search.match(search.index(units), search.phrases(text, **kw)).collect()}
        assert hits(index, text, **kw) == want, text


def test_index_life(spark, tmp_path):
    index = inverted.build(spark, frame(spark, ROWS), str(tmp_path / "i"))
    index.replace(frame(spark, [("u1", "a", "Quay crane", "nothing left", "x.pdf"), ("u5", "c", None, "crane", None)]))
    now = frame(spark, [("u1", "a", "Quay crane", "nothing left", "x.pdf"), *ROWS[1:], ("u5", "c", None, "crane", None)])
    fresh = {r["id"]: round(r["score"], 6) for r in search.match(search.index(now), search.phrases("crane")).collect()}
    assert hits(index, "crane") == fresh and set(fresh) == {"u1", "u2", "u3", "u4", "u5"}
    index.delete(spark.createDataFrame([("u2",), ("unknown",)], "key string"))
    index.delete_assets(spark.createDataFrame([("b",)], "asset_id string"))
    left = frame(spark, [("u1", "a", "Quay crane", "nothing left", "x.pdf"), ("u5", "c", None, "crane", None)])
    assert hits(index, "crane") == {r["id"]: round(r["score"], 6) for r in search.match(search.index(left), search.phrases("crane")).collect()}
    assert tuple(index.linkage(left).first()) == (2, 2, True) and not index.heal(left)
    assert not index.linkage(now).first()["consistent"] and index.heal(now) and index.linkage(now).first()["consistent"]
    assert hits(index, "crane") == fresh


def test_index_reads_only_its_buckets(spark, tmp_path):
    index = inverted.build(spark, frame(spark, ROWS), str(tmp_path / "i"))
    plan = index.postings(["crane"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "crane" in plan.split("PushedFilters: [")[1]


def test_empty_index(spark, tmp_path):
    index = inverted.build(spark, frame(spark, ROWS).limit(0), str(tmp_path / "i"))
    assert hits(index, "crane") == {} and inverted.Index(spark, str(tmp_path / "none")).match(search.phrases("x")).collect() == []
