import datetime

from pyspark.sql import functions as F

from tessera.operators.folds import debounce
from tessera.streaming import changes


def test_deltas(spark, tmp_path):
    rows = [(1, "upsert", "a"), (2, "remove", "a"), (3, "upsert", "b")]
    log = spark.createDataFrame([(*r, datetime.datetime(2024, 1, 1)) for r in rows], "version long, op string, unit_id string, logged_at timestamp_ntz")
    log.write.parquet(str(tmp_path / "log"))
    seen = []
    q = changes.write_deltas(changes.log_stream(spark, str(tmp_path / "log")), lambda f, i: seen.extend(tuple(r) for r in f.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert set(seen) == {("a", "remove", 2), ("b", "upsert", 3)}


def test_rescans_match_batch_twin(spark, tmp_path):
    times = {"s1": [50_000, 51_000, 52_500, 54_000, 54_900, 55_600], "s2": [50_100, 59_000]}
    folder = str(tmp_path / "ev")
    spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts], "source string, t long").coalesce(1).write.parquet(folder)
    spark.createDataFrame([("end", 10_000_000)], "source string, t long").coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("end", 20_000_000)], "source string, t long").coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema("source string, t long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    q = changes.rescans(events, "source", "t", 2000, 5000, "0 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bursts").filter(F.col("source") != "end").collect()}
    assert got == {(s, *b) for s, ts in times.items() for b in debounce(ts, 2000, 5000)}


def test_progress(spark):
    a = spark.createDataFrame([("done",), ("running",), (None,)], "extraction_status string")
    assert tuple(changes.progress(spark, a, 7).first()) == (3, 1, 1, 7)


def test_reconciled_in_batches(spark, tmp_path):
    """Found files come in batches; each is held against what is known, and nothing is deleted for being absent from a batch."""
    found = "path string, size_bytes long, mtime_ms long, content_hash string, kind string, oversized boolean"
    folder = str(tmp_path / "scans")
    for rows in ([("a", 1, 1, "h", "pdf", False)], [("b", 1, 1, "n", "pdf", False), ("c", 1, 1, None, "pdf", False)]):
        spark.createDataFrame(rows, found).coalesce(1).write.mode("append").parquet(folder)
    known = spark.createDataFrame([(p, 1, 1, "h", "pdf", False, "done", "s") for p in "abz"], found + ", extraction_status string, source_id string")
    seen = []
    q = changes.write_reconciled(spark.readStream.schema(found).option("maxFilesPerTrigger", 1).parquet(folder), lambda: known, lambda f, i: seen.extend(tuple(r) for r in f.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == [("b", "update", "pending", True), ("c", "insert", "pending", True)]
