"""Structured Streaming: the change log as a stream, progress snapshots, and rescans set off by file events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.folds import debounce
from tessera.operators.pipeline import last_ops, reconcile

LOG = "version long, op string, unit_id string, logged_at timestamp_ntz"


def log_stream(spark: SparkSession, folder: str, schema: str = LOG, files: int = 100) -> DataFrame:
    """The change log as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def file_events(events: DataFrame, kind: str, paths: str) -> DataFrame:
    """File events, a row per path, with kind created, removed or modified (renamings too), from what a watcher reports (kind as
    create/..., modify/..., remove/...). Changes of metadata alone are left out: reading a file makes them. A stream or a table alike."""
    raw, known = F.col(kind), [c for c in events.columns if c not in (kind, paths)]
    rows = events.filter(~F.coalesce(raw.startswith("modify/metadata"), F.lit(False)))
    return rows.select(*known, F.when(raw.startswith("create"), "created").when(raw.startswith("remove"), "removed").otherwise("modified").alias("kind"), F.explode(paths).alias("path"))


def write_reconciled(scans: DataFrame, known: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands what each micro-batch of found files changes, against the files known at that time, to apply(frame, batch_id); deletions come
    from full scans only, since a batch holds a part of the files. apply must be idempotent by batch_id."""

    def step(batch: DataFrame, i: int) -> None:
        now = known().join(batch.select("path").distinct(), "path", "left_semi")
        apply(reconcile(batch, now).filter("action <> 'skip'"), i)

    return scans.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def write_deltas(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the last operation on each unit of every micro-batch to apply(frame, batch_id); apply must be idempotent by batch_id."""
    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda f, i: apply(last_ops(f), i)).start()


def distinct_jobs(jobs: DataFrame, keys: list[str], time: str, within: str = "10 minutes") -> DataFrame:
    """Jobs once per key within the watermark."""
    return jobs.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def rescans(events: DataFrame, source: str, ts_ms: str, quiet: int = 2000, cap: int = 5000, late: str = "10 seconds") -> DataFrame:
    """(source, first_ms, fired_ms, events): bursts of file events, fired once the watermark has passed their end. Event time; exact
    against folds.debounced() for events in order. State per source is its open burst only."""
    timed = events.select(F.col(source).cast("string").alias("source"), F.col(ts_ms).cast("long").alias("t")).withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held += [int(x) for f in frames for x in f["t"]]
        held.sort()
        passed = state.getCurrentWatermarkMs()
        bursts = debounce(held, quiet, cap)
        done = [b for b in bursts if b[1] <= passed]
        if done:
            held = held[sum(b[2] for b in done) :]
        if held:
            state.update((held,))
            state.setTimeoutTimestamp(max(min(held[0] + cap, held[-1] + quiet), passed + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(key[0], *b) for b in done], columns=["source", "first_ms", "fired_ms", "events"])

    return timed.groupBy("source").applyInPandasWithState(step, "source string, first_ms long, fired_ms long, events long", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def progress(spark: SparkSession, assets: DataFrame, version: int) -> DataFrame:
    """One row: counts by state, with the version of the snapshot."""
    s = F.col("extraction_status")
    return assets.agg(F.count("*").alias("total"), F.count_if(s == "done").alias("done"), F.count_if(s == "running").alias("running")).withColumn("version", F.lit(version))
