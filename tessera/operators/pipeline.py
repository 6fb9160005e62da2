"""Keeping the index in step with the files: scans, the change log, fencing, de-duplication and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import dirname, timecode
from tessera.session import cut_lineage
from tessera.sources.files import extractable


def reconcile(disk: DataFrame, assets: DataFrame, source: str | None = None) -> DataFrame:
    """(path, action, status, enqueue): insert, update, skip or delete, from what a scan found (path, size_bytes, mtime_ms, content_hash,
    kind, oversized) and what is known (the same, extraction_status, source_id).

    A file has changed when its hash has (that of an oversized file doesn't count; a missing one is empty), its size, time or kind. Only a
    changed hash has it read again; a file that cannot be read is skipped. Paths belong to the source that saw them first: of files that are
    gone, only those of the scanned source (all without one) are deleted. A duplicate row counts once.
    """
    cols = ("size_bytes", "mtime_ms", "content_hash", "kind", "oversized")
    d = disk.select("path", *[F.col(c).alias(f"d_{c}") for c in cols], F.lit(True).alias("on_disk")).distinct()
    a = assets.select("path", *[F.col(c).alias(f"a_{c}") for c in cols], F.col("extraction_status").alias("before"), "source_id", F.lit(True).alias("known")).distinct()
    hash_changed = (F.coalesce("d_content_hash", F.lit("")) != F.coalesce("a_content_hash", F.lit(""))) & ~F.coalesce("d_oversized", F.lit(False))
    changed = hash_changed | ~F.col("d_size_bytes").eqNullSafe(F.col("a_size_bytes")) | ~F.col("d_mtime_ms").eqNullSafe(F.col("a_mtime_ms")) | ~F.col("d_kind").eqNullSafe(F.col("a_kind"))
    own = F.lit(True) if source is None else F.coalesce(F.col("source_id") == source, F.lit(False))
    action = F.when(F.col("known").isNull(), "insert").when(F.col("on_disk").isNull(), F.when(own, "delete").otherwise("skip")).when(changed, "update").otherwise("skip")
    can = F.coalesce(extractable(F.col("d_kind"), F.col("d_oversized")), F.lit(False))
    fresh = F.col("known").isNull() | hash_changed
    status = F.when(~action.isin("insert", "update"), F.col("before")).when(~can, "skipped").when(fresh, "pending").when(F.col("before").isin("done", "failed"), F.col("before")).otherwise("pending")
    return d.join(a, "path", "full_outer").select("path", action.alias("action"), status.alias("status"), F.coalesce(action.isin("insert", "update") & can & fresh, F.lit(False)).alias("enqueue"))


def follow_ups(done: DataFrame, langs: list[str]) -> DataFrame:
    """(asset_id, job, lang): what follows the reading of files (asset_id, kind, units): sound is transcribed; what has units is embedded and
    translated, once per language."""
    job = lambda name, lang=None: F.struct(F.lit(name).alias("job"), F.lit(lang).cast("string").alias("lang"))
    none = F.array().cast("array<struct<job:string,lang:string>>")
    jobs = F.concat(F.when(F.col("kind").isin("audio", "video"), F.array(job("transcribe"))).otherwise(none), F.when(F.col("units") > 0, F.array(job("embed"), *[job("translate", x) for x in langs])).otherwise(none))
    return done.select("asset_id", F.inline(jobs)).distinct()


def persist_units(units: DataFrame, results: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, entries): the units after files were read again (results: asset_id, id, ordinal, unit_type, title, text, ...), and what
    the change log takes up: a removal of each unit that was there, an upsert of each that is, numbered on from the log's last version.

    Files without a result keep their units. Versions run over removals first, then upserts, by unit id.
    """
    again = results.select("asset_id").distinct()
    gone = units.join(again, "asset_id", "left_semi").select(F.col("id").alias("unit_id")).distinct()
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c) if c in ("title", "text") else F.col(c)
    fresh = results.select(*[blank(c) for c in units.columns])
    return units.join(again, "asset_id", "left_anti").unionByName(fresh), entries(log, gone, fresh.select(F.col("id").alias("unit_id")).distinct())


def persist_transcripts(units: DataFrame, windows: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, entries): frame units from transcript windows (asset_id, window_no, start_ms, end_ms, text) in the place of a file's earlier
    transcript units (those with meta 'transcript'); ordinals run on from the number of its other units."""
    again = windows.select("asset_id").distinct()
    old = F.coalesce(F.col("meta") == "transcript", F.lit(False))
    gone = units.filter(old).join(again, "asset_id", "left_semi").select(F.col("id").alias("unit_id")).distinct()
    kept = units.join(gone.withColumnRenamed("unit_id", "id"), "id", "left_anti")
    base = kept.groupBy("asset_id").agg(F.count_distinct("id").alias("base"))
    made = windows.join(base, "asset_id", "left").withColumn("ordinal", (F.coalesce("base", F.lit(0)) + F.col("window_no")).cast("int"))
    values = {"id": F.concat_ws("/", "asset_id", F.col("ordinal").cast("string")), "unit_type": F.lit("frame"), "title": timecode(F.col("start_ms")), "meta": F.lit("transcript"), "hidden": F.lit(False)}
    fresh = made.select(*[(values[c] if c in values else F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in units.dtypes])
    return kept.unionByName(fresh), entries(log, gone, fresh.select(F.col("id").alias("unit_id")))


def entries(log: DataFrame, removed: DataFrame, upserted: DataFrame) -> DataFrame:
    """(version, op, unit_id): log entries numbered on from the log's last version. Numbers are given by range: units are sorted once, each
    task counts its own, and the counts of the tasks before are added."""
    rows = removed.select(F.lit(0).alias("turn"), F.lit("remove").alias("op"), "unit_id").unionByName(upserted.select(F.lit(1).alias("turn"), F.lit("upsert").alias("op"), "unit_id"))
    parted = cut_lineage(rows.orderBy("turn", "unit_id").withColumn("part", F.spark_partition_id()))
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per task
    own = F.row_number().over(W.partitionBy("part").orderBy("turn", "unit_id"))
    return parted.withColumn("own", own).join(F.broadcast(before), "part").crossJoin(F.broadcast(current_version(log).withColumnRenamed("version", "last"))).select((F.col("last") + F.col("before") + F.col("own")).cast("long").alias("version"), "op", "unit_id")


def last_ops(log: DataFrame, since: int = 0) -> DataFrame:
    """(unit_id, op, version): the last operation on each unit after `since`; hot units are combined before the shuffle."""
    return log.filter(F.col("version") > since).groupBy("unit_id").agg(F.max_by("op", "version").alias("op"), F.max("version").alias("version"))


def delta(log: DataFrame, units: DataFrame, assets: DataFrame, since: int) -> DataFrame:
    """(unit_id, op, asset_id, title, dir_path): what changed after a version; an upsert of a unit that is gone is a removal."""
    u = bundle(units, assets).select("unit_id", "asset_id", "title", "dir_path", F.lit(True).alias("there"))
    rows = last_ops(log, since).join(u, "unit_id", "left")
    op = F.when((F.col("op") == "upsert") & F.col("there"), "upsert").otherwise("remove")
    keep = lambda c: F.when(op == "upsert", F.col(c)).alias(c)
    return rows.select("unit_id", op.alias("op"), keep("asset_id"), keep("title"), keep("dir_path"))


def bundle(units: DataFrame, assets: DataFrame) -> DataFrame:
    """Every unit with its file: the full snapshot."""
    a = assets.select(F.col("id").alias("asset_id"), "path", "kind", "mtime_ms").distinct()
    u = units.select(F.col("id").alias("unit_id"), "asset_id", "ordinal", "unit_type", "title", "text", F.col("thumb_path").isNotNull().alias("has_thumb"), "hidden").distinct()
    return u.join(a, "asset_id").withColumns({"file_name": F.substring_index("path", "/", -1), "dir_path": dirname(F.col("path"))})


def current_version(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def fenced(results: DataFrame, assets: DataFrame) -> DataFrame:
    """Results whose content_hash is still the file's; the rest were made from older content."""
    now = assets.select(F.col("id").alias("asset_id"), "content_hash").distinct()
    return results.join(now, ["asset_id", "content_hash"], "left_semi")


def new_jobs(wanted: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted jobs that aren't pending already, each key once."""
    return wanted.dropDuplicates(keys).join(pending.select(*keys), keys, "left_anti")


def linkage(postings_units: DataFrame, units: DataFrame) -> DataFrame:
    """(units, linked, consistent) of an index against the table it was made from."""
    u = units.select(F.col("id").alias("unit_id")).distinct()
    linked = u.join(postings_units.select("unit_id").distinct(), "unit_id", "left_semi").agg(F.count("*").alias("linked"))
    return u.agg(F.count("*").alias("units")).crossJoin(linked).withColumn("consistent", F.col("units") == F.col("linked"))


def source_counts(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, root_path, asset_count, done_count): sources with their files, those without any at zero."""
    per = assets.select("id", "source_id", "extraction_status").distinct().groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("asset_count"), F.count_if(F.col("extraction_status") == "done").alias("done_count"))
    return sources.select("id", "root_path").join(per, "id", "left").fillna(0, ["asset_count", "done_count"])


def closure(start: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node) reachable from start over edges (src, dst), start included: joins to a fixpoint, lineage cut each round."""
    seen = cut_lineage(start.select("node").distinct())
    front = seen
    for _ in range(rounds):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut_lineage(step)
        if front.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(front))
    raise RuntimeError(f"no fixpoint within {rounds} rounds")
