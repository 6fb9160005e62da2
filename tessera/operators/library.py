"""The library of files: folder trees, listings, counts, renames, neighbours, uploads and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import dir_chain, dirname

SORTS = {"uploaded": "uploaded_at", "mtime": "mtime_ms", "size": "size_bytes", "name": "file_name"}


def folder_tree(assets: DataFrame, extra_dirs: DataFrame | None = None) -> DataFrame:
    """(dir, parent, name, direct, below): every folder on some file's path, with the files in it and those in it or below.

    Each file adds one row per folder above it, pre-aggregated before the shuffle. The root is the empty dir, with a null parent.
    """
    files = assets.select("id", "path").distinct()
    per = files.select(F.posexplode(dir_chain(F.col("path"))).alias("depth", "dir")).groupBy("dir").agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count("*").alias("below"))
    if extra_dirs is not None:
        per = per.unionByName(extra_dirs.select("dir", F.lit(0).cast("long").alias("direct"), F.lit(0).cast("long").alias("below"))).groupBy("dir").agg(F.sum("direct").alias("direct"), F.sum("below").alias("below"))
    return per.select("dir", F.when(F.col("dir") != "", dirname(F.col("dir"))).alias("parent"), F.substring_index("dir", "/", -1).alias("name"), "direct", "below")


def children(tree: DataFrame) -> DataFrame:
    """(dir, child, child_files) of folders directly within another."""
    return tree.select(F.col("dir").alias("child"), F.col("parent").alias("dir"), F.col("below").alias("child_files")).join(tree.select("dir"), "dir").select("dir", "child", "child_files")


def listing(assets: DataFrame, group: str | None = None, kind: str | None = None, q: str | None = None, sort: str = "uploaded", descending: bool = True, page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(page of files, total): filters, a total order with ties by id, and a page. A missing upload time falls back to the extraction's."""
    rows = assets.distinct().withColumns({"uploaded_at": F.coalesce("uploaded_at", "extracted_at"), "file_name": F.substring_index("path", "/", -1)})
    if group == "ungrouped":
        rows = rows.filter(~F.col("path").contains("/"))
    elif group:
        rows = rows.filter(F.col("path").startswith(group.rstrip("/") + "/"))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if q:
        rows = rows.filter(F.contains(F.lower("path"), F.lit(q.lower())) | F.contains(F.lower("kind"), F.lit(q.lower())))
    size = max(1, min(size, 200))
    c = F.col(SORTS.get(sort, "uploaded_at"))
    cut = rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "id").offset((max(page, 1) - 1) * size).limit(size)
    return cut, rows.agg(F.count("*").alias("total"))


def renamed(assets: DataFrame, old: str, new: str) -> DataFrame:
    """assets with the folder `old` renamed, itself and below: a prefix of whole segments."""
    inside = F.col("path").startswith(old.rstrip("/") + "/")
    return assets.withColumn("path", F.when(inside, F.concat(F.lit(new.rstrip("/")), F.substr(F.col("path"), F.lit(len(old.rstrip("/")) + 1)))).otherwise(F.col("path")))


def neighbours(units: DataFrame, wanted: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(asked, unit_id, ordinal, offset): the units of the same file within `before` and `after` places of each wanted unit (id)."""
    u = units.select(F.col("id").alias("unit_id"), "asset_id", "ordinal").distinct()
    asked = u.join(wanted.select(F.col("id").alias("unit_id")).distinct(), "unit_id", "left_semi").select(F.col("unit_id").alias("asked"), "asset_id", F.col("ordinal").alias("at"))
    # The ordinals asked for are spelled out and met by equality: a file with many units costs no more than its neighbours do.
    places = asked.select("asked", "asset_id", "at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - before), F.greatest(F.lit(1), F.col("at") + after))).alias("ordinal"))
    return u.join(places, ["asset_id", "ordinal"]).select("asked", "unit_id", "ordinal", (F.col("ordinal") - F.col("at")).alias("offset"))


def without_embedding(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """(unit_id) of the units with text that have no vector."""
    rows = units.filter(F.coalesce("text", F.lit("")) != "").select(F.col("id").alias("unit_id")).distinct()
    return rows.join(vectors.select("unit_id"), "unit_id", "left_anti")


def without_translation(units: DataFrame, translations: DataFrame, lang: str) -> DataFrame:
    """(unit_id) of the units with text or title that have no translation into lang."""
    rows = units.filter((F.coalesce("text", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != "")).select(F.col("id").alias("unit_id")).distinct()
    return rows.join(translations.filter(F.col("lang") == lang).select("unit_id"), "unit_id", "left_anti")


def translation_status(units: DataFrame, translations: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, total, ok, skipped, done, missing, complete) of each language."""
    spark = units.sparkSession
    total = units.filter((F.coalesce("text", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != "")).agg(F.count_distinct("id").alias("total"))
    per = translations.select("unit_id", "lang", "status").distinct().filter(F.col("lang").isin(*langs)).groupBy("lang").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    all_ = spark.createDataFrame([(x,) for x in langs], "lang string").join(per, "lang", "left").fillna(0, ["ok", "skipped"]).crossJoin(F.broadcast(total))
    done = F.least("total", F.col("ok") + F.col("skipped"))
    return all_.select("lang", "total", "ok", "skipped", done.alias("done"), (F.col("total") - done).alias("missing"), (done >= F.col("total")).alias("complete"))


def preflight(uploads: DataFrame, assets: DataFrame) -> DataFrame:
    """(pos, path, verdict): error for a missing name, same-hash, same-name or ok, in this order of precedence. uploads (pos, path, hash)."""
    by_path = assets.select("path", F.lit(True).alias("p")).distinct()
    by_hash = assets.filter("content_hash IS NOT NULL").select(F.col("content_hash").alias("hash"), F.lit(True).alias("h")).distinct()
    rows = uploads.join(by_path, "path", "left").join(by_hash, "hash", "left")
    return rows.select("pos", "path", F.when(F.coalesce("path", F.lit("")) == "", "error").when(F.col("h"), "same-hash").when(F.col("p"), "same-name").otherwise("ok").alias("verdict"))


def embedding_coverage(units: DataFrame, vectors: DataFrame) -> DataFrame:
    return units.agg(F.count_distinct("id").alias("units")).crossJoin(vectors.agg(F.count_distinct("unit_id").alias("vectors")))


def purge(tables: dict[str, DataFrame], asset_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given files (asset_id), children included: anti-joins only."""
    gone = asset_ids.select("asset_id").distinct()
    out = {}
    for name, t in tables.items():
        key = "id" if name == "assets" else "asset_id"
        out[name] = t.join(gone.withColumnRenamed("asset_id", key), key, "left_anti")
    return out


def replace_by_key(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of fresh take the place of those with the same key."""
    return current.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def first_prefix(records: DataFrame, metas: DataFrame, path: str = "path") -> DataFrame:
    """records with the metadata of the first prefix (pos, prefix, meta) that their path starts with, or null. Any string is a prefix.

    Prefixes are matched by equality: each path is cut to the lengths that prefixes have, so no pair of record and prefix is formed in vain.
    """
    lengths = metas.agg(F.coalesce(F.sort_array(F.collect_set(F.length("prefix"))), F.array().cast("array<int>")).alias("_lengths"))  # as many as lengths, not as prefixes
    cut = records.select(path).distinct().crossJoin(F.broadcast(lengths)).select(path, F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length(path)), lambda n: F.struct(F.left(F.col(path), n).alias("prefix")))).alias("x"))
    hits = cut.select(path, F.col("x.prefix").alias("prefix")).join(metas, "prefix").groupBy(path).agg(F.min_by("meta", "pos").alias("meta"))
    return records.join(hits, path, "left")


def overview(assets: DataFrame, units: DataFrame, length: int = 300) -> DataFrame:
    """(asset_id, unit_id, ordinal, title, text_preview) of the units of files."""
    u = units.select(F.col("id").alias("unit_id"), "asset_id", "ordinal", "title", F.left(F.coalesce("text", F.lit("")), F.lit(length)).alias("text_preview")).distinct()
    return u.join(assets.select(F.col("id").alias("asset_id")).distinct(), "asset_id", "left_semi")


def newest(jobs: DataFrame, by: str, time: str) -> DataFrame:
    """The newest row of each group, of equal times the largest."""
    rest = [c for c in jobs.columns if c != by]
    return jobs.groupBy(by).agg(F.max(F.struct(F.col(time).alias("_t"), *rest)).alias("x")).select(by, *[F.col(f"x.{c}").alias(c) for c in rest])


def export_plan(selection: DataFrame) -> DataFrame:
    """(asset_id, first_pos, ordinals, units) of a selection of units (pos, asset_id, ordinal): a row per file, its ordinals in the order of
    selection; ordered by first_pos, files come in the order in which they were first chosen."""
    chosen = F.sort_array(F.collect_list(F.struct("pos", "ordinal")))  # the units of one file
    grouped = selection.groupBy("asset_id").agg(F.min("pos").alias("first_pos"), chosen.alias("x"))
    return grouped.select("asset_id", "first_pos", F.array_join(F.transform("x", lambda e: e["ordinal"].cast("string")), ",").alias("ordinals"), F.size("x").cast("long").alias("units"))


def permission_names(entries: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Access entries with the name of the user or group they are for; null for one that is gone. users and groups (id, name)."""
    names = users.select(F.lit("user").alias("subject_type"), F.col("id").alias("subject_id"), "name").unionByName(groups.select(F.lit("group").alias("subject_type"), F.col("id").alias("subject_id"), "name")).distinct()
    return entries.join(names, ["subject_type", "subject_id"], "left")


def put_permissions(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after changes by (subject_type, subject_id, target_type, target_id): a null level takes one out, others take its place."""
    return replace_by_key(entries, changes, ["subject_type", "subject_id", "target_type", "target_id"]).filter("level IS NOT NULL")


def contains_ci(c: Column, q: str) -> Column:
    return F.contains(F.lower(c), F.lit(q.lower()))
