"""Access levels of files: the nearest entry wins, a user's before a group's, denial before write before read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import dir_chain

LEVELS = {"read": 1, "write": 2, "deny": 3}


def strongest(level: Column) -> Column:
    """The strongest level of a group of entries, as a number; null for no known level."""
    return F.max(F.when(level == "deny", 3).when(level == "write", 2).when(level == "read", 1))


def levels(assets: DataFrame, entries: DataFrame, members: DataFrame, user: str, public_dirs: DataFrame | None = None) -> DataFrame:
    """(asset_id, level) of every file for a user: none, read or write.

    An entry (subject_type, subject_id, target_type, target_id, level) counts when it names the user or a group of theirs. Entries on
    the file come first, then those on the nearest folder that has a counting one; at that place the user's own decide before the groups'.
    Denial ends the search with none. Without any entry, a public file, or one below a public folder, can be read.
    members (user_id, group_id); public_dirs (dir). Entries are shuffled by target, files by folder: no list is sent to the driver.
    """
    groups = members.filter(F.col("user_id") == user).select(F.col("group_id").alias("subject_id")).distinct()
    mine = entries.filter((F.col("subject_type") == "user") & (F.col("subject_id") == user)).select("target_type", "target_id", "level", F.lit(0).alias("tier"))
    theirs = entries.filter(F.col("subject_type") == "group").join(groups, "subject_id", "left_semi").select("target_type", "target_id", "level", F.lit(1).alias("tier"))
    per_place = mine.unionByName(theirs).groupBy("target_type", "target_id", "tier").agg(strongest(F.col("level")).alias("n")).filter("n IS NOT NULL").groupBy("target_type", "target_id").agg(F.min_by("n", "tier").alias("n"))
    files = assets.select(F.col("id").alias("asset_id"), "path", "visibility").distinct()
    own = files.select("asset_id").join(per_place.filter("target_type = 'asset'").select(F.col("target_id").alias("asset_id"), "n"), "asset_id").select("asset_id", F.lit(-1).alias("depth"), "n")
    chain = files.select("asset_id", F.posexplode(dir_chain(F.col("path"))).alias("depth", "dir"))
    above = chain.join(per_place.filter("target_type = 'dir'").select(F.col("target_id").alias("dir"), "n"), "dir").select("asset_id", "depth", "n")
    nearest = own.unionByName(above).groupBy("asset_id").agg(F.min_by("n", "depth").alias("n"))
    out = files.join(nearest, "asset_id", "left")
    public = F.col("visibility") == "public"
    if public_dirs is not None:
        below = chain.join(public_dirs.select("dir").distinct(), "dir", "left_semi").select("asset_id", F.lit(True).alias("below")).distinct()
        out = out.join(below, "asset_id", "left")
        public = public | F.coalesce("below", F.lit(False))
    fallback = F.when(F.coalesce(public, F.lit(False)), "read").otherwise("none")
    return out.select("asset_id", F.when(F.col("n") == 3, "none").when(F.col("n") == 2, "write").when(F.col("n") == 1, "read").otherwise(fallback).alias("level"))


def readable(assets: DataFrame, resolved: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """(asset_id) that the user may read: all for an administrator, what they uploaded, and what their level allows."""
    files = assets.select(F.col("id").alias("asset_id"), "uploaded_by").distinct()
    if admin:
        return files.select("asset_id")
    return files.join(resolved, "asset_id", "left").filter(F.coalesce(F.col("uploaded_by") == user, F.lit(False)) | (F.coalesce("level", F.lit("none")) != "none")).select("asset_id")


def writable(assets: DataFrame, resolved: DataFrame, user: str, admin: bool = False) -> DataFrame:
    files = assets.select(F.col("id").alias("asset_id"), "uploaded_by").distinct()
    if admin:
        return files.select("asset_id")
    return files.join(resolved, "asset_id", "left").filter(F.coalesce(F.col("uploaded_by") == user, F.lit(False)) | (F.col("level") == "write")).select("asset_id")
