"""Problem 5: lines repeated across the documents of one source.

Two passes. The first keeps, per partition and source, a summary of heavy hitters (Misra-Gries) and merges the summaries, in which
no line above the bar can be missing. The second counts the candidates exactly, over distinct assets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut_lineage, spread

#: Folders of merging: summaries meet in this many groups per source before the last merge, so that no task gets those of all partitions.
FAN_IN = 32
#: Candidates, with their source, up to which the confirmed lines are broadcast (about 40 bytes each); beyond, the joins shuffle.
BROADCAST_ROWS = 500_000


def line_key(line: Column) -> Column:
    """What two equal lines agree in: the letters in lower case, as a hash; null for lines without letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def lines_of(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(key, *keep, line_no, line, line_key) of every line, 1-based; null texts have none."""
    split = F.posexplode(F.split(F.col(f"`{text}`"), "\n"))
    return df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in keep], split.alias("line_no", "line")).withColumns({"line_no": (F.col("line_no") + 1).cast("long"), "line_key": line_key(F.col("line"))})


def shrink(counts: pd.Series, k: int) -> pd.Series:
    """A summary of at most k counters: what is over gives up the (k+1)-th largest count, so an item loses at most its share of total/(k+1)."""
    if len(counts) <= k:
        return counts
    cut = np.partition(counts.to_numpy(), len(counts) - k - 1)[len(counts) - k - 1]
    counts = counts - cut
    return counts[counts > 0]


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its checked size allows it; beyond, the join shuffles and adaptive execution splits hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def heavy_hitters(lines: DataFrame, source: str, k: DataFrame) -> DataFrame:
    """(source, line_key) that may stand in more than 1/(k+1) of the source's lines, k per source from the frame (source, k).

    Every line above that share is among them (summaries merge without losing the bound); others may be, too.
    """

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, tuple[pd.Series, int]] = {}
        for f in frames:
            for s, g in f.groupby("source", sort=False):
                k, n = int(g["k"].iloc[0]), g["line_key"].value_counts(sort=False)
                if s in held:
                    n = held[s][0].add(n, fill_value=0)
                held[s] = (shrink(n.astype("int64"), k), k)
        for s, (n, k) in held.items():
            yield pd.DataFrame({"source": s, "line_key": n.index.astype("int64"), "n": n.to_numpy(), "k": k})

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        k = int(f["k"].iloc[0])
        n = shrink(f.groupby("line_key", sort=False)["n"].sum(), k)
        return pd.DataFrame({"source": f["source"].iloc[0], "line_key": n.index, "n": n.to_numpy(), "k": k})

    schema = "source string, line_key long, n long, k long"
    rows = lines.select(F.col(f"`{source}`").alias("source"), "line_key").join(small(k), "source")
    parts = rows.mapInPandas(summarise, schema).withColumn("fold", F.spark_partition_id() % FAN_IN)
    half = parts.groupBy("source", "fold").applyInPandas(lambda f: merge(f.drop(columns="fold")), schema)
    return half.groupBy("source").applyInPandas(merge, schema).select("source", "line_key")


def repeated_lines(df: DataFrame, source: str, asset: str, text: str, share: float = 0.15, least: int = 3) -> DataFrame:
    """(source, line_key, assets) of the lines that stand in at least `share`, and at least `least`, of the assets of their source.

    Rows with a null source or asset belong to no source and have no such lines. A hot source is no special case: its lines are
    counted by (source, line), pre-aggregated before the shuffle.
    """
    df = df.filter(F.col(f"`{source}`").isNotNull() & F.col(f"`{asset}`").isNotNull())
    sized = df.groupBy(F.col(f"`{source}`").alias("source"), F.col(f"`{asset}`").alias("asset")).agg(F.sum(F.size(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"))).alias("lines"))
    totals = sized.groupBy("source").agg(F.count("*").alias("assets"), F.sum("lines").alias("lines"))
    totals = cut_lineage(totals.withColumn("bar", F.greatest(F.ceil(F.col("assets") * share - 1e-9), F.lit(least))))
    lines = lines_of(df, asset, text, [source]).filter(F.col("line_key").isNotNull())
    k = totals.select("source", (F.ceil(F.col("lines") / F.col("bar")) + 1).alias("k"))
    candidates = heavy_hitters(lines, source, k)
    exact = lines.select(F.col(f"`{source}`").alias("source"), F.col(f"`{asset}`").alias("asset"), "line_key").join(candidates, ["source", "line_key"], "left_semi")
    counts = exact.distinct().groupBy("source", "line_key").agg(F.count("*").alias("assets"))
    return counts.join(small(totals.select("source", "bar")), "source").filter(F.col("assets") >= F.col("bar")).select("source", "line_key", "assets")



def find_repeated(df: DataFrame, key: str, source: str, asset: str, text: str, share: float = 0.15, least: int = 3) -> DataFrame:
    """(key, line_no) of every repeated line; a redelivered row counts once."""
    df = spread(df)
    confirmed = small(cut_lineage(repeated_lines(df, source, asset, text, share, least)))
    lines = lines_of(df, key, text, [source]).withColumnRenamed(source, "source")
    return lines.join(confirmed, ["source", "line_key"], "left_semi").select(F.col(f"`{key}`"), "line_no").distinct()


def remove_repeated(df: DataFrame, key: str, source: str, asset: str, text: str, share: float = 0.15, least: int = 3) -> DataFrame:
    """df with `clean_text`, the text without its repeated lines, and `removed`, their number.

    Null texts stay null; a text of which every line is repeated becomes empty; the order of the other lines is kept.
    """
    df = spread(df)
    confirmed = cut_lineage(repeated_lines(df, source, asset, text, share, least))
    if confirmed.count() > BROADCAST_ROWS:
        return _remove_by_row(df, source, text, confirmed)
    sets: dict[str, set[int]] = {}
    for r in confirmed.collect():  # at most BROADCAST_ROWS
        sets.setdefault(r["source"], set()).add(r["line_key"])
    sent, names = df.sparkSession.sparkContext.broadcast(sets), [*df.columns, "clean_text", "removed"]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, texts, keys = (c.to_pylist() for c in batch.columns[-3:])
            out, removed = [], []
            for s, t, ks in zip(sources, texts, keys, strict=True):
                gone = sent.value.get(s)
                kept = t if t is None or not gone or gone.isdisjoint(ks) else [x for x, k in zip(t.split("\n"), ks, strict=True) if k not in gone]
                removed.append(0 if kept is t else len(ks) - len(kept))
                out.append(kept if kept is t else "\n".join(kept))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string()), pa.array(removed, pa.int32())], names=names)

    asked = df.select("*", F.col(f"`{source}`").cast("string"), F.col(f"`{text}`"), F.transform(F.split(F.col(f"`{text}`"), "\n"), line_key)).toDF(*(f"c{i}" for i in range(len(df.columns) + 3)))
    return asked.mapInArrow(clean, T.StructType([*df.schema.fields, T.StructField("clean_text", T.StringType()), T.StructField("removed", T.IntegerType())]))


def _remove_by_row(df: DataFrame, source: str, text: str, confirmed: DataFrame) -> DataFrame:
    """remove_repeated() by joins on (source, line): rows are numbered, their repeated lines found and brought back to them by number."""
    numbered = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    lines = numbered.select("_row", F.col(f"`{source}`").alias("source"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("_at", "_line")).withColumn("line_key", line_key(F.col("_line"))).filter("line_key IS NOT NULL")
    gone = lines.join(confirmed, ["source", "line_key"], "left_semi").groupBy("_row").agg(F.collect_set("_at").alias("_gone"))  # lines of one text
    split = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(split, lambda x, i: ~F.coalesce(F.array_contains(F.col("_gone"), i), F.lit(False)))
    out = numbered.join(gone, "_row", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.array_join(kept, "\n").alias("clean_text"), F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(split) - F.size(kept)).alias("removed"))
