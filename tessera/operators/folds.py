"""Ordered folds: results that depend on what came before, as aggregates over sorted arrays or pandas groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transcript_windows(segments: DataFrame, key: str, start: str, end: str, text: str, width_ms: int = 30_000) -> DataFrame:
    """(key, window_no, start_ms, end_ms, text): segments in order, gathered greedily from a window's start until it spans the width.

    A segment that begins at or after the width opens a new window. Blank texts are dropped. One file's segments make one array, folded
    once from end to end.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, segs in zip(f["k"], f["segs"], strict=True):
                no, opened, last, parts = 0, None, None, []
                for x in segs:
                    if opened is not None and (x["s"] is None or x["s"] - opened >= width_ms):
                        out.append((k, no, opened, last, " ".join(parts)))
                        opened = None
                    if opened is None:
                        no, opened, last, parts = no + 1, x["s"], x["e"], []
                    last = max((y for y in (last, x["e"]) if y is not None), default=None)
                    parts.append(x["t"])
                if parts:
                    out.append((k, no, opened, last, " ".join(parts)))
            yield pd.DataFrame(out, columns=[key, "window_no", "start_ms", "end_ms", "text"])

    rows = segments.filter((F.trim(F.coalesce(text, F.lit(""))) != "") & F.col(start).isNotNull())
    grouped = rows.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.trim(text).alias("t")))).alias("segs"))
    return grouped.mapInPandas(fold, f"`{key}` {dict(segments.dtypes)[key]}, window_no int, start_ms long, end_ms long, text string")


def batches(items: DataFrame, group: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """(group, order, batch_no): items in order, greedily in batches of at most `most` items and `budget` size, one at least."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, xs in zip(f["g"], f["xs"], strict=True):
                batch, n, total = 1, 0, 0
                for x in xs:
                    if n and (n >= most or total + x["s"] > budget):
                        batch, n, total = batch + 1, 0, 0
                    n, total = n + 1, total + x["s"]
                    out.append((g, x["o"], batch))
            yield pd.DataFrame(out, columns=[group, order, "batch_no"])

    types = dict(items.dtypes)
    rows = items.groupBy(F.col(group).alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("s")))).alias("xs"))
    return rows.mapInPandas(fold, f"`{group}` {types[group]}, `{order}` {types[order]}, batch_no long")


def accepted_entries(entries: DataFrame, archive: str, order: str, size: str, max_entries: int, max_bytes: int) -> DataFrame:
    """(archive, order, accepted): entries in order; one that would exceed the count or the bytes is passed over and uses up neither.

    Rows come sorted by archive and place, and a task folds them as they pass: no archive is held as one array.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, total = object(), 0, 0
        for f in frames:
            accepted = []
            for a, b in zip(f[archive], f["_size"], strict=True):
                if a != now:
                    now, n, total = a, 0, 0
                ok = n < max_entries and total + b <= max_bytes
                n, total = n + ok, total + (b if ok else 0)
                accepted.append(ok)
            yield pd.DataFrame({archive: f[archive], order: f[order], "accepted": accepted})

    rows = entries.select(archive, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")).repartition(archive).sortWithinPartitions(archive, order)
    kinds = dict(entries.dtypes)
    return rows.mapInPandas(fold, f"`{archive}` {kinds[archive]}, `{order}` {kinds[order]}, accepted boolean")


def debounce(events: list[int], quiet: int, cap: int) -> list[tuple[int, int, int]]:
    """(first, fired, number) of the bursts of sorted times: fires after `quiet` without an event, `cap` after the first at the latest."""
    out, first, last, n = [], None, None, 0
    for t in events:
        if first is not None and t >= min(last + quiet, first + cap):
            out.append((first, min(last + quiet, first + cap), n))
            first, n = None, 0
        if first is None:
            first = t
        last, n = t, n + 1
    if first is not None:
        out.append((first, min(last + quiet, first + cap), n))
    return out


def debounced(events: DataFrame, source: str, ts_ms: str, quiet: int = 2000, cap: int = 5000, day_ms: int = 86_400_000) -> DataFrame:
    """(source, first_ms, fired_ms, events): the rescans that a source's events set off. Batch twin of the streaming operator.

    No burst spans a gap of `cap`. Gaps are found within (source, day), and between days from their first and last events; the stretches
    between gaps are then folded by (source, day of their start). So a source with a third of all events is spread over its days.
    """
    e = events.filter(F.col(ts_ms).isNotNull()).select(F.col(source).alias("s"), F.col(ts_ms).cast("long").alias("t")).withColumn("day", F.floor(F.col("t") / day_ms))
    days = e.groupBy("s", "day").agg(F.max("t").alias("last")).withColumn("before", F.lag("last").over(W.partitionBy("s").orderBy("day"))).select("s", "day", "before")
    inside = F.lag("t").over(W.partitionBy("s", "day").orderBy("t"))
    e = e.join(days, ["s", "day"]).withColumn("opens", F.coalesce(F.col("t") - F.coalesce(inside, "before") >= cap, F.lit(True)))
    own = F.max(F.when(F.col("opens"), F.col("t"))).over(W.partitionBy("s", "day").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    opened = e.filter("opens").groupBy("s", "day").agg(F.max("t").alias("opened"))
    carried = e.select("s", "day").distinct().join(opened, ["s", "day"], "left").withColumn("carried", F.last("opened", ignorenulls=True).over(W.partitionBy("s").orderBy("day").rowsBetween(W.unboundedPreceding, -1))).select("s", "day", "carried")
    e = e.withColumn("own", own).join(carried, ["s", "day"]).select("s", "t", F.floor(F.coalesce("own", "carried") / day_ms).alias("start"))
    grouped = e.groupBy("s", "start").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, *b) for s, ts in zip(f["s"], f["ts"], strict=True) for b in debounce([int(t) for t in ts], quiet, cap)]
            yield pd.DataFrame(rows, columns=[source, "first_ms", "fired_ms", "events"])

    return grouped.select("s", "ts").mapInPandas(fold, f"`{source}` {dict(events.dtypes)[source]}, first_ms long, fired_ms long, events long")


def interleave(originals: DataFrame, translations: DataFrame, limit: int = 20) -> DataFrame:
    """(unit_id, asset_id, slot): suggestions from two ranked legs (unit_id, asset_id, rank0), taken o0 t0 o1 o2 t1 o3 o4 t2 …; a unit
    once, and the first three from different files. The legs hold at most 20 and 10 rows."""
    r = F.col("rank0")
    slots = originals.select("unit_id", "asset_id", (r + F.ceil(r / 2)).cast("long").alias("slot")).unionByName(translations.select("unit_id", "asset_id", (3 * r + 1).cast("long").alias("slot")))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames))
        seen, files, out = set(), set(), []
        for u, a, _ in f.sort_values(["slot", "unit_id"]).itertuples(index=False):
            if u in seen or (len(out) < 3 and a in files):
                continue
            seen.add(u)
            files.add(a)
            out.append((u, a, len(out)))
            if len(out) == limit:
                break
        yield pd.DataFrame(out, columns=["unit_id", "asset_id", "slot"])

    return slots.coalesce(1).mapInPandas(pick, "unit_id string, asset_id string, slot long")


# Characters that end a completion.
CUTS = frozenset(" \t，。、；：？！…—·,.;:?!()（）[]【】<>《》\"'`\n\r")


def completions_of(query: str, text: str | None, hits: int = 4, ahead: int = 12, longest: int = 24) -> list[str]:
    """The stretches of a text that begin with the query and go on to the next cut character.

    White space counts neither in the query nor in the text when they are matched; the stretch is that of the text as it stands, longer than
    the query and of at most `longest` characters. Up to `hits` places, none overlapping, count.
    """
    asked = query.strip().lower()
    bare = "".join(asked.split())
    if not bare or not text:
        return []
    places = [i for i, c in enumerate(text) if not c.isspace()]
    low = [text[i].lower() for i in places]
    at = [p for p, c in zip(places, low, strict=True) for _ in c]  # a letter may become two in lower case
    squeezed, out, start = "".join(low), [], 0
    for _ in range(hits):
        i = squeezed.find(bare, start)
        if i < 0:
            break
        start = i + len(bare)
        first = at[i]
        end = first + len(asked)
        while end < min(len(text), first + len(asked) + ahead) and text[end] not in CUTS:
            end += 1
        phrase = text[first:end].strip()
        if len(asked) < len(phrase) <= longest:
            out.append(phrase)
    return out


def completions(texts: DataFrame, text: str, query: str, most: int = 8) -> DataFrame:
    """(phrase, n): the most frequent continuations, ties by length, then by phrase. Matching texts are found in the JVM."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"phrase": [p for t in f["t"] for p in completions_of(query, t)]}, dtype=object)

    some = texts.select(F.col(text).alias("t")).filter(F.contains(F.lower(F.regexp_replace("t", r"\s+", "")), F.lit("".join(query.lower().split()))))
    return some.mapInPandas(find, "phrase string").groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.length("phrase"), "phrase").limit(most)


def regroup(segments: DataFrame, key: str) -> DataFrame:
    """(key, title, text) from rows (key, field, value): fields back in their places; what is missing stays null."""
    return segments.groupBy(key).agg(F.max(F.when(F.col("field") == "title", F.col("value"))).alias("title"), F.max(F.when(F.col("field") == "text", F.col("value"))).alias("text"))


def context_block(hits: DataFrame, order: str, head: str, body: str, cap: int, most: int) -> DataFrame:
    """(context): the first `most` hits, numbered, each with up to `cap` characters."""
    cut = hits.orderBy(order).limit(most).withColumn("x", F.struct(F.col(order).alias("o"), F.concat(F.coalesce(head, F.lit("")), F.lit("\n"), F.left(F.coalesce(body, F.lit("")), F.lit(cap))).alias("t")))
    rows = F.array_sort(F.collect_list("x"))
    return cut.agg(F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n\n").alias("context"))

