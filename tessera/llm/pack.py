"""Problem 9: fill containers of one capacity with items of varying length.

Only the number of items of each size matters for the plan, and sizes are at most the capacity: the plan is made from a histogram of
bounded length, and places equal containers as one run, whatever the number of items. It first fixes containers that provably dominate all others (the reduction of Martello
and Toth), then places what is left by best fit, largest first. Items take their places by their rank within their size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.encode import PATTERN, TOKENIZERS
from tessera.session import cut_lineage, spread

#: Items per group in which ranks are counted, about, so that a size that a third of all items have doesn't meet in one task; least groups.
SALTED, LEAST_SALTS = 1 << 20, 16


@lru_cache(2)
def _tiktoken(folder: str, name: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, size): the number of tokens of every text; 0 for null and empty ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _tiktoken(folder, name)
        for batch in batches:
            sizes = [len(e.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "size"])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(count, f"`{key}` {dict(df.dtypes)[key]}, size long")


@dataclass
class Run:
    """Items of one size, by rank from `first` on, `per` of them to each container from `container` on."""

    size: int
    first: int
    n: int
    per: int
    container: int


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix containers that some optimal solution has, taking their items out of count; (sizes, number of such containers) each.

    For an item j, largest first: alone, when nothing fits beside it; with the largest item i that fits, when the two fill the container
    exactly, when no second one would fit beside j, or when no two others that fit beside j (three never do) hold more than i; with i and
    the largest item that fits beside both, when three never fit beside j and no two that are larger than the latter do.
    Each such choice dominates every other container with j: its other items can be swapped for those of the choice without loss.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1]:
            while count[j]:
                count[j] -= 1  # j itself is not its own partner
                sizes = np.flatnonzero(count)
                room = capacity - j
                fits = sizes[sizes <= room]
                count[j] += 1
                if not len(fits):
                    n = int(count[j]) if 2 * j > capacity else 1
                    fixed.append(((int(j),), n))
                    count[j] -= n
                    changed = True
                    continue
                i = int(fits[-1])
                least = int(fits[0])
                second = least if count[least] - (least == j) > 1 else int(fits[1]) if len(fits) > 1 else None
                ok = i == room or second is None or least + second > room
                if not ok:
                    third = least if count[least] - (least == j) > 2 else second
                    if least + second + third > room:  # at most two fit beside j (a bound from below on any three)
                        ok = i >= _best_pair(count, fits, room, int(j))
                        if not ok and (b := _beside(count, fits, room, int(j), i)):
                            three = (int(j), i, b)
                            n = min(int(count[s]) // three.count(s) for s in three)  # stays dominant while there are such items
                            fixed.append((three, n))
                            for s in three:
                                count[s] -= n
                            changed = True
                            continue
                if not ok:
                    break
                # Taking items away leaves fewer others to fit beside j, so the pair dominates as long as there is one.
                n = int(count[j] // 2) if i == j else int(min(count[j], count[i]))
                fixed.append(((int(j), i), n))
                count[j] -= n
                count[i] -= n
                changed = True
    return fixed


def _best_pair(count: np.ndarray, fits: np.ndarray, room: int, j: int) -> int:
    best, lo, hi = 0, 0, len(fits) - 1
    while lo <= hi:
        a, b = int(fits[lo]), int(fits[hi])
        if a + b > room:
            hi -= 1
            continue
        if lo != hi or count[a] - (a == j) > 1:
            best = max(best, a + b)
        lo += 1
    return best


def _beside(count: np.ndarray, fits: np.ndarray, room: int, j: int, i: int) -> int | None:
    """The largest item that fits beside j and i, when no two others that are larger than it fit beside j."""
    free = lambda s: int(count[s]) - (s == j) - (s == i)
    b = next((int(s) for s in fits[fits <= room - i][::-1] if free(int(s)) > 0), None)
    if b is None:
        return None
    larger = [int(s) for s in fits[fits > b] if free(int(s)) > 0][:2]
    two = 2 * larger[0] if larger and free(larger[0]) > 1 else sum(larger) if len(larger) == 2 else None
    return b if two is None or two > room else None


def best_fit(count: np.ndarray, capacity: int, taken: np.ndarray, container: int) -> tuple[list[Run], int]:
    """Best fit, largest first, of all items in count: each goes where the least room is left. Equal containers are handled as one."""
    runs: list[Run] = []
    room: dict[int, list[list[int]]] = {}  # room left -> stretches [first container, number]
    for s in np.flatnonzero(count)[::-1]:
        s, left = int(s), int(count[s])
        for r in sorted(x for x in room if x >= s):
            per = r // s
            stretches, kept = room.pop(r), []
            for first, n in stretches:
                full = min(n, left // per)
                if full:
                    runs.append(Run(s, int(taken[s]), full * per, per, first))
                    taken[s] += full * per
                    left -= full * per
                    room.setdefault(r - per * s, []).append([first, full])
                if full < n and left:  # the last of them, filled in part
                    runs.append(Run(s, int(taken[s]), left, left, first + full))
                    room.setdefault(r - left * s, []).append([first + full, 1])
                    taken[s] += left
                    full, left = full + 1, 0
                if full < n:
                    kept.append([first + full, n - full])
            if kept:
                room.setdefault(r, []).extend(kept)
            if not left:
                break
        if left:
            per = capacity // s
            full, rest = divmod(left, per)
            for n, each in ((full, per), (1, rest)):
                if n and each:
                    runs.append(Run(s, int(taken[s]), n * each, each, container))
                    taken[s] += n * each
                    room.setdefault(capacity - each * s, []).append([container, n])
                    container += n
    return runs, container


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every item of the histogram (sizes 1 to capacity), and the number of containers."""
    count, taken = np.zeros(capacity + 1, dtype=np.int64), np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        count[s] = n
    runs, container = [], 0
    for sizes, n in reduce_dominated(count, capacity):
        for s in dict.fromkeys(sizes):
            per = sizes.count(s)
            runs.append(Run(s, int(taken[s]), n * per, per, container))
            taken[s] += n * per
        container += n
    more, container = best_fit(count, capacity, taken, container)
    return runs + more, container


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start, size, container): every item in a container of the capacity; the sizes in a container never sum to more.

    An item over the capacity is cut into pieces of the capacity and a rest; no other is cut. Items of size 0, or of null size, take no
    room: their container is null. Items with equal keys are items of their own. Ranks within a size follow the key, ties the partition.
    """
    spark: SparkSession = items.sparkSession
    size_of = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0))
    number = F.greatest(F.ceil(size_of / capacity), F.lit(1))
    pieces = items.select(F.col(f"`{key}`"), size_of.alias("_whole"), F.explode(F.sequence(F.lit(1), number)).alias("piece_no")).select(
        F.col(f"`{key}`"), F.col("piece_no").cast("int"), ((F.col("piece_no") - 1) * capacity).alias("start"), F.least(F.col("_whole") - (F.col("piece_no") - 1) * capacity, F.lit(capacity)).alias("size")
    )
    pieces = cut_lineage(pieces)  # the histogram and the placement see the same rows, and sizes are measured once
    histogram = {r["size"]: r["n"] for r in pieces.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most a row per size
    runs, _ = plan(histogram, capacity)
    runs.sort(key=lambda r: (r.size, r.first))
    # Runs are bounded by the capacity, as the histogram is; each task finds an item's run by bisection.
    sent = spark.sparkContext.broadcast(np.array([(r.size, r.first, r.n, r.per, r.container) for r in runs], dtype=np.int64).reshape(-1, 5))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece_no"), F.lit(max(LEAST_SALTS, sum(histogram.values()) // SALTED))).cast("int"))
    counts = pieces.filter("size > 0").groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("_off"))
    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("size", "salt").orderBy(F.col(f"`{key}`"), "piece_no")) - 1)
    # The rows lie by (size, salt) already: only the offsets move for this join.
    ranked = ranked.join(offsets, ["size", "salt"], "left").select(F.col(f"`{key}`"), "piece_no", "start", "size", (F.col("_rank") + F.coalesce("_off", F.lit(0))).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        starts = np.searchsorted(r[:, 0], np.arange(capacity + 2))
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            container = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size[size > 0]):
                own, at = r[starts[s] : starts[s + 1]], np.flatnonzero(size == s)
                run = own[np.searchsorted(own[:, 1], rank[at], side="right") - 1]
                container[at] = run[:, 4] + (rank[at] - run[:, 1]) // run[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container, mask=size <= 0)], names=[key, "piece_no", "start", "size", "container"])

    return ranked.mapInArrow(place, f"`{key}` {dict(items.dtypes)[key]}, piece_no int, start long, size long, container long")
