"""Problem 2: the most similar vectors of every vector, by vantage-point trees per shard.

A routing tree of vantage points, fitted on a bounded sample, parts the unit sphere into shards. Each vector goes to its own shard
and to every shard that the relaxed triangle inequality does not rule out for it, and all vectors of a shard are compared, through a
vantage-point tree that prunes alike. Similarity is symmetric: where an edge parts a pair, one of the two lies within half the radius of it.
Vectors travel as 24-bit fixed-point numbers, as exact as 32-bit floats are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

#: Vectors that the routing tree is fitted on, at most; the tree only routes, every vector is indexed.
SAMPLE = 50_000
#: Vectors of a shard (3 MB, and as much again per copy), shards that there are at least, and vectors of a leaf of a shard's tree. Each
#: doubling of the shards adds about a fifth to the copies of vectors near an edge.
SHARD, LEAST_SHARDS, LEAF = 1 << 14, 16, 256
#: How far the triangle inequality is relaxed: a side is left out when its bound exceeds radius / FACTOR. 1 is exact search.
FACTOR = 8.0


@dataclass
class Node:
    vantage: np.ndarray
    edge: float  # chord distance that parts the inner side from the outer
    inner: "Node | int"
    outer: "Node | int"


def chord(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ v), 0.0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few vectors, the one whose distances to the others vary most."""
    tries = x[rng.choice(len(x), min(8, len(x)), replace=False)]
    some = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    return tries[int(np.argmax(np.sqrt(np.maximum(2.0 - 2.0 * tries @ some.T, 0.0)).std(axis=1)))]


def routing_tree(sample: np.ndarray, depth: int, seed: int = 7) -> Node | int:
    """A tree of 2**depth shards over the sample; shards are numbered in order."""
    rng, number = np.random.default_rng(seed), iter(range(1 << depth))

    def build(x: np.ndarray, d: int) -> Node | int:
        if d == 0:
            return next(number)
        v = _vantage(x, rng) if len(x) else np.eye(1, sample.shape[1], dtype=np.float32)[0]
        dist = chord(x, v)
        edge = float(np.median(dist)) if len(x) else 1.0
        return Node(v, edge, build(x[dist <= edge], d - 1), build(x[dist > edge], d - 1))

    return build(sample, depth)


def route(tree: Node | int, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): the shards of each vector that the relaxed bound leaves."""
    rows, shards = [], []

    def go(node: Node | int, r: np.ndarray) -> None:
        if not len(r):
            return
        if not isinstance(node, Node):
            rows.append(r)
            shards.append(np.full(len(r), node, dtype=np.int32))
            return
        off = chord(x[r], node.vantage) - node.edge
        go(node.inner, r[off <= slack])
        go(node.outer, r[off > -slack])

    go(tree, np.arange(len(x)))
    if not rows:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int32)
    return np.concatenate(rows), np.concatenate(shards)


def search(index: np.ndarray, asked: np.ndarray, min_cos: float, factor: float, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of asked, row of index, cosine) of the pairs at least min_cos similar, through a vantage-point tree over index."""
    rng, radius = np.random.default_rng(seed), np.sqrt(max(0.0, 2.0 - 2.0 * min_cos))
    slack = radius / factor

    def go(ix: np.ndarray, q: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(q) or not len(ix):
            return
        if len(ix) <= LEAF or depth > 24:
            for at in range(0, len(ix), 4096):  # blocks of bounded size, also where equal distances make a leaf large
                some = ix[at : at + 4096]
                for b in range(0, len(q), 4096):
                    part = q[b : b + 4096]
                    s = asked[part] @ index[some].T
                    i, j = np.nonzero(s >= min_cos)
                    if len(i):
                        yield part[i], some[j], s[i, j]
            return
        v = _vantage(index[ix], rng)
        di, dq = chord(index[ix], v), chord(asked[q], v)
        edge = float(np.median(di))
        near = di <= edge
        if near.all():
            edge = float(np.nextafter(np.float32(edge), np.float32(-1)))
            near = di <= edge
        if not near.any():  # all at one distance: no split helps
            depth = 25
            yield from go(ix, q, depth)
            return
        yield from go(ix[near], q[dq <= edge + slack], depth + 1)
        yield from go(ix[~near], q[dq > edge - slack], depth + 1)

    yield from go(np.arange(len(index)), np.arange(len(asked)), 0)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, id, unit): vectors of the given length in 24-bit fixed point, their largest number as 2**23 - 1, in a binary; id is a hash of it.
    Null, all-zero, non-finite and other vectors are set aside."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ok = np.asarray(pa.compute.equal(pa.compute.list_value_length(lists), dim).fill_null(False))
            keys, lists = batch.column(0).filter(pa.array(ok)), lists.filter(pa.array(ok))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            most = np.abs(flat).max(axis=1, initial=0.0)
            good = np.isfinite(most) & (most > 0)
            fixed = np.rint(flat[good] / most[good, None] * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            out = pa.Array.from_buffers(pa.binary(3 * dim), int(good.sum()), [None, pa.py_buffer(fixed)])
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(good)), out.cast(pa.binary())], names=["key", "unit"])

    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{vector}`").cast("array<float>").alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
    return spread(rows).mapInArrow(units, "key string, unit binary").select("key", F.xxhash64("unit").alias("id"), "unit")


def unit_vectors(fixed: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of usable(), of norm one."""
    raw = np.frombuffer(b"".join(fixed.to_pylist()), dtype=np.uint8).reshape(-1, 3)
    four = np.zeros((len(raw), 4), dtype=np.uint8)
    four[:, 1:] = raw
    x = (four.view("<i4").reshape(-1, dim) >> 8).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Best:
    """The k best partners of every row, ties with the k-th included: a row never holds all its pairs."""

    def __init__(self, rows: int, k: int | None):
        self.k, self.held = k, []
        self.bar = np.full(rows, -2.0, dtype=np.float32)
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        keep = c >= self.bar[i]
        self.held.append((i[keep], j[keep], c[keep]))
        self.size += int(keep.sum())
        if self.k and self.size > max(1 << 20, 4 * self.k * len(self.bar)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.array([], np.int64), np.array([], np.int64), np.array([], np.float32)
        i, j, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        if self.k and len(i):
            order = np.lexsort((-c, i))
            i, j, c = i[order], j[order], c[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            count = np.diff(np.r_[first, len(i)])
            full = count >= self.k
            self.bar[i[first[full]]] = c[first[full] + self.k - 1]
            keep = c >= self.bar[i]
            i, j, c = i[keep], j[keep], c[keep]
        self.held, self.size = [(i, j, c)], len(i)
        return i, j, c


def depth_for(n: int, shard: int) -> int:
    """Levels of the routing tree for n vectors."""
    return max(int(np.log2(LEAST_SHARDS)), int(np.ceil(np.log2(max(1, n / shard))))) if n > LEAF else 0


def similar_pairs(vectors: DataFrame, n: int, sample: DataFrame, dim: int, min_cos: float, k: int | None = None, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """(a, b, cos) of vectors (id long, unit binary) at least min_cos similar, a < b, each pair once; with k, of those that are among the k
    most similar of either in some shard. Rows with the same id count once.

    n is about how many vectors there are, sample a frame of some (unit), bounded by the caller, that the routing tree is fitted on.
    factor 1 finds every pair; a larger one trades accuracy for pruning.
    """
    depth = depth_for(n, shard)
    tree = routing_tree(unit_vectors(sample.toArrow().column("unit"), dim), depth) if depth else 0
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * min_cos)))
    # Of a pair that an edge parts, one side lies within half the radius of it; so the two share a shard at any depth, as visitors or not.
    slack = radius / factor / 2

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal vectors leave a partition once, as long as it remembers them
        for batch in batches:
            ids = batch.column(0).to_pylist()
            fresh = []
            for r, i in enumerate(ids):
                if i not in seen:
                    seen.add(i)
                    fresh.append(r)
            if len(seen) > 1_000_000:
                seen.clear()
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            rows, shards = route(tree, unit_vectors(batch.column(1), dim), slack)
            yield pa.RecordBatch.from_arrays([pa.array(shards), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["shard", "id", "unit"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]  # the partition is one shard
        if not whole:
            return
        rows = pa.Table.from_batches(whole)
        ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
        x = unit_vectors(rows.column("unit").take(pa.array(first)), dim)
        best = Best(len(x), k)
        for i, j, c in search(x, x, min_cos, factor):
            apart = i != j
            best.add(i[apart], j[apart], c[apart])
        i, j, c = best.cut()
        pairs, once = np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j), return_index=True)  # most pairs come from both sides
        for at in range(0, len(pairs), 100_000):
            p = pairs[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[p // len(x)]), pa.array(ids[p % len(x)]), pa.array(c[once[at : at + 100_000]])], names=["a", "b", "cos"])

    rows = vectors.select("id", "unit").mapInArrow(routed, "shard int, id long, unit binary").repartitionById(1 << depth, "shard")
    pairs = rows.mapInArrow(found, "a long, b long, cos float")
    return pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))


def nearest(df: DataFrame, key: str, vector: str, dim: int, k: int, min_cos: float, factor: float = FACTOR, sample: int = SAMPLE) -> DataFrame:
    """(key, neighbour, cos, rank): the up to k others most similar to each vector, of those at least min_cos similar.

    Rows with the same key count once, with the vector of least hash. Equal vectors are searched as one; of ties in similarity the smaller
    key comes first, so a group of equal vectors yields k rows per member, not all its pairs. No rows for an empty table.
    """
    n = df.count()
    wanted = min(sample, max(2000, 100 << depth_for(n, SHARD)))  # a hundred for every edge of the last level
    # By the hash of the vector itself: rows are chosen where they lie, none is sorted or sent; equal ones are one in the sample.
    some = df.filter(F.pmod(F.xxhash64(F.col(f"`{vector}`").cast("array<float>")), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 30))))
    units = usable(df, key, vector, dim)
    vectors = units.groupBy("key").agg(F.min("id").alias("id"))
    pairs = similar_pairs(units, n, usable(some, key, vector, dim).select("unit").distinct(), dim, min_cos, k, factor)
    both = pairs.select("cos", F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("a", "b", "cos")
    # k groups hold at least k members; ties stay until their keys decide.
    best = both.withColumn("_r", F.rank().over(W.partitionBy("a").orderBy(F.desc("cos")))).filter(F.col("_r") <= k)
    return _answers(best.select("a", "b", "cos"), vectors, vectors, k)


def _answers(links: DataFrame, asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(key, neighbour, cos, rank) of the asked keys (key, id) from links (a, b, cos) between different vectors, over all their keys."""
    # The members of a group that can be among the k nearest of anything are its k + 1 smallest keys.
    members = first_members(vectors, k + 1)
    # Only groups of several members are near themselves.
    several = members.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).cast("float").alias("cos"))
    rows = links.unionByName(several).join(members.select(F.col("id").alias("b"), F.col("key").alias("neighbour")), "b").select("a", "neighbour", "cos")
    near = _ranked(rows, "a", k + 1)  # bounded: k + 1 per group, one of which may be the asking key itself
    out = asked.select(F.col("id").alias("a"), "key").join(near, "a").filter(F.col("key") != F.col("neighbour"))
    return _ranked(out.select("key", "neighbour", "cos"), "key", k)


#: Least similarities that are asked for one after the other by those vectors that have fewer than k neighbours above the one before.
FLOORS = (0.88, 0.6, 0.2, -1.0)
#: The relaxation for asked vectors: they alone reach over an edge, and neighbours far away need a wider reach than close ones.
ASKED_FACTOR = 4.0


def nearest_of(df: DataFrame, asked: DataFrame, key: str, vector: str, dim: int, k: int, factor: float = ASKED_FACTOR, sample: int = SAMPLE, shard: int = SHARD, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """(key, neighbour, cos, rank): the k others most similar to each of the asked rows (a part of df), however unlike they are.

    Vectors lie in their own shard; an asked one visits every shard that the relaxed inequality leaves for the least similarity of the round,
    and gets the k best of each. Those with k neighbours leave; the others go on with a lower one. factor 1 is exact. Fewer than k only
    where df has fewer others. Keys, equal vectors and ties as in nearest().
    """
    n = df.count()
    wanted = min(sample, max(2000, 100 << depth_for(n, shard)))
    some = df.filter(F.pmod(F.xxhash64(F.col(f"`{vector}`").cast("array<float>")), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(n, 1)) * (1 << 30))))
    depth = depth_for(n, shard)
    tree = routing_tree(unit_vectors(usable(some, key, vector, dim).select("unit").distinct().toArrow().column("unit"), dim), depth) if depth else 0
    units = usable(df, key, vector, dim)
    vectors = units.groupBy("key").agg(F.min("id").alias("id"))
    questions = usable(asked, key, vector, dim)
    keys = questions.groupBy("key").agg(F.min("id").alias("id"))
    open_ = cut_lineage(questions.select("id", "unit").dropDuplicates(["id"]))

    def routed(slack: float, own: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, shards = route(tree, unit_vectors(batch.column(1), dim), slack)
                yield pa.RecordBatch.from_arrays([pa.array(shards), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), own))], names=["shard", "id", "unit", "own"])

        return go

    def meet(floor: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = [b for b in batches if b.num_rows]
            if not whole:
                return
            rows = pa.Table.from_batches(whole)
            own = rows.column("own").to_numpy()
            x, q = rows.filter(pa.array(own)), rows.filter(pa.array(~own))
            if not x.num_rows or not q.num_rows:
                return
            ids, first = np.unique(x.column("id").to_numpy(), return_index=True)
            asks, place = np.unique(q.column("id").to_numpy(), return_index=True)
            best = Best(len(asks), k + 1)  # one of them may be the vector itself
            for i, j, c in search(unit_vectors(x.column("unit").take(pa.array(first)), dim), unit_vectors(q.column("unit").take(pa.array(place)), dim), floor, factor):
                best.add(i, j, c)
            i, j, c = best.cut()
            other = asks[i] != ids[j]
            yield pa.RecordBatch.from_arrays([pa.array(asks[i][other]), pa.array(ids[j][other]), pa.array(c[other].astype(np.float32))], names=["a", "b", "cos"])

        return go

    links, schema = None, "shard int, id long, unit binary, own boolean"
    for floor in floors:
        radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * floor)))
        index = units.select("id", "unit").mapInArrow(routed(0.0, True), schema)
        visits = open_.mapInArrow(routed(radius / factor, False), schema)
        met = index.unionByName(visits).repartitionById(1 << depth, "shard").mapInArrow(meet(floor), "a long, b long, cos float")
        r = F.rank().over(W.partitionBy("a").orderBy(F.desc("cos")))
        found = cut_lineage(met.withColumn("_r", r).filter(F.col("_r") <= k).select("a", "b", "cos"))
        full = found.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("a").alias("id"))
        done = found.join(full.withColumnRenamed("id", "a"), "a", "left_semi") if floor > floors[-1] else found
        links = done if links is None else links.unionByName(done)
        open_ = cut_lineage(open_.join(full, "id", "left_anti"))
        if open_.isEmpty():
            break
    return _answers(links, keys, vectors, k)


def first_members(vectors: DataFrame, n: int) -> DataFrame:
    """(id, key) of the n smallest keys of every id, taken in two steps so that a group with a third of all rows meets nowhere."""
    salted = vectors.select("id", "key", F.pmod(F.hash("key"), F.lit(64)).alias("salt"))
    some = salted.withColumn("r", F.row_number().over(W.partitionBy("id", "salt").orderBy("key"))).filter(F.col("r") <= n)
    return some.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("key"))).filter(F.col("r") <= n).select("id", "key")


def _ranked(rows: DataFrame, by: str, k: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("cos"), "neighbour"))
    return rows.withColumn("rank", r).filter(F.col("rank") <= k)
