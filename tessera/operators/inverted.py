"""The inverted index as tables: positional postings by token, kept in generations, searched by reading the asked tokens only.

A folder holds `postings` (by generation and token bucket, sorted by token), `lengths`, `dead` and `stats`. A change writes a generation:
the new rows, the keys that it takes out of older generations, and last its row of statistics, which makes it count. A bucket is chosen by
a token's first two characters, so that a prefix of two lies in one bucket, too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.search import COLUMNS, K1, B, Phrase
from tessera.session import cut_lineage, spread

BUCKETS = 64
#: Dead keys up to which they are broadcast to the postings read; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
_POSTINGS = "bucket int, token string, key string, asset_id string, dl long, col string, positions array<int>, gen int"
_LENGTHS = "key string, asset_id string, dl long, gen int"
_DEAD = "key string, dl long, gen int"
_STATS = "units long, tokens long, dead_units long, dead_tokens long, gen int"


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.left(token, F.lit(2))), F.lit(buckets)).cast("int")


def postings_of(units: DataFrame, key: str, asset: str | None, columns: Sequence[str]) -> DataFrame:
    """(token, key, asset_id, dl, col, positions): a row per token of a column, dl the tokens of all columns. Redelivered rows count once."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys, assets, *lists = (c.to_pylist() for c in batch.columns)
            for k, a, *ts in zip(keys, assets, *lists, strict=True):
                dl = sum(map(len, ts))
                for c, words in zip(columns, ts, strict=True):
                    at: dict[str, list[int]] = {}
                    for i, w in enumerate(words):
                        at.setdefault(w, []).append(i)
                    rows += [(w, k, a, dl, c, ps) for w, ps in at.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["token", "key", "asset_id", "dl", "col", "positions"])

    who = F.col(asset) if asset else F.lit(None).cast("string")
    rows = units.select(F.col(key).cast("string").alias("key"), who.alias("asset_id"), *columns).filter("key IS NOT NULL").dropDuplicates(["key"])
    lists = rows.select("key", "asset_id", *[tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    return spread(lists).mapInArrow(fold, "token string, key string, asset_id string, dl long, col string, positions array<int>")


class Index:
    """An index in a folder; key, asset and columns name what it is made of."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", asset: str | None = "asset_id", columns: Sequence[str] = COLUMNS):
        self.spark, self.folder, self.key, self.asset, self.columns = spark, folder.rstrip("/"), key, asset, tuple(columns)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def generations(self) -> list:
        """The committed generations, a row each."""
        return self._read("stats", _STATS).collect()

    def _commit(self, fresh: DataFrame | None, gone: DataFrame | None) -> int:
        """Writes a generation of the postings of `fresh`, with the keys (key) that it takes out of the older ones."""
        done = self.generations()
        gen = max((r["gen"] for r in done), default=0) + 1
        units = total = dead = dead_total = 0
        if fresh is not None:
            rows = postings_of(fresh, self.key, self.asset, self.columns).withColumn("bucket", bucket_of(F.col("token")))
            # Adaptive execution splits buckets that are too large, and puts small ones together.
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/gen={gen}")
            who = F.col(self.asset) if self.asset else F.lit(None).cast("string")
            lengths = fresh.select(F.col(self.key).cast("string").alias("key"), who.alias("asset_id"), sum((F.size(tokens(F.col(c))) for c in self.columns), F.lit(0)).cast("long").alias("dl")).filter("key IS NOT NULL").dropDuplicates(["key"])
            lengths.write.mode("overwrite").parquet(f"{self.folder}/lengths/gen={gen}")
            s = self.spark.read.parquet(f"{self.folder}/lengths/gen={gen}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            units, total = s[0], s[1]
        if gone is not None and done:
            self.lengths().join(gone.select("key").distinct(), "key", "left_semi").select("key", "dl").write.mode("overwrite").parquet(f"{self.folder}/dead/gen={gen}")
            s = self.spark.read.parquet(f"{self.folder}/dead/gen={gen}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            dead, dead_total = s[0], s[1]
        self.spark.createDataFrame([(units, total, dead, dead_total)], "units long, tokens long, dead_units long, dead_tokens long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats/gen={gen}")
        return gen

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of committed generations whose key no later one has taken out."""
        done = self.generations()
        rows = rows.filter(F.col("gen").isin([r["gen"] for r in done]))
        n = sum(r["dead_units"] for r in done)
        if not n:
            return rows
        dead = self._read("dead", _DEAD).filter(F.col("gen").isin([r["gen"] for r in done])).groupBy(F.col("key").alias("_key")).agg(F.max("gen").alias("_gen"))
        return rows.join(F.broadcast(dead) if n <= BROADCAST_ROWS else dead, (F.col("key") == F.col("_key")) & (F.col("gen") < F.col("_gen")), "left_anti")

    def lengths(self) -> DataFrame:
        """(key, asset_id, dl, gen) of what the index holds."""
        return self._live(self._read("lengths", _LENGTHS))

    def replace(self, units: DataFrame) -> int:
        """Writes the units' postings in the place of those with the same keys."""
        return self._commit(units, units.select(F.col(self.key).cast("string").alias("key")))

    def delete(self, keys: DataFrame) -> int:
        """Takes units (key) out."""
        return self._commit(None, keys)

    def delete_assets(self, assets: DataFrame) -> int:
        """Takes all units of files (asset_id) out."""
        return self._commit(None, cut_lineage(self.lengths().join(assets.select("asset_id").distinct(), "asset_id", "left_semi").select("key")))

    def linkage(self, units: DataFrame) -> DataFrame:
        """(units, linked, consistent) against the table that the index was made from."""
        u = units.select(F.col(self.key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
        return u.join(self.lengths().select("key", F.lit(1).alias("there")), "key", "full_outer").agg(F.count_if(F.col("key").isNotNull()).alias("units"), F.count("there").alias("linked")).withColumn("consistent", F.col("units") == F.col("linked"))

    def heal(self, units: DataFrame) -> bool:
        """Indexes what is missing and takes out what is gone, where index and table disagree; whether they did."""
        u, have = units.withColumn("_k", F.col(self.key).cast("string")), self.lengths().select(F.col("key").alias("_k"))
        missing, gone = cut_lineage(u.join(have, "_k", "left_anti").drop("_k")), cut_lineage(have.join(u.select("_k").distinct(), "_k", "left_anti").select(F.col("_k").alias("key")))
        if missing.isEmpty() and gone.isEmpty():
            return False
        self._commit(None if missing.isEmpty() else missing, None if gone.isEmpty() else gone)
        return True

    def postings(self, wanted: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
        """The live postings of tokens and of tokens with a prefix: of the files, only those of their buckets, and within these their row groups."""
        rows = self._read("postings", _POSTINGS)
        short = any(len(p) < 2 for p in prefixes)
        if not short:
            asked = self.spark.createDataFrame([(x,) for x in sorted({*wanted, *prefixes})], "token string").select(bucket_of(F.col("token")).alias("b")).distinct()
            rows = rows.filter(F.col("bucket").isin([r["b"] for r in asked.collect()]))  # a few tokens
        hit = reduce(lambda a, b: a | b, [*([F.col("token").isin(sorted({*wanted}))] if wanted else []), *(F.col("token").startswith(p) for p in sorted({*prefixes}))])
        return self._live(rows.filter(hit))

    def all_postings(self) -> DataFrame:
        """Every live posting."""
        return self._live(self._read("postings", _POSTINGS))

    def match(self, wanted: Sequence[Phrase]) -> DataFrame:
        """(key, score) of the units in which all phrases occur; BM25 as search.match() gives it, from one scan of the asked tokens.

        Adjacent tokens are found where the positions of a later one, moved back by its place, meet those of the first.
        """
        if not wanted:
            return self.spark.createDataFrame([], "key string, score double")
        done = self.generations()
        n_all = sum(r["units"] - r["dead_units"] for r in done)
        mean = sum(r["tokens"] - r["dead_tokens"] for r in done) / n_all if n_all else 1.0
        terms = sorted({(t, p.prefix and i == len(p.tokens) - 1) for p in wanted for i, t in enumerate(p.tokens)})
        rows = self.postings([t for t, prefix in terms if not prefix], [t for t, prefix in terms if prefix])
        here = {x: F.col("token").startswith(x[0]) if x[1] else F.col("token") == x[0] for x in terms}
        # Both groupings lie by the unit: one exchange.
        places = rows.repartition("key").groupBy("key", "col").agg(F.first("dl").alias("dl"), *[F.flatten(F.collect_list(F.when(here[x], F.col("positions")))).alias(f"p{i}") for i, x in enumerate(terms)])

        def times(p: Phrase) -> Column:
            at = [F.col(f"p{terms.index((t, p.prefix and i == len(p.tokens) - 1))}") for i, t in enumerate(p.tokens)]
            # The positions where the phrase begins: of one token, or where all tokens meet.
            back = lambda a, i: F.transform(a, lambda x: x - i) if i else a
            meet = reduce(F.array_intersect, [back(a, i) for i, a in enumerate(at)])
            return F.when(F.col("col").isin(*p.columns), F.size(meet)).otherwise(0)

        tf = places.select("key", "dl", *[times(p).alias(f"tf{i}") for i, p in enumerate(wanted)]).groupBy("key").agg(F.first("dl").alias("dl"), *[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(wanted))])
        stats = tf.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(wanted))])
        hits = tf.filter(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(wanted))])).crossJoin(F.broadcast(stats))
        score = F.lit(0.0)
        for i in range(len(wanted)):
            idf = F.greatest(F.ln((F.lit(n_all) - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
            score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        return hits.select("key", score.alias("score"))


def build(spark: SparkSession, units: DataFrame, folder: str, key: str = "id", asset: str | None = "asset_id", columns: Sequence[str] = COLUMNS) -> Index:
    """A new index of all units in an empty folder."""
    index = Index(spark, folder, key, asset, columns)
    index._commit(units, None)
    return index


def shared_index(spark: SparkSession, path: str, name: str, rows: DataFrame, key: str, asset: str | None, columns: Sequence[str]) -> Index:
    """The index of a table in the session's shared folder: written when it is first asked for, anew where the table's files have changed."""
    from tessera.session import shared_folder

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    state, summary = files.getFileStatus(where), files.getContentSummary(where)
    folder = f"{shared_folder(spark)}/index/{name}-{abs(hash((path, state.getModificationTime(), summary.getLength(), summary.getFileCount()))):x}"
    index = Index(spark, folder, key, asset, columns)
    if not index.generations():
        index._commit(rows, None)
    return index
