"""Full-text matching and ranking, vector similarity, and the fusion of ranked legs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import dirname, fold, strip, tokens, tokens_of

COLUMNS = ("title", "text", "file_name")
SCOPES = {"everywhere": COLUMNS, "filename": ("file_name",), "content": ("title", "text")}
K1, B = 1.2, 0.75
RRF_K = 60


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens within one of the columns; with prefix, the last token may go on."""

    tokens: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class QuerySpec:
    """A search request with its limits clamped."""

    text: str
    limit: int = 50
    mode: str = "hybrid"  # hybrid, fts or semantic
    scope: str = "everywhere"
    compat: bool = False  # the scope binds the first phrase only
    prefix: bool = False
    groups: tuple[str, ...] = ()
    mtime_from: int | None = None
    mtime_to: int | None = None
    sort: str = "relevance"  # or mtime
    descending: bool = True
    kinds: tuple[str, ...] = field(default=())

    @property
    def size(self) -> int:
        return clamp(self.limit, 1, 100, 50)


def clamp(value: float | None, low: int, high: int, default: int) -> int:
    """A whole number within bounds; the default for nothing, zero or what is no number."""
    if value is None or not isinstance(value, (int, float)) or math.isnan(value) or value == 0:
        return default
    return int(max(low, min(high, value)))


def time_argument(value: object) -> int | None:
    """Milliseconds of a time given as seconds, milliseconds or a date; None for what is neither."""
    if value in (None, ""):
        return None
    try:
        n = float(str(value))
        return int(n * 1000) if n < 1e12 else int(n)
    except ValueError:
        t = pd.to_datetime(str(value), utc=True, errors="coerce")
        return None if pd.isna(t) else int(t.timestamp() * 1000)


def phrases(query: str, scope: str = "everywhere", compat: bool = False, prefix: bool = False) -> list[Phrase]:
    """One phrase per blank-separated word, all of which must match. A word of punctuation only is ignored."""
    words = [w for w in (tuple(tokens_of(x)) for x in query.split()) if w]
    return [Phrase(w, prefix and i == len(words) - 1, COLUMNS if compat and i else SCOPES[scope]) for i, w in enumerate(words)]


def plain(c: Column) -> Column:
    """The tokens of a text in order, each with a blank before and after it; one blank for a text without any."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))))


def index(units: DataFrame, key: str = "id", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(key, s_<column> ..., dl): the tokens of each column as plain(), and the number of all tokens. Redelivered rows count once."""
    rows = units.select(key, *columns).distinct()
    lists = rows.select(key, *[plain(F.col(c)).alias(f"s_{c}") for c in columns])
    return lists.withColumn("dl", sum((F.length(f"s_{c}") - F.length(F.replace(f"s_{c}", F.lit(" "))) - 1 for c in columns), F.lit(0)))


def postings(units: DataFrame, key: str = "id", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(key, col, pos, token): the positional inverted index, to be written partitioned by token."""
    rows = units.select(key, *columns).distinct()
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in columns]))
    return rows.select(key, each).select(key, "col", F.posexplode("t").alias("pos", "token"))


def _occurrences(column: Column, p: Phrase) -> Column:
    """Times that the phrase begins in a column; the look-ahead counts overlapping ones, and no lambda has to walk the tokens."""
    return F.regexp_count(column, F.lit(f" (?={' '.join(p.tokens)}{'' if p.prefix else ' '})"))


def match(indexed: DataFrame, wanted: Sequence[Phrase], key: str = "id") -> DataFrame:
    """(key, score) of the rows in which all phrases occur; BM25, larger is better; no rows for a query without a phrase.

    Frequencies are counted row by row, so that nothing is shuffled but the one row of corpus statistics. N and the mean length count
    all rows, a phrase's n the rows that match it in its own columns; a negative idf is raised to 1e-6; repeated phrases count again.
    """
    if not wanted:
        return indexed.select(key, F.lit(0.0).alias("score")).limit(0)
    tf = [sum((_occurrences(F.col(f"s_{c}"), p) for c in p.columns if f"s_{c}" in indexed.columns), F.lit(0)) for p in wanted]
    rows = indexed.select(key, "dl", *[t.alias(f"tf{i}") for i, t in enumerate(tf)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"_n{i}") for i in range(len(tf))])
    hits = rows.filter(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(tf))])).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(tf)):
        idf = F.greatest(F.ln((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    return hits.select(key, score.alias("score"))


def top(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best by score (to six digits), ties by key: one TakeOrderedAndProject, no full sort."""
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(k)


def in_groups(path: Column, groups: Sequence[str]) -> Column:
    """Within one of the folders or below; `__ungrouped__` is the root itself; no groups means no filter. Exact and case-sensitive."""
    if not groups:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [~path.contains("/") if g == "__ungrouped__" else path.startswith(g.rstrip("/") + "/") for g in groups])


def in_window(mtime: Column, start: int | None, end: int | None) -> Column:
    """Both ends inclusive; null fails where a bound is set."""
    out = F.lit(True)
    if start is not None:
        out = out & F.coalesce(mtime >= start, F.lit(False))
    if end is not None:
        out = out & F.coalesce(mtime <= end, F.lit(False))
    return out


def snippet(text: str | None, wanted: Sequence[Phrase], width: int = 12) -> str:
    """Up to `width` words around the first hit, hits in brackets; the beginning where there is none."""
    import re

    words = [(m.start(), m.end(), tokens_of(m[0])) for m in re.finditer(r"[^\W_]+", text or "")]
    flat = [w[2][0] if w[2] else "" for w in words]
    marks: set[int] = set()
    for p in wanted:
        if "text" in p.columns:
            n = len(p.tokens)
            for i in range(len(flat) - n + 1):
                if all(flat[i + j] == t or (p.prefix and j == n - 1 and flat[i + j].startswith(t)) for j, t in enumerate(p.tokens)):
                    marks.update(range(i, i + n))
    if not words:
        return (text or "")[:200]
    first = max(0, min(marks, default=0) - 5)
    last = min(len(words), first + width)
    out, at = "…" if first else "", words[first][0]
    for i in range(first, last):
        a, b, _ = words[i]
        out += text[at:a] + (("" if i - 1 in marks and i > first else "[") if i in marks else "") + text[a:b] + ("]" if i in marks and (i + 1 not in marks or i + 1 == last) else "")
        at = b
    return out + ("…" if last < len(words) else "")


def snippets(text: Column, wanted: Sequence[Phrase], width: int = 12) -> Column:
    wanted = tuple(wanted)

    @F.pandas_udf(T.StringType())
    def cut(v: pd.Series) -> pd.Series:
        return pd.Series([snippet(x, wanted, width) for x in v], index=v.index)

    return cut(text)


#: Numbers of a vector up to which a dot product is one generated expression; longer ones make methods too large to be compiled, and are
#: worked out in Arrow batches.
UNROLLED = 16


def dot(vector: Column, asked: Sequence[float]) -> Column:
    """Dot product with a known vector, over the shorter length, in double precision; null and NaN numbers stay what they are."""
    if len(asked) <= UNROLLED:
        return sum((F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.when(F.size(vector) <= i, 0.0)) * F.lit(float(x)) for i, x in enumerate(asked)), F.lit(0.0))
    q = np.asarray(asked, dtype=np.float64)

    @F.pandas_udf(T.DoubleType())
    def product(v: pd.Series) -> pd.Series:
        if len(v) and (v.map(len) == len(q)).all():
            return pd.Series(np.stack(v.to_numpy()).astype(np.float64) @ q, index=v.index)
        return pd.Series([float(np.dot(np.asarray(x, dtype=np.float64)[: len(q)], q[: len(x)])) for x in v], index=v.index)

    return product(vector)


def usable_vector(v: Column, dim: int) -> Column:
    """Of the given length, without NaN."""
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def nearest_units(vectors: DataFrame, query: DataFrame, k: int | None, unit: str = "unit_id", dim: int = 64, readable: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(unit, score) of the units most similar to the one query vector (a frame of one row, column q): the best of each unit's vectors,
    those of its translations among them. Filters apply before the cut. An empty query gives no rows.

    With `by`, the query is a frame of any number of vectors (columns by and q): (by, unit, score), the k best for each value of by.
    """
    rows = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") == dim))
    if readable is not None:
        rows = rows.join(readable, "asset_id", "left_semi")
    if by is not None:
        return _nearest_of_many(rows, query.select(by, "q"), k, unit, dim, by)
    asked = query.limit(1).collect()  # the one vector asked about
    if not asked:
        return rows.select(unit, F.lit(0.0).alias("score")).limit(0)
    # A vector with a null or NaN in it has no score.
    scored = rows.select(unit, dot(F.col("vector"), asked[0]["q"]).alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    best = scored.groupBy(unit).agg(F.max("score").alias("score"))
    return top(best, k, unit) if k else best.withColumn("score", F.round("score", 6))


def _nearest_of_many(rows: DataFrame, query: DataFrame, k: int | None, unit: str, dim: int, by: str, block: int = 4096) -> DataFrame:
    """The k best units for each of many query vectors. Queries go in blocks over all vectors, each block as one matrix, and every task
    keeps the k best of its own units per query: no pair leaves a task that can't be among the best. Queries without NaN, of the right length."""
    kinds, session = dict(query.dtypes) | dict(rows.dtypes), rows.sparkSession
    asked = query.filter(usable_vector(F.col("q"), dim))
    blocks = asked.withColumn("_b", F.pmod(F.xxhash64(by), F.lit(max(1, -(-asked.count() // block)))))
    numbers = [r["_b"] for r in blocks.select("_b").distinct().collect()]  # one per 4,096 queries
    out = None
    for b in sorted(numbers):
        some = blocks.filter(F.col("_b") == b).select(by, "q").toPandas()  # a block, some MB
        sent = session.sparkContext.broadcast((some[by].to_numpy(), np.stack(some["q"].to_numpy()).astype(np.float64)))

        def best(frames, sent=sent):
            names, q = sent.value
            for f in frames:
                x = np.stack(f["vector"].to_numpy()).astype(np.float64)
                ok = np.isfinite(x).all(axis=1)
                x, units = x[ok], f[unit].to_numpy()[ok]
                if not len(x):
                    continue
                s = np.round(q @ x.T, 6)
                if k and s.shape[1] > 4 * k:  # of a unit's several vectors only the best counts, so ties and doubles stay for later
                    order, first = np.unique(units, return_inverse=True)
                    m = np.full((len(q), len(order)), -np.inf)
                    for j in range(s.shape[1]):
                        np.maximum(m[:, first[j]], s[:, j], out=m[:, first[j]])
                    kth = np.partition(m, max(m.shape[1] - k, 0), axis=1)[:, max(m.shape[1] - k, 0)]
                    i, j = np.nonzero(m >= kth[:, None])
                    yield pd.DataFrame({by: names[i], unit: order[j], "score": m[i, j]})
                else:
                    i, j = np.indices(s.shape).reshape(2, -1)
                    yield pd.DataFrame({by: names[i], unit: units[j], "score": s[i, j]})

        part = rows.select(unit, "vector").filter(~F.exists("vector", lambda v: v.isNull())).mapInPandas(best, f"`{by}` {kinds[by]}, `{unit}` {kinds[unit]}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select(F.lit(None).cast(kinds[by]).alias(by), unit, F.lit(0.0).alias("score")).limit(0)
    best_of = out.groupBy(by, unit).agg(F.max("score").alias("score"))
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), unit))
    return best_of.withColumn("_r", r).filter(F.col("_r") <= k).drop("_r") if k else best_of


def ranked(leg: DataFrame, name: str, position: int, k: int, key: str = "unit_id") -> DataFrame:
    """(key, leg, leg_pos, rank0) of the k best of a leg."""
    r = F.row_number().over(W.orderBy(F.desc("score"), key)) - 1  # over k rows, after the cut
    return top(leg, k, key).select(key, F.lit(name).alias("leg"), F.lit(position).alias("leg_pos"), r.alias("rank0"))


def fuse(legs: Sequence[DataFrame], key: str = "unit_id") -> DataFrame:
    """(key, score, first_leg, first_rank, legs): reciprocal-rank fusion, the sum of 1 / (60 + 1 + rank) over the legs."""
    rows = reduce(DataFrame.unionByName, legs)
    return rows.groupBy(key).agg(
        F.round(F.sum(1.0 / (RRF_K + 1 + F.col("rank0"))), 9).alias("score"), F.min("leg_pos").alias("first_leg"), F.min_by("rank0", "leg_pos").alias("first_rank"), F.sort_array(F.collect_set("leg")).alias("legs")
    )


def source_label(legs: Column) -> Column:
    fts, semantic = F.array_contains(legs, "fts"), F.array_contains(legs, "semantic")
    return F.when(fts & semantic, "hybrid").when(fts, "fts").otherwise("semantic")


def hybrid(spec: QuerySpec, units: DataFrame, assets: DataFrame, translations: DataFrame, vectors: DataFrame, query: DataFrame | None, readable: DataFrame | None = None, text_index=None, translation_index=None) -> DataFrame:
    """Hybrid search: full text, translations and vectors, fused; filters below every leg's cut, hydration after the last one.

    With an index of the units, and one of the translations by unit_id and lang with \\u0001 between, only the asked tokens' postings are
    read; without, the texts are. Vectors outside the filters are not scored.

    units (id, asset_id, title, text, file_name), assets (id, path, mtime_ms, kind), translations (unit_id, title, text), vectors
    (unit_id, asset_id, vector), query (one row, q), readable (asset_id). With scope filename only full text is used, and a file counts once.
    """
    a = assets.select(F.col("id").alias("asset_id"), "path", "mtime_ms", "kind").distinct()
    keep = in_groups(F.col("path"), spec.groups) & in_window(F.col("mtime_ms"), spec.mtime_from, spec.mtime_to)
    if spec.kinds:
        keep = keep & F.col("kind").isin(*spec.kinds)
    a = a.filter(keep)
    if readable is not None:
        a = a.join(readable, "asset_id", "left_semi")
    u = units.select(F.col("id").alias("unit_id"), "asset_id", "title", "text", "file_name").distinct()
    allowed = u.select("unit_id", "asset_id").join(a.select("asset_id"), "asset_id", "left_semi").select("unit_id")
    wanted = phrases(spec.text, spec.scope, spec.compat, spec.prefix)
    size, legs = spec.size, []
    if spec.mode in ("hybrid", "fts") or spec.scope == "filename":
        hits = text_index.match(wanted).withColumnRenamed("key", "unit_id") if text_index else match(index(u, "unit_id"), wanted, "unit_id")
        hits = hits.join(allowed, "unit_id", "left_semi")
        if spec.scope == "filename":  # a file's best unit is chosen ahead of the cut, so many units of one file push no other out
            r = F.row_number().over(W.partitionBy("asset_id").orderBy(F.desc(F.round("score", 6)), "unit_id"))
            hits = hits.join(u.select("unit_id", "asset_id"), "unit_id").withColumn("_r", r).filter("_r = 1").select("unit_id", "score")
        legs.append(ranked(hits, "fts", 0, size))
        if spec.scope != "filename":
            within = [Phrase(p.tokens, p.prefix, ("title", "text")) for p in wanted]
            tr = translation_index.match(within).withColumnRenamed("key", "tr") if translation_index else match(index(translations.withColumn("tr", F.concat_ws("\u0001", "unit_id", "lang")), "tr", ("title", "text")), within, "tr")
            hits = tr.groupBy(F.substring_index("tr", "\u0001", 1).alias("unit_id")).agg(F.max("score").alias("score"))
            legs.append(ranked(hits.join(allowed, "unit_id", "left_semi"), "translation", 1, size))
    if spec.mode in ("hybrid", "semantic") and spec.scope != "filename" and query is not None:
        legs.append(ranked(nearest_units(vectors.join(allowed, "unit_id", "left_semi"), query, None), "semantic", 2, size))
    fused = fuse(legs)
    rows = fused.join(u.select("unit_id", "asset_id", "file_name"), "unit_id").join(a, "asset_id")
    order = [F.desc("score"), F.col("first_leg"), F.col("first_rank"), F.col("unit_id")]
    if spec.sort == "mtime":
        m = F.coalesce("mtime_ms", F.lit(-1))
        order = [m.desc() if spec.descending else m.asc(), *order]
    out = rows.orderBy(*order).limit(size)
    return out.select("unit_id", "asset_id", "file_name", dirname(F.col("path")).alias("dir_path"), "score", source_label(F.col("legs")).alias("source"), F.array_join("legs", ",").alias("legs"))


def with_snippets(hits: DataFrame, units: DataFrame, translations: DataFrame, wanted: Sequence[Phrase]) -> DataFrame:
    """Hits (unit_id, legs) with a snippet: that of the translation that matches best where one does, without its marks; else that of the
    text where it matched; else its first 200 characters. Only the hits' own texts are read into it."""
    u = units.select(F.col("id").alias("unit_id"), "text").dropDuplicates(["unit_id"])
    within = [Phrase(p.tokens, p.prefix, ("title", "text")) for p in wanted]
    of_hits = translations.join(hits.select("unit_id"), "unit_id", "left_semi").withColumn("tr", F.concat_ws("\u0001", "unit_id", F.coalesce("lang", F.lit(""))))
    found = match(index(of_hits, "tr", ("title", "text")), within, "tr")
    best = of_hits.select("tr", "unit_id", F.col("text").alias("t")).dropDuplicates(["tr"]).join(found, "tr").groupBy("unit_id").agg(F.max_by("t", F.struct("score", "tr")).alias("t"))
    from tessera.functions.text import plain_snippet

    out = hits.join(u, "unit_id", "left").join(best, "unit_id", "left")
    shown = F.when(F.col("t").isNotNull(), plain_snippet(snippets(F.col("t"), within))).when(F.contains("legs", F.lit("fts")), snippets(F.col("text"), wanted)).otherwise(F.left(F.coalesce("text", F.lit("")), F.lit(200)))
    return out.select(*[F.col(c) for c in hits.columns], shown.alias("snippet"))


def hydrate(ids: DataFrame, units: DataFrame, key: str = "unit_id") -> DataFrame:
    """Hits with the first 200 characters of their text as snippet, for those without one of their own."""
    u = units.select(F.col("id").alias(key), "title", F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("snippet")).distinct()
    return ids.join(u, key)


def snippet_parts(c: Column) -> Column:
    """The pieces of a snippet, hits and what is between them."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]|[^\[\]]+)"), 1), lambda x: strip(x) != "")
