"""Search over the test tables: full text, vectors, fusion, suggestions, contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ACCENTED, FOLDED, dirname
from tessera.operators import folds, inverted, search
from tessera.operators.search import Phrase, QuerySpec
from tessera.plans.registry import query
from tessera.session import table

T = table
TOKENS = "regexp_extract_all(translate(lower(coalesce({c}, '')), '" + ACCENTED + "', '" + FOLDED + "'), '[\\p{L}\\p{N}]+')"


def match_sql(wanted: list[Phrase], source: str = "(SELECT DISTINCT id, title, text, file_name FROM content_units)", columns: tuple[str, ...] = search.COLUMNS, key: str = "id") -> str:
    """Positional postings and phrase joins in SQL: (key, score), independent of how the engine counts."""
    cols = " UNION ALL ".join(f"SELECT {key} AS id, '{c}' AS col, {TOKENS.replace('{c}', c)} AS t FROM {source}" for c in columns)
    ctes = [f"c AS MATERIALIZED ({cols})", "d AS (SELECT id, sum(len(t)) AS dl FROM c GROUP BY id)", "s AS (SELECT count(*) AS n_all, avg(dl) AS avgdl FROM d)", "p AS MATERIALIZED (SELECT id, col, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM c)"]
    terms = []
    for i, w in enumerate(wanted):
        cond = lambda a, j, w=w: f"starts_with({a}.tok, '{w.tokens[j]}')" if w.prefix and j == len(w.tokens) - 1 else f"{a}.tok = '{w.tokens[j]}'"
        joins = " ".join(f"JOIN p a{j} ON a{j}.id = a0.id AND a{j}.col = a0.col AND a{j}.pos = a0.pos + {j} AND {cond(f'a{j}', j)}" for j in range(1, len(w.tokens)))
        inside = ", ".join(f"'{c}'" for c in w.columns)
        ctes.append(f"h{i} AS (SELECT a0.id, count(*) AS tf FROM p a0 {joins} WHERE {cond('a0', 0)} AND a0.col IN ({inside}) GROUP BY a0.id)")
        n = f"(SELECT count(*) FROM h{i})"
        terms.append(f"greatest(ln((n_all - {n} + 0.5) / ({n} + 0.5)), 1e-6) * h{i}.tf * 2.2 / (h{i}.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))")
    joins = " ".join(f"JOIN h{i} ON h{i}.id = d.id" for i in range(len(wanted)))
    return f"WITH {', '.join(ctes)} SELECT d.id AS {key}, {' + '.join(terms)} AS score FROM d {joins} CROSS JOIN s"


def ranked_sql(inner: str, k: int, key: str = "id") -> str:
    return f"SELECT {key}, round(score, 6) AS score FROM ({inner}) ORDER BY round(score, 6) DESC, {key} LIMIT {k}"


def text_index(s: SparkSession, d: str) -> inverted.Index:
    """The persisted index of the units."""
    return inverted.shared_index(s, f"{d}/content_units.parquet", "units", T(s, d, "content_units"), "id", "asset_id", search.COLUMNS)


def translation_index(s: SparkSession, d: str) -> inverted.Index:
    """The persisted index of the translations, by unit and number."""
    rows = T(s, d, "unit_translations").withColumn("tr", F.concat_ws("\u0001", "unit_id", F.col("tr_id").cast("string")))
    return inverted.shared_index(s, f"{d}/unit_translations.parquet", "translations", rows, "tr", "asset_id", ("title", "text"))


def fts(name: str, text: str, k: int = 20, scope: str = "everywhere", compat: bool = False, prefix: bool = False) -> None:
    wanted = search.phrases(text, scope, compat, prefix)
    query(name, ranked_sql(match_sql(wanted), k))(lambda s, d: search.top(text_index(s, d).match(wanted).withColumnRenamed("key", "id"), k))


fts("fts_term", "glacier")
fts("fts_and", "glacier telescope")
fts("fts_phrase", "quay-crane")
fts("fts_phrase_and_term", "quay-crane warehouse")
fts("fts_prefix", "conta", prefix=True)
fts("fts_and_prefix", "gantry ware", prefix=True)
fts("fts_accents", "RÉSULTAT Données")
fts("fts_repeated", "glacier glacier")
fts("fts_scope_filename", "window", scope="filename")
fts("fts_scope_strict", "pdf m", scope="filename", prefix=True)
fts("fts_scope_compat", "pdf gantry", scope="filename", compat=True)
fts("fts_scope_content", "Sitzungen und", scope="content")
fts("fts_punctuation_ignored", "glacier ---")

_TR = "(SELECT DISTINCT unit_id || ' ' || tr_id AS id, title, text FROM unit_translations)"
_TR_WANTED = [Phrase(("survey",), False, ("title", "text")), Phrase(("margin",), False, ("title", "text"))]


@query("fts_translation", ranked_sql(match_sql(_TR_WANTED, _TR, ("title", "text")), 20))
def fts_translation(s: SparkSession, d: str) -> DataFrame:
    return search.top(translation_index(s, d).match(_TR_WANTED).select(F.translate("key", "\u0001", " ").alias("id"), "score"), 20)


@query("index_statistics", f"WITH u AS (SELECT DISTINCT id, title, text, file_name FROM content_units), l AS (SELECT id, len({TOKENS.replace('{c}', 'title')}) + len({TOKENS.replace('{c}', 'text')}) + len({TOKENS.replace('{c}', 'file_name')}) AS dl FROM u) SELECT count(*) AS units, sum(dl)::BIGINT AS tokens, max(dl)::BIGINT AS longest FROM l")
def index_statistics(s: SparkSession, d: str) -> DataFrame:
    return text_index(s, d).lengths().agg(F.count("*").alias("units"), F.sum("dl").alias("tokens"), F.max("dl").cast("long").alias("longest"))


@query("document_frequencies", f"WITH u AS (SELECT DISTINCT id, title, text, file_name FROM content_units), p AS (SELECT DISTINCT id, unnest(list_concat({TOKENS.replace('{c}', 'title')}, {TOKENS.replace('{c}', 'text')}, {TOKENS.replace('{c}', 'file_name')})) AS token FROM u) SELECT token, count(*) AS df FROM p GROUP BY token")
def document_frequencies(s: SparkSession, d: str) -> DataFrame:
    return text_index(s, d).all_postings().groupBy("token").agg(F.count_distinct("key").alias("df"))


@query("fts_linkage", "SELECT count(DISTINCT id) AS units, count(DISTINCT CASE WHEN dl > 0 THEN id END) AS linked, count(DISTINCT id) = count(DISTINCT CASE WHEN dl > 0 THEN id END) AS consistent FROM (SELECT id, " + " + ".join(f"len({TOKENS.replace('{c}', c)})" for c in search.COLUMNS) + " AS dl FROM content_units)")
def fts_linkage(s: SparkSession, d: str) -> DataFrame:
    from tessera.operators.pipeline import linkage

    units = T(s, d, "content_units")
    return linkage(text_index(s, d).lengths().filter("dl > 0").select(F.col("key").alias("unit_id")), units)


@query("fts_snippet")
def fts_snippet(s: SparkSession, d: str) -> DataFrame:
    """Snippets of the best hits; their choice of window has no SQL."""
    wanted = search.phrases("glacier telescope")
    units = T(s, d, "content_units")
    hits = search.top(text_index(s, d).match(wanted).withColumnRenamed("key", "id"), 20)
    return hits.join(units.select("id", "text").distinct(), "id").select("id", "score", search.snippets(F.col("text"), wanted).alias("snippet"))


# A unit's best vector counts; the asking vector is that of the least unit id with a usable one.
_USABLE = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0"
_VECTORS = "(SELECT DISTINCT unit_id, asset_id, vector FROM unit_embeddings UNION ALL SELECT DISTINCT unit_id, asset_id, vector FROM unit_translation_embeddings)"
_ASKED = f"(SELECT vector AS q FROM unit_embeddings WHERE {_USABLE} ORDER BY unit_id LIMIT 1)"
_SIMILAR = f"SELECT unit_id, max(list_dot_product(vector::DOUBLE[], q::DOUBLE[])) AS score FROM {{v}}, {_ASKED} WHERE {_USABLE} GROUP BY unit_id"


def all_vectors(s: SparkSession, d: str) -> DataFrame:
    c = ("unit_id", "asset_id", "vector")
    return T(s, d, "unit_embeddings").select(*c).unionByName(T(s, d, "unit_translation_embeddings").select(*c))


def asked(s: SparkSession, d: str) -> DataFrame:
    """The one query vector."""
    rows = T(s, d, "unit_embeddings").filter(search.usable_vector(F.col("vector"), 64))
    return rows.select("unit_id", F.col("vector").alias("q")).orderBy("unit_id").limit(1).select("q")


@query("vector_topk", ranked_sql(_SIMILAR.format(v="(SELECT DISTINCT unit_id, vector FROM unit_embeddings)"), 20, "unit_id"))
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return search.nearest_units(T(s, d, "unit_embeddings"), asked(s, d), 20)


@query("vector_topk_max_lang", ranked_sql(_SIMILAR.format(v=_VECTORS), 20, "unit_id"))
def vector_topk_max_lang(s: SparkSession, d: str) -> DataFrame:
    return search.nearest_units(all_vectors(s, d), asked(s, d), 20)


@query("vector_topk_readable", ranked_sql(_SIMILAR.format(v=f"(SELECT * FROM {_VECTORS} WHERE asset_id IN (SELECT id FROM assets WHERE visibility = 'public'))"), 20, "unit_id"))
def vector_topk_readable(s: SparkSession, d: str) -> DataFrame:
    return search.nearest_units(all_vectors(s, d), asked(s, d), 20, readable=T(s, d, "assets").filter("visibility = 'public'").select(F.col("id").alias("asset_id")))


def legs_sql(k: int, where: str = "TRUE", wanted: list[Phrase] | None = None) -> str:
    """The three ranked legs, cut to k after the filter on units."""
    wanted = wanted or search.phrases("glacier telescope")
    tr = match_sql([Phrase(p.tokens, p.prefix, ("title", "text")) for p in wanted], "(SELECT DISTINCT unit_id || chr(1) || tr_id AS id, title, text FROM unit_translations)", ("title", "text"))
    ok = f"(SELECT u.id AS unit_id FROM content_units u JOIN assets a ON a.id = u.asset_id WHERE {where} GROUP BY u.id)"
    leg = lambda name, pos, inner: f"SELECT unit_id, '{name}' AS leg, {pos} AS leg_pos, row_number() OVER (ORDER BY round(score, 6) DESC, unit_id) - 1 AS rank0 FROM ({inner}) SEMI JOIN {ok} k USING (unit_id) QUALIFY rank0 < {k}"
    return " UNION ALL ".join([leg("fts", 0, f"SELECT id AS unit_id, score FROM ({match_sql(wanted)})"), leg("translation", 1, f"SELECT string_split(id, chr(1))[1] AS unit_id, max(score) AS score FROM ({tr}) GROUP BY 1"), leg("semantic", 2, _SIMILAR.format(v=_VECTORS))])


def hybrid_sql(k: int, order: str, where: str = "TRUE") -> str:
    return f"""
WITH f AS (SELECT unit_id, round(sum(1.0::DOUBLE / (61 + rank0)), 9) AS score, min(leg_pos) AS first_leg, min_by(rank0, leg_pos) AS first_rank, list_sort(list(DISTINCT leg)) AS legs FROM ({legs_sql(k, where)}) GROUP BY unit_id)
SELECT f.unit_id, u.asset_id, u.file_name, regexp_extract(a.path, '^(.+)/[^/]*$', 1) AS dir_path, score,
       CASE WHEN list_contains(legs, 'fts') AND list_contains(legs, 'semantic') THEN 'hybrid' WHEN list_contains(legs, 'fts') THEN 'fts' ELSE 'semantic' END AS source, array_to_string(legs, ',') AS legs
FROM f JOIN (SELECT DISTINCT id, asset_id, file_name FROM content_units) u ON u.id = f.unit_id JOIN (SELECT DISTINCT id, path, mtime_ms, kind FROM assets) a ON a.id = u.asset_id
ORDER BY {order} LIMIT {k}"""


def run_hybrid(s: SparkSession, d: str, spec: QuerySpec) -> DataFrame:
    translations = T(s, d, "unit_translations").select("unit_id", F.col("tr_id").cast("string").alias("lang"), "title", "text")
    return search.hybrid(spec, T(s, d, "content_units"), T(s, d, "assets"), translations, all_vectors(s, d), asked(s, d), None, text_index(s, d), translation_index(s, d))


@query("hybrid_search", hybrid_sql(30, "score DESC, first_leg, first_rank, f.unit_id"))
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return run_hybrid(s, d, QuerySpec("glacier telescope", 30))


@query("hybrid_mtime_sort", hybrid_sql(30, "coalesce(a.mtime_ms, -1) DESC, score DESC, first_leg, first_rank, f.unit_id"))
def hybrid_mtime_sort(s: SparkSession, d: str) -> DataFrame:
    return run_hybrid(s, d, QuerySpec("glacier telescope", 30, sort="mtime"))


@query("hybrid_filtered", hybrid_sql(20, "score DESC, first_leg, first_rank, f.unit_id", "(a.path LIKE 'manuals/%' OR a.path LIKE 'plans/%' OR a.path NOT LIKE '%/%') AND a.mtime_ms BETWEEN 1712000000000 AND 1780000000000 AND a.kind IN ('pdf', 'presentation')"))
def hybrid_filtered(s: SparkSession, d: str) -> DataFrame:
    return run_hybrid(s, d, QuerySpec("glacier telescope", 20, groups=("manuals", "plans", "__ungrouped__"), mtime_from=1712000000000, mtime_to=1780000000000, kinds=("pdf", "presentation")))


@query("rrf_merge", f"SELECT unit_id, round(sum(1.0::DOUBLE / (61 + rank0)), 9) AS score, count(*) AS legs FROM ({legs_sql(40)}) GROUP BY unit_id")
def rrf_merge(s: SparkSession, d: str) -> DataFrame:
    units, wanted = T(s, d, "content_units"), search.phrases("glacier telescope")
    ok = units.join(T(s, d, "assets").select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select(F.col("id").alias("unit_id"))
    translated = translation_index(s, d).match([Phrase(p.tokens, p.prefix, ("title", "text")) for p in wanted]).groupBy(F.substring_index("key", "\u0001", 1).alias("unit_id")).agg(F.max("score").alias("score"))
    legs = [text_index(s, d).match(wanted).withColumnRenamed("key", "unit_id"), translated, search.nearest_units(all_vectors(s, d), asked(s, d), None)]
    out = search.fuse([search.ranked(x.join(ok, "unit_id", "left_semi"), n, i, 40) for i, (n, x) in enumerate(zip(("fts", "translation", "semantic"), legs, strict=True))])
    return out.select("unit_id", "score", F.size("legs").cast("long").alias("legs"))


@query("filename_dedup", f"SELECT asset_id, unit_id, score FROM (SELECT u.asset_id, h.id AS unit_id, round(h.score, 6) AS score, row_number() OVER (PARTITION BY u.asset_id ORDER BY round(h.score, 6) DESC, h.id) AS r FROM ({match_sql(search.phrases('window', 'filename'))}) h JOIN (SELECT DISTINCT id, asset_id FROM content_units) u ON u.id = h.id) WHERE r = 1")
def filename_dedup(s: SparkSession, d: str) -> DataFrame:
    """The best unit of every file whose name matches."""
    from pyspark.sql import Window as W

    units = T(s, d, "content_units")
    hits = text_index(s, d).match(search.phrases("window", "filename")).withColumnRenamed("key", "id").withColumn("score", F.round("score", 6)).join(units.select("id", "asset_id").distinct(), "id")
    r = F.row_number().over(W.partitionBy("asset_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("r", r).filter("r = 1").select("asset_id", F.col("id").alias("unit_id"), "score")


@query("hydrate_hits", "SELECT DISTINCT id AS unit_id, title, left(coalesce(text, ''), 200) AS snippet FROM content_units")
def hydrate_hits(s: SparkSession, d: str) -> DataFrame:
    units = T(s, d, "content_units")
    return search.hydrate(units.select(F.col("id").alias("unit_id")).distinct(), units)


_SUGGEST = search.phrases("glac", prefix=True)
_SUGGEST_TR = match_sql([Phrase(p.tokens, p.prefix, ("title", "text")) for p in _SUGGEST], "(SELECT DISTINCT unit_id || chr(1) || tr_id AS id, title, text FROM unit_translations)", ("title", "text"))


@query("suggest_interleave", f"""
WITH RECURSIVE o AS (SELECT id AS unit_id, row_number() OVER (ORDER BY round(score, 6) DESC, id) - 1 AS k FROM ({match_sql(_SUGGEST)}) QUALIFY k < 20),
t AS (SELECT unit_id, row_number() OVER (ORDER BY round(score, 6) DESC, unit_id) - 1 AS k FROM (SELECT string_split(id, chr(1))[1] AS unit_id, max(score) AS score FROM ({_SUGGEST_TR}) GROUP BY 1) QUALIFY k < 10),
u AS (SELECT DISTINCT id AS unit_id, asset_id FROM content_units),
s AS (SELECT unit_id, asset_id, row_number() OVER (ORDER BY slot, unit_id) AS n FROM (SELECT unit_id, k + ceil(k / 2.0) AS slot FROM o UNION ALL SELECT unit_id, 3 * k + 1 FROM t) JOIN u USING (unit_id)),
p AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS units, []::VARCHAR[] AS files, NULL::VARCHAR AS unit_id, NULL::VARCHAR AS asset_id, false AS taken
  UNION ALL SELECT s.n, CASE WHEN ok THEN list_append(units, s.unit_id) ELSE units END, CASE WHEN ok THEN list_append(files, s.asset_id) ELSE files END, s.unit_id, s.asset_id, ok
  FROM (SELECT p.n, p.units, p.files, s.n AS m, len(p.units) < 20 AND NOT list_contains(p.units, s.unit_id) AND NOT (len(p.units) < 3 AND list_contains(p.files, s.asset_id)) AS ok FROM p JOIN s ON s.n = p.n + 1) x JOIN s ON s.n = x.m)
SELECT unit_id, asset_id, len(units) - 1 AS slot FROM p WHERE taken""")
def suggest_interleave(s: SparkSession, d: str) -> DataFrame:
    """As-you-type suggestions for a prefix."""
    units = T(s, d, "content_units")
    wanted = search.phrases("glac", prefix=True)
    own = search.ranked(text_index(s, d).match(wanted).withColumnRenamed("key", "unit_id"), "fts", 0, 20)
    hits = translation_index(s, d).match([Phrase(p.tokens, p.prefix, ("title", "text")) for p in wanted]).groupBy(F.substring_index("key", "\u0001", 1).alias("unit_id")).agg(F.max("score").alias("score"))
    of = units.select(F.col("id").alias("unit_id"), "asset_id").distinct()
    return folds.interleave(own.join(of, "unit_id"), search.ranked(hits, "translation", 1, 10).join(of, "unit_id"))


_CUT = "[^ \\t，。、；：？！…—·,.;:?!()（）\\[\\]【】<>《》\"''`\\n\\r]"


@query("completions", f"""
WITH u AS (SELECT DISTINCT id, text FROM content_units WHERE text IS NOT NULL), p AS (SELECT id, text, unnest(range(1, length(text) + 1)) AS pos FROM u WHERE regexp_matches(text, '(?i)g\\s*a\\s*n\\s*t')),
m AS (SELECT substr(text, pos, 40) AS rest, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM p WHERE lower(substr(text, pos, 1)) = 'g' AND regexp_matches(substr(text, pos, 60), '^(?i)g\\s*a\\s*n\\s*t')),
f AS (SELECT regexp_replace(regexp_extract(rest, '^(?s).{{4}}{_CUT}{{0,12}}'), '^\\s+|\\s+$', '', 'g') AS phrase FROM m WHERE k <= 4)
SELECT phrase, count(*) AS n FROM f WHERE length(phrase) > 4 AND length(phrase) <= 24 GROUP BY phrase ORDER BY n DESC, length(phrase), phrase LIMIT 8""")
def completions(s: SparkSession, d: str) -> DataFrame:
    """What most often follows a typed text."""
    return folds.completions(T(s, d, "content_units").select("id", "text").distinct(), "text", "gant")


_CONTEXT = match_sql(search.phrases("glacier telescope"))


@query("rag_context", f"SELECT string_agg('[' || r || '] ' || coalesce(title, '') || chr(10) || left(coalesce(text, ''), 600), chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT h.id, u.title, u.text, row_number() OVER (ORDER BY round(h.score, 6) DESC, h.id) AS r FROM ({_CONTEXT}) h JOIN (SELECT DISTINCT id, title, text FROM content_units) u ON u.id = h.id) WHERE r <= 12")
def rag_context(s: SparkSession, d: str) -> DataFrame:
    units = T(s, d, "content_units")
    hits = search.ranked(text_index(s, d).match(search.phrases("glacier telescope")).withColumnRenamed("key", "unit_id"), "fts", 0, 12)
    return folds.context_block(hits.join(units.select(F.col("id").alias("unit_id"), "title", "text").distinct(), "unit_id"), "rank0", "title", "text", 600, 12)


@query("group_filter", "SELECT DISTINCT id, path FROM assets WHERE path LIKE 'manuals/%' OR path LIKE 'plans/2024/%' OR path NOT LIKE '%/%'")
def group_filter(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "assets").filter(search.in_groups(F.col("path"), ("manuals", "plans/2024", "__ungrouped__"))).select("id", "path").distinct()


@query("mtime_filter", "SELECT DISTINCT id, mtime_ms FROM assets WHERE mtime_ms BETWEEN 1712000000000 AND 1735000000000")
def mtime_filter(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "assets").filter(search.in_window(F.col("mtime_ms"), 1712000000000, 1735000000000)).select("id", "mtime_ms").distinct()


@query("dir_paths", "SELECT DISTINCT id, regexp_extract(path, '^(.+)/[^/]*$', 1) AS dir_path FROM assets")
def dir_paths(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "assets").select("id", dirname(F.col("path")).alias("dir_path")).distinct()


_DEEP = "(SELECT min(id) AS id FROM content_units WHERE unit_type = 'slide' AND ordinal = 2)"


@query("deep_read_context", f"SELECT string_agg(left(coalesce(text, ''), 3000), chr(10) || chr(10) ORDER BY place) AS context FROM (SELECT u.text, CASE WHEN u.id = w.id THEN 0 ELSE u.ordinal END AS place FROM (SELECT DISTINCT id, asset_id, ordinal, text FROM content_units) u JOIN (SELECT DISTINCT id, asset_id, ordinal FROM content_units WHERE id = (SELECT id FROM {_DEEP})) w ON w.asset_id = u.asset_id WHERE u.ordinal BETWEEN greatest(1, w.ordinal - 1) AND w.ordinal + 1)")
def deep_read_context(s: SparkSession, d: str) -> DataFrame:
    """The unit asked about first, then its neighbours in order."""
    from tessera.operators.library import neighbours

    units = T(s, d, "content_units")
    one = units.filter("unit_type = 'slide' AND ordinal = 2").agg(F.min("id").alias("id")).filter("id IS NOT NULL")
    near = neighbours(units, one).join(units.select(F.col("id").alias("unit_id"), "text").distinct(), "unit_id")
    rows = near.select(F.struct(F.when(F.col("offset") == 0, 0).otherwise(F.col("ordinal")).alias("o"), F.left(F.coalesce("text", F.lit("")), F.lit(3000)).alias("t")).alias("x"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("context"))


@query("hit_kinds", f"SELECT a.kind, count(*) AS n FROM ({match_sql(search.phrases('glacier'))}) h JOIN (SELECT DISTINCT id, asset_id FROM content_units) u ON u.id = h.id JOIN (SELECT DISTINCT id, kind FROM assets) a ON a.id = u.asset_id GROUP BY a.kind")
def hit_kinds(s: SparkSession, d: str) -> DataFrame:
    units = T(s, d, "content_units")
    hits = text_index(s, d).match(search.phrases("glacier")).withColumnRenamed("key", "id").join(units.select("id", "asset_id").distinct(), "id")
    return hits.join(T(s, d, "assets").select(F.col("id").alias("asset_id"), "kind").distinct(), "asset_id").groupBy("kind").agg(F.count("*").alias("n"))


@query("snippet_parts")
def snippet_parts(s: SparkSession, d: str) -> DataFrame:
    """The pieces of the snippets of fts_snippet."""
    return fts_snippet(s, d).select("id", F.posexplode(search.snippet_parts(F.col("snippet"))).alias("part", "text"))


@query("fts_scan", ranked_sql(match_sql(search.phrases("glacier telescope")), 20))
def fts_scan(s: SparkSession, d: str) -> DataFrame:
    """A search without an index, of texts asked once only."""
    return search.top(search.match(search.index(T(s, d, "content_units")), search.phrases("glacier telescope")), 20)


@query("hybrid_snippets")
def hybrid_snippets(s: SparkSession, d: str) -> DataFrame:
    """The hits of hybrid_search with their snippets; the choice of a snippet's window has no SQL."""
    return search.with_snippets(hybrid_search(s, d), T(s, d, "content_units"), T(s, d, "unit_translations"), search.phrases("glacier telescope"))


@query("hybrid_filename", f"""
WITH f AS (SELECT u.asset_id, h.id AS unit_id, round(h.score, 6) AS score, row_number() OVER (PARTITION BY u.asset_id ORDER BY round(h.score, 6) DESC, h.id) AS r FROM ({match_sql(search.phrases("window", "filename"))}) h JOIN (SELECT DISTINCT id, asset_id FROM content_units) u ON u.id = h.id JOIN (SELECT DISTINCT id FROM assets) a ON a.id = u.asset_id),
k AS (SELECT unit_id, row_number() OVER (ORDER BY score DESC, unit_id) - 1 AS rank0 FROM f WHERE r = 1)
SELECT unit_id, round(1.0::DOUBLE / (61 + rank0), 9) AS score FROM k WHERE rank0 < 25""")
def hybrid_filename(s: SparkSession, d: str) -> DataFrame:
    """Search by file name: one unit per file, chosen ahead of the cut."""
    return run_hybrid(s, d, QuerySpec("window", 25, scope="filename")).select("unit_id", "score")


@query("index_maintenance", f"""
WITH kept AS (SELECT DISTINCT id, asset_id, title, text, file_name FROM content_units), gone AS (SELECT DISTINCT id FROM assets WHERE size_bytes % 5 = 0),
now AS (SELECT id, title, CASE WHEN ordinal = 1 THEN 'renewed glacier' ELSE text END AS text, file_name FROM (SELECT DISTINCT id, asset_id, ordinal, title, text, file_name FROM content_units) u WHERE asset_id NOT IN (SELECT id FROM gone))
SELECT id, round(score, 6) AS score FROM ({match_sql(search.phrases("glacier"), "now")}) ORDER BY round(score, 6) DESC, id LIMIT 50""")
def index_maintenance(s: SparkSession, d: str) -> DataFrame:
    """An index after its life: written, first units of files replaced, files deleted, then searched."""
    from tessera.session import shared_folder

    units = T(s, d, "content_units")
    index = inverted.build(s, units, f"{shared_folder(s)}/index/maintained-{uuid.uuid4().hex}")
    index.replace(units.filter("ordinal = 1").withColumn("text", F.lit("renewed glacier")))
    index.delete_assets(T(s, d, "assets").filter("size_bytes % 5 = 0").select(F.col("id").alias("asset_id")))
    return search.top(index.match(search.phrases("glacier")).withColumnRenamed("key", "id"), 50)


@query("index_heal", "SELECT count(DISTINCT id) AS units, count(DISTINCT id) AS linked, true AS consistent FROM content_units")
def index_heal(s: SparkSession, d: str) -> DataFrame:
    """An index that lacks some units, healed from the table."""
    from tessera.session import shared_folder

    units = T(s, d, "content_units")
    index = inverted.build(s, units.filter("ordinal > 1"), f"{shared_folder(s)}/index/healed-{uuid.uuid4().hex}")
    index.heal(units)
    return index.linkage(units)


@query("vector_topk_many", """
SELECT asked, vec_id, score FROM (SELECT asked, vec_id, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS r FROM (
  SELECT q.vec_id AS asked, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)) WHERE r <= 10""")
def vector_topk_many(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all."""
    v = T(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    dim = v.select(F.size("vector")).first()[0]
    return search.nearest_units(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("asked"), F.col("vector").alias("q")), 10, "vec_id", dim, by="asked")
