"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.canonical import changed_values

    return changed_values(table(spark, d, "content_units"), "id", ["title", "text", "file_name"]).select(F.col("id").alias("unit_id"), "field").distinct()


@query
def p7_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with its three values in the consistent form."""
    from tessera.llm.canonical import canonicalize

    units = table(spark, d, "content_units").select(F.col("id").alias("unit_id"), "title", "text", "file_name").distinct()
    return canonicalize(units, ["title", "text", "file_name"])


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.split import oversized

    return oversized(table(spark, d, "content_units"), "id", "text", 4000).withColumnRenamed("id", "unit_id")


@query
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.split import split

    return split(table(spark, d, "content_units"), "id", "text", 4000, 200).withColumnRenamed("id", "unit_id")


_BLANK = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NO_LINE = _BLANK.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")
# A level is enough when nothing between two of its boundaries is longer than the limit.
SQL["p4_found"] = rf"""
WITH t AS (SELECT DISTINCT id, regexp_replace(text, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS t FROM content_units WHERE length(text) > 4000),
p AS (SELECT id, t, regexp_replace(t, '\n[{_NO_LINE}]*(\n[{_NO_LINE}]*)+', chr(1), 'g') AS p FROM t WHERE length(t) > 4000),
s AS (SELECT id, t, p, regexp_replace(regexp_replace(p, '([.!?])[{_BLANK}]+', '\1' || chr(1), 'g'), '([。！？])[{_BLANK}]*', '\1' || chr(1), 'g') AS s, regexp_replace(t, '[{_BLANK}]+', chr(1), 'g') AS w FROM p),
m AS (SELECT id, list_max(list_transform(string_split(p, chr(1)), lambda x: length(x))) AS lp, list_max(list_transform(string_split(s, chr(1)), lambda x: length(x))) AS ls, list_max(list_transform(string_split(w, chr(1)), lambda x: length(x))) AS lw FROM s)
SELECT id AS unit_id, CASE WHEN lp <= 4000 THEN 'paragraph' WHEN ls <= 4000 THEN 'sentence' WHEN lw <= 4000 THEN 'word' ELSE 'hard' END AS cut FROM m"""


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.boilerplate import find_repeated

    return find_repeated(table(spark, d, "page_blocks"), "block_id", "source_id", "asset_id", "text")


@query
def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.boilerplate import remove_repeated

    blocks = table(spark, d, "page_blocks").select("block_id", "source_id", "asset_id", "text").distinct()
    return remove_repeated(blocks, "block_id", "source_id", "asset_id", "text").select("block_id", "clean_text", "removed")


SQL["p5_found"] = r"""
WITH l AS (
  SELECT DISTINCT block_id, source_id, asset_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no,
         regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\p{L}]+', '', 'g') AS k
  FROM page_blocks WHERE text IS NOT NULL AND source_id IS NOT NULL AND asset_id IS NOT NULL),
a AS (SELECT source_id, count(DISTINCT asset_id) AS assets FROM page_blocks WHERE asset_id IS NOT NULL GROUP BY source_id),
c AS (SELECT source_id, k, count(DISTINCT asset_id) AS n FROM l WHERE k <> '' GROUP BY source_id, k)
SELECT DISTINCT block_id, line_no FROM l JOIN c USING (source_id, k) JOIN a USING (source_id)
WHERE n >= 3 AND n >= 0.15 * assets
"""


SQL["p5_clean"] = f"""
WITH f AS ({SQL["p5_found"]}), b AS (SELECT DISTINCT block_id, source_id, asset_id, text FROM page_blocks),
x AS (SELECT block_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM b WHERE text IS NOT NULL),
k AS (SELECT x.block_id, string_agg(line, chr(10) ORDER BY x.line_no) FILTER (WHERE f.block_id IS NULL) AS kept, count(f.block_id) AS gone FROM x LEFT JOIN f ON f.block_id = x.block_id AND f.line_no = x.line_no GROUP BY x.block_id)
SELECT b.block_id, CASE WHEN b.text IS NOT NULL THEN coalesce(k.kept, '') END AS clean_text, coalesce(k.gone, 0)::INTEGER AS removed FROM b LEFT JOIN k USING (block_id)"""


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.encode import encode

    return encode(table(spark, d, "documents"), "doc_id", "text")


#: Tokens that a container of problem 9 holds.
CAPACITY = 2048


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, piece_no, start, size, container) of every document, sizes in tokens of byte_bpe_50k."""
    from tessera.llm.pack import pack, token_counts

    return pack(token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "size", CAPACITY)


def vectors_of_units(spark: SparkSession, d: str) -> DataFrame:
    """(vec_key, vector) of the units' and the translations' vectors, as one collection."""
    units = table(spark, d, "unit_embeddings").select(F.col("unit_id").alias("vec_key"), "vector")
    translations = table(spark, d, "unit_translation_embeddings").select(F.concat_ws(" ", "unit_id", F.coalesce("lang", F.lit(""))).alias("vec_key"), "vector")
    return units.unionByName(translations)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.neighbours import nearest

    near = nearest(vectors_of_units(spark, d), "vec_key", "vector", 64, 5, 0.88)
    return near.select(F.least("key", "neighbour").alias("vec_key_a"), F.greatest("key", "neighbour").alias("vec_key_b")).distinct()


@query
def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose key's hash is divisible by 50, against all, however unlike."""
    from tessera.llm.neighbours import nearest_of

    v = vectors_of_units(spark, d)
    return nearest_of(v, v.filter(F.pmod(F.xxhash64("vec_key"), F.lit(50)) == 0), "vec_key", "vector", 64, 5).select(F.col("key").alias("vec_key"), "neighbour", F.round("cos", 4).alias("cos"), "rank")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.versions import version_links

    return version_links(table(spark, d, "content_units"), "id", "title", "text").withColumnsRenamed({"key_a": "unit_id_a", "key_b": "unit_id_b"})


def label_judgements(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.language import dictionaries, judged

    return judged(table(spark, d, "unit_translations"), table(spark, d, "content_units"), dictionaries(table(spark, d, "lang_samples")))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.language import wrong_labels

    return wrong_labels(label_judgements(spark, d))


@query
def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every judged text, with its language and confidence."""
    return label_judgements(spark, d).select("tr_id", "field", F.inline("segments"))


def subject_shares(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.subjects import labelled, subjects_of, train

    documents = table(spark, d, "documents")
    names = sorted(r["subject"] for r in table(spark, d, "subjects").select("subject").collect())  # the fixed list of subjects
    model = train(labelled(documents, table(spark, d, "subject_labels"), "doc_id", "text", "subject", "none"), "doc_id", "text", names)
    return subjects_of(documents, "doc_id", "text", model, names)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_shares(spark, d).select("doc_id", "subject").distinct()


@query
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject and their share of all documents with text."""
    n = table(spark, d, "documents").filter(F.trim("text") != "").agg(F.count("*").alias("all"))
    return subject_shares(spark, d).groupBy("subject").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(n)).select("subject", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.scans import scan_defects

    return scan_defects(table(spark, d, "content_units"), "id", "asset_id", "ordinal", "text").withColumnRenamed("key", "unit_id")


@query
def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.scans import repair

    return repair(table(spark, d, "content_units"), "id", "asset_id", "ordinal", "text").withColumnRenamed("key", "unit_id")
