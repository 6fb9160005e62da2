"""Access, library, pipeline, text and layout operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import records as R
from tessera.functions import text as X
from tessera.operators import access, folds, layout, library, pipeline
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import files

T = table
USER = "user-03"
DIR = "regexp_extract(path, '^(.+)/[^/]*$', 1)"

# Access entries, made from the files by rule: the tables hold none.
_ENTRIES = f"""
SELECT DISTINCT 'user' AS subject_type, 'user-0' || (size_bytes % 5) AS subject_id, 'asset' AS target_type, id AS target_id, CASE size_bytes % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'deny' END AS level FROM assets WHERE size_bytes % 7 = 0
UNION ALL SELECT DISTINCT 'group', 'g' || (size_bytes % 4), 'asset', id, CASE size_bytes % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'write' ELSE 'read' END FROM assets WHERE size_bytes % 11 = 0
UNION ALL SELECT DISTINCT 'group', 'g' || (length(dir) % 4), 'dir', dir, CASE length(dir) % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'deny' END FROM (SELECT {DIR} AS dir FROM assets) WHERE length(dir) % 2 = 0
UNION ALL SELECT DISTINCT 'user', 'user-0' || (length(dir) % 5), 'dir', dir, CASE length(dir) % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'write' ELSE 'read' END FROM (SELECT {DIR} AS dir FROM assets) WHERE length(dir) % 3 = 0"""
_MEMBERS = "SELECT DISTINCT 'user-0' || (c_custkey % 5) AS user_id, 'g' || (c_nationkey % 3) AS group_id FROM customer"
_PUBLIC = f"SELECT DISTINCT {DIR} AS dir FROM assets WHERE length({DIR}) % 5 = 0 AND {DIR} <> ''"


def entries(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "assets")
    size, of = F.col("size_bytes"), a.select(X.dirname(F.col("path")).alias("dir")).distinct()
    n = F.length("dir")

    def rows(df: DataFrame, subject: str, who, kind: str, what: str, level) -> DataFrame:
        return df.select(F.lit(subject).alias("subject_type"), F.concat(F.lit("user-0" if subject == "user" else "g"), who.cast("string")).alias("subject_id"), F.lit(kind).alias("target_type"), F.col(what).alias("target_id"), level.alias("level")).distinct()

    pick = lambda c, names: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    return (
        rows(a.filter(size % 7 == 0), "user", size % 5, "asset", "id", pick(size % 3, ("read", "write", "deny")))
        .unionByName(rows(a.filter(size % 11 == 0), "group", size % 4, "asset", "id", pick(size % 5, ("deny", "write", "read", "read", "read"))))
        .unionByName(rows(of.filter(n % 2 == 0), "group", n % 4, "dir", "dir", pick(n % 3, ("read", "write", "deny"))))
        .unionByName(rows(of.filter(n % 3 == 0), "user", n % 5, "dir", "dir", pick(n % 4, ("deny", "write", "read", "read"))))
    )


def members(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "customer")
    return c.select(F.concat(F.lit("user-0"), (F.col("c_custkey") % 5).cast("string")).alias("user_id"), F.concat(F.lit("g"), (F.col("c_nationkey") % 3).cast("string")).alias("group_id")).distinct()


def levels(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "assets")
    dirs = a.select(X.dirname(F.col("path")).alias("dir")).distinct().filter((F.length("dir") % 5 == 0) & (F.col("dir") != ""))
    return access.levels(a, entries(s, d), members(s, d), USER, dirs)


_CHAIN = "SELECT id, depth, array_to_string(list_slice(parts, 1, len(parts) - 1 - depth), '/') AS dir FROM (SELECT id, string_split(path, '/') AS parts, unnest(generate_series(0, len(string_split(path, '/')) - 1)) AS depth FROM (SELECT DISTINCT id, path FROM assets))"
_LEVELS = f"""
WITH e AS ({_ENTRIES}), g AS (SELECT group_id FROM ({_MEMBERS}) WHERE user_id = '{USER}'),
m AS (SELECT target_type, target_id, CASE subject_type WHEN 'user' THEN 0 ELSE 1 END AS tier, max(CASE level WHEN 'deny' THEN 3 WHEN 'write' THEN 2 ELSE 1 END) AS n FROM e
      WHERE (subject_type = 'user' AND subject_id = '{USER}') OR (subject_type = 'group' AND subject_id IN (SELECT group_id FROM g)) GROUP BY 1, 2, 3),
p AS (SELECT target_type, target_id, min_by(n, tier) AS n FROM m GROUP BY 1, 2), c AS ({_CHAIN}),
h AS (SELECT target_id AS id, -1 AS depth, n FROM p WHERE target_type = 'asset' UNION ALL SELECT c.id, c.depth, p.n FROM c JOIN p ON p.target_type = 'dir' AND p.target_id = c.dir),
w AS (SELECT id, min_by(n, depth) AS n FROM h GROUP BY id), pub AS (SELECT DISTINCT c.id FROM c JOIN ({_PUBLIC}) q ON q.dir = c.dir)
SELECT a.id AS asset_id, CASE w.n WHEN 3 THEN 'none' WHEN 2 THEN 'write' WHEN 1 THEN 'read' ELSE CASE WHEN a.visibility = 'public' OR pub.id IS NOT NULL THEN 'read' ELSE 'none' END END AS level
FROM (SELECT DISTINCT id, visibility FROM assets) a LEFT JOIN w ON w.id = a.id LEFT JOIN pub ON pub.id = a.id"""

query("access_levels", _LEVELS)(levels)
query("readable_assets", f"SELECT l.asset_id FROM ({_LEVELS}) l JOIN (SELECT DISTINCT id, uploaded_by FROM assets) a ON a.id = l.asset_id WHERE l.level <> 'none' OR a.uploaded_by = '{USER}'")(lambda s, d: access.readable(T(s, d, "assets"), levels(s, d), USER))
query("writable_assets", f"SELECT l.asset_id FROM ({_LEVELS}) l JOIN (SELECT DISTINCT id, uploaded_by FROM assets) a ON a.id = l.asset_id WHERE l.level = 'write' OR a.uploaded_by = '{USER}'")(lambda s, d: access.writable(T(s, d, "assets"), levels(s, d), USER))
query("group_members", f"SELECT group_id, count(*) AS n, string_agg(user_id, ',' ORDER BY user_id) AS users FROM ({_MEMBERS}) GROUP BY group_id")(lambda s, d: members(s, d).groupBy("group_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("user_id")), ",").alias("users")))

# The library.
query("dir_chain", _CHAIN)(lambda s, d: T(s, d, "assets").select("id", "path").distinct().select("id", F.posexplode(X.dir_chain(F.col("path"))).alias("depth", "dir")))
_TREE = f"SELECT dir, CASE WHEN dir <> '' THEN regexp_extract(dir, '^(.+)/[^/]*$', 1) END AS parent, string_split(dir, '/')[-1] AS name, count(*) FILTER (WHERE depth = 0) AS direct, count(*) AS below FROM ({_CHAIN}) GROUP BY dir"
query("group_tree", _TREE)(lambda s, d: library.folder_tree(T(s, d, "assets")))
query("group_children", f"SELECT parent AS dir, dir AS child, below AS child_files FROM ({_TREE}) WHERE parent IS NOT NULL")(lambda s, d: library.children(library.folder_tree(T(s, d, "assets"))))
_A = "(SELECT DISTINCT * FROM assets)"
for _name, _sort, _down, _order in (("library_by_upload", "uploaded", True, "coalesce(uploaded_at, extracted_at) DESC NULLS LAST"), ("library_by_size", "size", False, "size_bytes ASC NULLS FIRST"), ("library_by_name", "name", False, "string_split(path, '/')[-1] ASC NULLS FIRST"), ("library_by_mtime", "mtime", True, "mtime_ms DESC NULLS LAST")):
    query(_name, f"SELECT id, path, kind, size_bytes FROM {_A} WHERE path LIKE 'manuals/%' AND (contains(lower(path), 'e') OR contains(lower(kind), 'e')) ORDER BY {_order}, id LIMIT 40 OFFSET 40")(
        lambda s, d, sort=_sort, down=_down: library.listing(T(s, d, "assets"), "manuals", None, "e", sort, down, 2, 40)[0].select("id", "path", "kind", "size_bytes")
    )
query("library_total", f"SELECT count(*) AS total FROM {_A} WHERE path NOT LIKE '%/%' AND kind = 'pdf'")(lambda s, d: library.listing(T(s, d, "assets"), "ungrouped", "pdf")[1])
query("folder_rename", "SELECT DISTINCT id, CASE WHEN starts_with(path, 'plans/') THEN 'projects/archive' || substr(path, 6) ELSE path END AS path FROM assets")(lambda s, d: library.renamed(T(s, d, "assets"), "plans", "projects/archive").select("id", "path").distinct())
_U = "(SELECT DISTINCT * FROM content_units)"
query("neighbour_context", f"SELECT w.id AS asked, u.id AS unit_id, u.ordinal, u.ordinal - w.ordinal AS \"offset\" FROM {_U} w JOIN {_U} u ON u.asset_id = w.asset_id AND u.ordinal BETWEEN greatest(1, w.ordinal - 2) AND w.ordinal + 1 WHERE w.unit_type = 'slide'")(
    lambda s, d: library.neighbours(T(s, d, "content_units"), T(s, d, "content_units").filter("unit_type = 'slide'"), 2, 1)
)
query("missing_embeddings", "SELECT DISTINCT id AS unit_id FROM content_units WHERE coalesce(text, '') <> '' AND id NOT IN (SELECT unit_id FROM unit_embeddings)")(lambda s, d: library.without_embedding(T(s, d, "content_units"), T(s, d, "unit_embeddings")))
query("missing_translations", "SELECT DISTINCT id AS unit_id FROM content_units WHERE (coalesce(text, '') <> '' OR coalesce(title, '') <> '') AND id NOT IN (SELECT unit_id FROM unit_translations WHERE lang = 'zh')")(lambda s, d: library.without_translation(T(s, d, "content_units"), T(s, d, "unit_translations"), "zh"))
query("translation_status", """
WITH t AS (SELECT count(DISTINCT id) AS total FROM content_units WHERE coalesce(text, '') <> '' OR coalesce(title, '') <> ''), l AS (SELECT unnest(['en', 'zh', 'de', 'xx']) AS lang),
c AS (SELECT lang, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM (SELECT DISTINCT unit_id, lang, status FROM unit_translations) GROUP BY lang)
SELECT l.lang, total, coalesce(ok, 0) AS ok, coalesce(skipped, 0) AS skipped, least(total, coalesce(ok, 0) + coalesce(skipped, 0)) AS done, total - least(total, coalesce(ok, 0) + coalesce(skipped, 0)) AS missing, coalesce(ok, 0) + coalesce(skipped, 0) >= total AS complete FROM l LEFT JOIN c USING (lang) CROSS JOIN t""")(lambda s, d: library.translation_status(T(s, d, "content_units"), T(s, d, "unit_translations"), ["en", "zh", "de", "xx"]))
query("embedding_coverage", "SELECT (SELECT count(DISTINCT id) FROM content_units) AS units, (SELECT count(DISTINCT unit_id) FROM unit_embeddings) AS vectors")(lambda s, d: library.embedding_coverage(T(s, d, "content_units"), T(s, d, "unit_embeddings")))
_UPLOADS = "SELECT DISTINCT id AS pos, CASE WHEN size_bytes % 3 = 0 THEN path WHEN size_bytes % 7 = 0 THEN NULL ELSE 'new/' || path END AS path, CASE WHEN size_bytes % 5 = 0 THEN content_hash ELSE 'x' || id END AS hash FROM assets"


@query("upload_preflight", f"SELECT u.pos, u.path, CASE WHEN coalesce(u.path, '') = '' THEN 'error' WHEN u.hash IN (SELECT content_hash FROM assets WHERE content_hash IS NOT NULL) THEN 'same-hash' WHEN u.path IN (SELECT path FROM assets) THEN 'same-name' ELSE 'ok' END AS verdict FROM ({_UPLOADS}) u")
def upload_preflight(s: SparkSession, d: str) -> DataFrame:
    a, n = T(s, d, "assets"), F.col("size_bytes")
    uploads = a.select(F.col("id").alias("pos"), F.when(n % 3 == 0, F.col("path")).when(n % 7 == 0, None).otherwise(F.concat(F.lit("new/"), "path")).alias("path"), F.when(n % 5 == 0, F.col("content_hash")).otherwise(F.concat(F.lit("x"), "id")).alias("hash")).distinct()
    return library.preflight(uploads, a)


_PREFIXES = "SELECT * FROM (VALUES (1, 'man', 'm'), (2, 'plans/20', 'p20'), (3, 'plans', 'p'), (4, 'manuals', 'late'), (5, 'a', 'a'), (6, '', 'rest')) t(pos, prefix, meta)"
query("first_prefix_join", f"SELECT a.id, (SELECT min_by(meta, pos) FROM ({_PREFIXES}) m WHERE starts_with(a.path, m.prefix)) AS meta FROM (SELECT DISTINCT id, path FROM assets) a")(
    lambda s, d: library.first_prefix(T(s, d, "assets").select("id", "path").distinct(), s.createDataFrame([(1, "man", "m"), (2, "plans/20", "p20"), (3, "plans", "p"), (4, "manuals", "late"), (5, "a", "a"), (6, "", "rest")], "pos int, prefix string, meta string")).select("id", "meta")
)
query("purge_units", "SELECT DISTINCT id AS unit_id FROM content_units WHERE asset_id NOT IN (SELECT id FROM assets WHERE extraction_status = 'failed')")(
    lambda s, d: library.purge({"units": T(s, d, "content_units")}, T(s, d, "assets").filter("extraction_status = 'failed'").select(F.col("id").alias("asset_id")))["units"].select(F.col("id").alias("unit_id")).distinct()
)
query("upsert_translations", "SELECT tr_id, status FROM (SELECT DISTINCT tr_id, status FROM unit_translations WHERE tr_id % 3 <> 0 UNION ALL SELECT DISTINCT tr_id, 'renewed' FROM unit_translations WHERE tr_id % 3 = 0)")(
    lambda s, d: library.replace_by_key(T(s, d, "unit_translations").select("tr_id", "status").distinct(), T(s, d, "unit_translations").filter("tr_id % 3 = 0").select("tr_id", F.lit("renewed").alias("status")).distinct(), ["tr_id"])
)

# The pipeline.
_FOUND = "CASE WHEN size_bytes % 4 = 0 THEN mtime_ms + 1 ELSE mtime_ms END AS mtime_ms, CASE WHEN size_bytes % 9 = 0 THEN 'changed' ELSE content_hash END AS content_hash, CASE WHEN size_bytes % 17 = 0 THEN 'other' ELSE kind END AS kind, size_bytes % 19 = 0 AS oversized"
_DISK = f"SELECT path, size_bytes, {_FOUND} FROM (SELECT DISTINCT * FROM assets) WHERE size_bytes % 10 <> 0 UNION ALL SELECT 'fresh/' || path, size_bytes, {_FOUND} FROM (SELECT DISTINCT * FROM assets) WHERE size_bytes % 13 = 0"


@query("scan_reconcile", f"""
WITH j AS (SELECT coalesce(d.path, a.path) AS path, a.path IS NULL AS fresh, d.path IS NULL AS gone, a.source_id, a.extraction_status AS before, d.kind IN ('text', 'pdf', 'presentation', 'document', 'spreadsheet', 'image', 'video', 'audio', 'archive') AND NOT d.oversized AS can,
  coalesce(d.content_hash, '') <> coalesce(a.content_hash, '') AND NOT d.oversized AS rehashed, d.size_bytes IS DISTINCT FROM a.size_bytes OR d.mtime_ms IS DISTINCT FROM a.mtime_ms OR d.kind IS DISTINCT FROM a.kind AS restated
  FROM ({_DISK}) d FULL JOIN {_A} a ON a.path = d.path),
r AS (SELECT *, CASE WHEN fresh THEN 'insert' WHEN gone AND source_id = 'src-07' THEN 'delete' WHEN gone THEN 'skip' WHEN rehashed OR restated THEN 'update' ELSE 'skip' END AS action FROM j)
SELECT path, action, CASE WHEN action IN ('skip', 'delete') THEN before WHEN NOT coalesce(can, false) THEN 'skipped' WHEN fresh OR rehashed THEN 'pending' WHEN before IN ('done', 'failed') THEN before ELSE 'pending' END AS status,
  coalesce(action IN ('insert', 'update') AND can AND (fresh OR rehashed), false) AS enqueue FROM r""")
def scan_reconcile(s: SparkSession, d: str) -> DataFrame:
    a, n = T(s, d, "assets").distinct(), F.col("size_bytes")
    found = (F.when(n % 4 == 0, F.col("mtime_ms") + 1).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.when(n % 9 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), F.when(n % 17 == 0, "other").otherwise(F.col("kind")).alias("kind"), (n % 19 == 0).alias("oversized"))
    kept = a.filter(n % 10 != 0).select("path", "size_bytes", *found)
    return pipeline.reconcile(kept.unionByName(a.filter(n % 13 == 0).select(F.concat(F.lit("fresh/"), "path").alias("path"), "size_bytes", *found)), a, "src-07")


_SINCE = 1500
query("last_ops", "SELECT unit_id, max_by(op, version) AS op, max(version) AS version FROM index_log GROUP BY unit_id")(lambda s, d: pipeline.last_ops(T(s, d, "index_log")))
_BUNDLE = f"SELECT u.id AS unit_id, u.asset_id, u.ordinal, u.unit_type, u.title, u.text, u.thumb_path IS NOT NULL AS has_thumb, u.hidden, a.path, a.kind, a.mtime_ms, string_split(a.path, '/')[-1] AS file_name, regexp_extract(a.path, '^(.+)/[^/]*$', 1) AS dir_path FROM {_U} u JOIN (SELECT DISTINCT id, path, kind, mtime_ms FROM assets) a ON a.id = u.asset_id"
query("full_bundle", _BUNDLE)(lambda s, d: pipeline.bundle(T(s, d, "content_units"), T(s, d, "assets")))
query("delta_since", f"""
WITH l AS (SELECT unit_id, max_by(op, version) AS op FROM index_log WHERE version > {_SINCE} GROUP BY unit_id), b AS ({_BUNDLE})
SELECT l.unit_id, CASE WHEN l.op = 'upsert' AND b.unit_id IS NOT NULL THEN 'upsert' ELSE 'remove' END AS op, CASE WHEN l.op = 'upsert' THEN b.asset_id END AS asset_id, CASE WHEN l.op = 'upsert' THEN b.title END AS title, CASE WHEN l.op = 'upsert' THEN b.dir_path END AS dir_path FROM l LEFT JOIN b USING (unit_id)""")(
    lambda s, d: pipeline.delta(T(s, d, "index_log"), T(s, d, "content_units"), T(s, d, "assets"), _SINCE)
)
query("current_version", "SELECT coalesce(max(version), 0) AS version FROM index_log")(lambda s, d: pipeline.current_version(T(s, d, "index_log")))
query("source_counts", f"SELECT s.id, s.root_path, count(a.id) AS asset_count, count(a.id) FILTER (WHERE a.extraction_status = 'done') AS done_count FROM sources s LEFT JOIN {_A} a ON a.source_id = s.id GROUP BY 1, 2")(lambda s, d: pipeline.source_counts(T(s, d, "sources"), T(s, d, "assets")))
query("fencing_join", f"SELECT u.id AS unit_id FROM {_U} u JOIN {_A} a ON a.id = u.asset_id WHERE a.content_hash IS NOT NULL AND a.size_bytes % 6 <> 0")(
    lambda s, d: pipeline.fenced(T(s, d, "content_units").distinct().join(T(s, d, "assets").select(F.col("id").alias("asset_id"), F.when(F.col("size_bytes") % 6 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash")).distinct(), "asset_id"), T(s, d, "assets")).select(F.col("id").alias("unit_id"))
)
query("new_jobs", "SELECT DISTINCT asset_id, 'embed' AS kind FROM content_units WHERE asset_id NOT IN (SELECT id FROM assets WHERE extraction_status = 'pending')")(
    lambda s, d: pipeline.new_jobs(T(s, d, "content_units").select("asset_id", F.lit("embed").alias("kind")), T(s, d, "assets").filter("extraction_status = 'pending'").select(F.col("id").alias("asset_id"), F.lit("embed").alias("kind")), ["asset_id", "kind"])
)
query("kind_counts", "SELECT kind, count(DISTINCT id) AS n FROM assets GROUP BY kind")(lambda s, d: T(s, d, "assets").groupBy("kind").agg(F.count_distinct("id").alias("n")))
query("pipeline_snapshot", f"SELECT count(*) AS total, count(*) FILTER (WHERE extraction_status = 'done') AS done, count(*) FILTER (WHERE extraction_status = 'running') AS running FROM {_A}")(
    lambda s, d: T(s, d, "assets").distinct().agg(F.count("*").alias("total"), F.count_if(F.col("extraction_status") == "done").alias("done"), F.count_if(F.col("extraction_status") == "running").alias("running"))
)
query("export_groups", f"SELECT asset_id, count(*) AS units, string_agg(ordinal, ',' ORDER BY ordinal) AS ordinals FROM {_U} WHERE unit_type = 'slide' AND ordinal % 2 = 1 GROUP BY asset_id")(
    lambda s, d: T(s, d, "content_units").distinct().filter("unit_type = 'slide' AND ordinal % 2 = 1").groupBy("asset_id").agg(F.count("*").alias("units"), F.array_join(F.transform(F.sort_array(F.collect_list("ordinal")), lambda x: x.cast("string")), ",").alias("ordinals"))
)
query("recent_changes", "SELECT DISTINCT version, op, unit_id FROM index_log ORDER BY version DESC LIMIT 100")(lambda s, d: T(s, d, "index_log").select("version", "op", "unit_id").distinct().orderBy(F.desc("version")).limit(100))
_EDGES = "SELECT DISTINCT unit_id AS src, asset_id AS dst FROM unit_translations UNION SELECT DISTINCT asset_id, id FROM content_units WHERE ordinal <= 3 UNION SELECT DISTINCT id, asset_id FROM content_units WHERE ordinal > 3"


@query("closure", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT unit_id AS node FROM unit_translations UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT node FROM r")
def closure(s: SparkSession, d: str) -> DataFrame:
    tr, u = T(s, d, "unit_translations"), T(s, d, "content_units")
    e = tr.select(F.col("unit_id").alias("src"), F.col("asset_id").alias("dst")).unionByName(u.filter("ordinal <= 3").select(F.col("asset_id").alias("src"), F.col("id").alias("dst"))).unionByName(u.filter("ordinal > 3").select(F.col("id").alias("src"), F.col("asset_id").alias("dst"))).distinct()
    return pipeline.closure(tr.select(F.col("unit_id").alias("node")), e)


# Text functions over whole columns.
_SP = r"[\s 　]"
_N = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_SCRIPTS = {"kana": _N(r"[\x{3040}-\x{30FF}]"), "hangul": _N(r"[\x{AC00}-\x{D7AF}]"), "han": _N(r"[\x{3400}-\x{9FFF}]"), "cyr": _N(r"[\x{0400}-\x{04FF}]"), "lat": _N(r"[A-Za-z\x{00C0}-\x{024F}]")}
query("detect_script", f"SELECT id, CASE WHEN kana + hangul + han + cyr + lat < 2 THEN NULL WHEN kana > 0 THEN 'ja' WHEN hangul > 0 AND hangul >= han THEN 'ko' WHEN han > 0 AND han >= lat THEN 'zh' WHEN cyr > 0 AND cyr >= lat THEN 'ru' WHEN text IS NOT NULL THEN 'en' END AS lang FROM (SELECT id, text, {', '.join(f'{v} AS {k}' for k, v in _SCRIPTS.items())} FROM {_U})")(
    lambda s, d: T(s, d, "content_units").distinct().select("id", X.script_language(F.col("text")).alias("lang"))
)
query("title_first_line", f"SELECT id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), lambda x: x <> '')[1], 120) AS title FROM {_U}")(
    lambda s, d: T(s, d, "content_units").distinct().select("id", X.first_line_title(F.col("text")).alias("title"))
)
query("embedding_input", f"SELECT id, CASE WHEN h = '' THEN b ELSE h || chr(10) || b END AS input FROM (SELECT id, regexp_replace(coalesce(title, ''), '^{_SP}+|{_SP}+$', '', 'g') AS h, left(regexp_replace(coalesce(text, ''), '^{_SP}+|{_SP}+$', '', 'g'), 4000) AS b FROM {_U})")(
    lambda s, d: T(s, d, "content_units").distinct().select("id", X.embedding_input(F.col("title"), F.col("text")).alias("input"))
)
query("upload_names", r"SELECT DISTINCT id, coalesce(nullif(right(regexp_replace(string_split(path, '/')[-1], '[^\p{L}\p{N}._-]+', '_', 'g'), 120), ''), 'file') AS name FROM assets")(lambda s, d: T(s, d, "assets").select("id", X.upload_name(F.col("path")).alias("name")).distinct())
query("artifact_names", "SELECT DISTINCT id, coalesce(nullif(regexp_replace(regexp_replace(string_split(path, '/')[-1], '[^A-Za-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'export') AS name FROM assets")(lambda s, d: T(s, d, "assets").select("id", X.artifact_name(X.basename(F.col("path"))).alias("name")).distinct())
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
query("scan_classify", f"""SELECT DISTINCT id, CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio'
  WHEN {_EXT} IN ('pptx', 'ppt', 'key') THEN 'presentation' WHEN {_EXT} IN ('docx', 'doc') THEN 'document' WHEN {_EXT} IN ('xlsx', 'xls', 'numbers') THEN 'spreadsheet' WHEN {_EXT} = 'pdf' THEN 'pdf'
  WHEN {_EXT} IN ('txt', 'md', 'markdown', 'csv', 'json', 'tex', 'bib', 'log') THEN 'text' WHEN {_EXT} IN ('png', 'jpg', 'jpeg', 'webp', 'gif', 'bmp', 'heic', 'tiff', 'svg') THEN 'image'
  WHEN {_EXT} IN ('mp4', 'mov', 'mkv', 'avi', 'webm') THEN 'video' WHEN {_EXT} IN ('mp3', 'wav', 'flac', 'aac', 'm4a') THEN 'audio' WHEN {_EXT} IN ('epub', 'zip', '7z', 'rar', 'tar', 'gz') THEN 'archive' ELSE 'other' END AS kind FROM assets""")(
    lambda s, d: T(s, d, "assets").select("id", files.kind_of(F.col("path"), F.col("mime")).alias("kind")).distinct()
)
query("ignore_filter", "SELECT DISTINCT id, path FROM assets WHERE NOT (regexp_matches(path, '(^|/)\\.') OR regexp_matches(path, '(^|/)(node_modules|target|dist|data|__MACOSX)/') OR path LIKE '%.zip' OR starts_with(path, 'archiv/'))")(
    lambda s, d: T(s, d, "assets").filter(~files.ignored(F.col("path"), ["*.zip", "archiv/*"])).select("id", "path").distinct()
)
query("timecodes", f"SELECT id, printf('%02d:%02d', start_ms // 60000, start_ms // 1000 % 60) AS at FROM {_U} WHERE start_ms IS NOT NULL")(lambda s, d: T(s, d, "content_units").distinct().filter("start_ms IS NOT NULL").select("id", X.timecode(F.col("start_ms")).alias("at")))
_SOLID = "regexp_replace(text, '\\s+', '', 'g')"
_ODD = "[^\\x{21}-\\x{7E}\\x{A1}-\\x{17F}\\x{370}-\\x{52F}\\x{2010}-\\x{2026}\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]"
query("mojibake_ratio", f"SELECT id, round(len(regexp_extract_all({_SOLID}, '{_ODD}')) / length({_SOLID}), 6) AS ratio FROM {_U} WHERE length({_SOLID}) > 0")(
    lambda s, d: T(s, d, "content_units").distinct().filter(F.length(F.regexp_replace("text", r"\s+", "")) > 0).select("id", F.round(X.implausible_ratio(F.col("text")), 6).alias("ratio"))
)
query("page_numbers", r"SELECT DISTINCT block_id, coalesce(regexp_matches(trim(text), '^-?\s*\d+\s*-?$|^\d+\s*/\s*\d+$'), false) AS is_number FROM page_blocks")(lambda s, d: T(s, d, "page_blocks").select("block_id", F.coalesce(X.is_page_number(F.col("text")), F.lit(False)).alias("is_number")).distinct())
_WIDE = "⺀-鿿가-힯豈-﫿＀-￯—‘’“”…"
query("cjk_join", f"SELECT id, replace(regexp_replace(regexp_replace(j, '([{_WIDE}])' || chr(1) || '([{_WIDE}])', '\\1\\2', 'g'), '([{_WIDE}])' || chr(1) || '([{_WIDE}])', '\\1\\2', 'g'), chr(1), ' ') AS joined FROM (SELECT id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), lambda x: x <> ''), chr(1)) AS j FROM {_U})")(lambda s, d: T(s, d, "content_units").distinct().select("id", X.join_runs(F.split(F.coalesce("text", F.lit("")), "\n")).alias("joined")))
query("glyph_spacing")(lambda s, d: T(s, d, "content_units").distinct().select("id", X.glyph_spacing(F.col("text")).alias("text")))
query("html_to_text", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[^\\x{21}-\\x{24F}\\x{370}-\\x{52F}\\x{3040}-\\x{9FFF}\\x{AC00}-\\x{D7AF} \\n]+', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM (SELECT doc_id, regexp_replace(text, '[\\x{7F}-\\x{A0}]+', '', 'g') AS text FROM documents)")(
    lambda s, d: T(s, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"[\x{7F}-\x{A0}]+", ""), r"[^\x{21}-\x{24F}\x{370}-\x{52F}\x{3040}-\x{9FFF}\x{AC00}-\x{D7AF} \n]+", "").alias("t")).select("doc_id", X.html_to_text_udf(F.concat(F.lit("<html><head><title>x</title></head><body><p>"), F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><script>no</script></body></html>"))).alias("text"))
)

# Folds.
_SEG = "(SELECT DISTINCT asset_id, start_ms, end_ms, text FROM content_units WHERE start_ms IS NOT NULL AND trim(coalesce(text, '')) <> '')"
WINDOWS_SQL = f"""
WITH RECURSIVE s AS (SELECT asset_id, start_ms AS s, end_ms AS e, trim(text) AS t, row_number() OVER (PARTITION BY asset_id ORDER BY start_ms, end_ms, trim(text)) AS r FROM {_SEG}),
w AS (SELECT asset_id, r, s AS ws, e AS we, t AS wt, 1 AS no FROM s WHERE r = 1
  UNION ALL SELECT s.asset_id, s.r, CASE WHEN s.s - w.ws < 120000 THEN w.ws ELSE s.s END, CASE WHEN s.s - w.ws < 120000 THEN greatest(w.we, s.e) ELSE s.e END, CASE WHEN s.s - w.ws < 120000 THEN w.wt || ' ' || s.t ELSE s.t END, CASE WHEN s.s - w.ws < 120000 THEN w.no ELSE w.no + 1 END FROM w JOIN s ON s.asset_id = w.asset_id AND s.r = w.r + 1)
SELECT asset_id, no::INTEGER AS window_no, max_by(ws, r) AS start_ms, max_by(we, r) AS end_ms, max_by(wt, r) AS text FROM w GROUP BY asset_id, no"""
query("transcript_windows", WINDOWS_SQL)(
    lambda s, d: folds.transcript_windows(T(s, d, "content_units").filter("start_ms IS NOT NULL").select("asset_id", "start_ms", "end_ms", "text").distinct(), "asset_id", "start_ms", "end_ms", "text", 120_000)
)
query("batch_pack", f"""
WITH RECURSIVE i AS (SELECT asset_id, ordinal, least(length(coalesce(text, '')), 3000) AS n, row_number() OVER (PARTITION BY asset_id ORDER BY ordinal) AS r FROM {_U}),
b AS (SELECT asset_id, ordinal, r, 1::BIGINT AS batch_no, 1 AS k, n AS total FROM i WHERE r = 1
  UNION ALL SELECT i.asset_id, i.ordinal, i.r, CASE WHEN b.k >= 8 OR b.total + i.n > 4000 THEN b.batch_no + 1 ELSE b.batch_no END, CASE WHEN b.k >= 8 OR b.total + i.n > 4000 THEN 1 ELSE b.k + 1 END, CASE WHEN b.k >= 8 OR b.total + i.n > 4000 THEN i.n ELSE b.total + i.n END FROM b JOIN i ON i.asset_id = b.asset_id AND i.r = b.r + 1)
SELECT asset_id, ordinal, batch_no FROM b""")(
    lambda s, d: folds.batches(T(s, d, "content_units").distinct().select("asset_id", "ordinal", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(3000)).alias("n")), "asset_id", "ordinal", "n", 8, 4000)
)
@query("unpack_caps", f"""
WITH RECURSIVE e AS (SELECT source_id, size_bytes, row_number() OVER (PARTITION BY source_id ORDER BY mtime_ms, id) AS r FROM {_A}),
f AS (SELECT source_id, r, size_bytes <= 2000000 AS ok, CASE WHEN size_bytes <= 2000000 THEN 1 ELSE 0 END AS n, CASE WHEN size_bytes <= 2000000 THEN size_bytes ELSE 0 END AS b FROM e WHERE r = 1
  UNION ALL SELECT e.source_id, e.r, f.n < 40 AND f.b + e.size_bytes <= 2000000, CASE WHEN f.n < 40 AND f.b + e.size_bytes <= 2000000 THEN f.n + 1 ELSE f.n END, CASE WHEN f.n < 40 AND f.b + e.size_bytes <= 2000000 THEN f.b + e.size_bytes ELSE f.b END FROM f JOIN e ON e.source_id = f.source_id AND e.r = f.r + 1)
SELECT source_id, r AS pos, ok AS accepted FROM f""")
def _caps(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = T(s, d, "assets").distinct().select("source_id", "size_bytes", F.row_number().over(W.partitionBy("source_id").orderBy("mtime_ms", "id")).cast("long").alias("pos"))
    return folds.accepted_entries(rows, "source_id", "pos", "size_bytes", 40, 2_000_000)


query("debounce", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events WHERE ts IS NOT NULL),
f AS (SELECT user_id, r, t AS first, t AS last, 1 AS n, 1 AS burst FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.r, CASE WHEN e.t >= least(f.last + 7200000, f.first + 18000000) THEN e.t ELSE f.first END, e.t, CASE WHEN e.t >= least(f.last + 7200000, f.first + 18000000) THEN 1 ELSE f.n + 1 END, CASE WHEN e.t >= least(f.last + 7200000, f.first + 18000000) THEN f.burst + 1 ELSE f.burst END FROM f JOIN e ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.r = f.r + 1)
SELECT user_id, min(first) AS first_ms, least(max(last) + 7200000, min(first) + 18000000) AS fired_ms, max(n)::BIGINT AS events FROM f GROUP BY user_id, burst""")(lambda s, d: folds.debounced(T(s, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t")), "user_id", "t", 7_200_000, 18_000_000))
query("translation_regroup", "SELECT DISTINCT tr_id, title, text FROM unit_translations WHERE title IS NOT NULL OR text IS NOT NULL")(
    lambda s, d: folds.regroup(T(s, d, "unit_translations").select("tr_id", F.inline(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("text").alias("field"), F.col("text").alias("value"))))).filter("value IS NOT NULL"), "tr_id")
)

# Layout.
_PB = "(SELECT DISTINCT asset_id, page_no, block_no, text, y_top, font_size, bold FROM page_blocks)"
_BODY = f"SELECT asset_id, max_by(s, (n, -s)) / 10 AS body FROM (SELECT asset_id, round(font_size * 10)::BIGINT AS s, sum(length(text)) AS n FROM {_PB} WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY asset_id"


def blocks(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "page_blocks").select("asset_id", "page_no", "block_no", "text", "y_top", "font_size", "bold").distinct()


query("body_size", _BODY)(lambda s, d: layout.body_size(blocks(s, d), "asset_id", "font_size", "text"))
_HEADS = f"SELECT asset_id, size, level FROM (SELECT asset_id, size, row_number() OVER (PARTITION BY asset_id ORDER BY size DESC)::INTEGER AS level FROM (SELECT DISTINCT asset_id, round(font_size * 10) / 10 AS size FROM {_PB} WHERE text IS NOT NULL) JOIN ({_BODY}) USING (asset_id) WHERE size > body * 1.1::DOUBLE) WHERE level <= 6"
query("heading_map", _HEADS)(lambda s, d: layout.heading_levels(blocks(s, d), "asset_id", "font_size", "text"))
query("repeated_elements", f"""
WITH b AS (SELECT * FROM {_PB} WHERE trim(coalesce(text, '')) <> ''), e AS (SELECT asset_id, page_no, min_by(text, (y_top, block_no)) AS a, max_by(text, (y_top, block_no)) AS z FROM b GROUP BY 1, 2)
SELECT asset_id, text, count(*) AS votes FROM (SELECT asset_id, a AS text FROM e UNION ALL SELECT asset_id, z FROM e) GROUP BY 1, 2 HAVING count(*) >= 3""")(lambda s, d: layout.repeated_edges(blocks(s, d), "asset_id", "page_no", "y_top", "block_no", "text"))
query("page_markdown", f"""
WITH b AS (SELECT p.*, h.level FROM (SELECT *, round(font_size * 10) / 10 AS size FROM {_PB} WHERE trim(coalesce(text, '')) <> '') p LEFT JOIN ({_HEADS}) h ON h.asset_id = p.asset_id AND h.size = p.size),
o AS (SELECT *, max(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY page_no, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT asset_id, page_no, string_agg(CASE WHEN level IS NOT NULL THEN repeat('#', CASE WHEN level = 1 AND coalesce(before, 0) = 1 THEN 2 ELSE level END) || ' ' || text WHEN coalesce(bold, false) THEN '**' || text || '**' ELSE text END, chr(10) || chr(10) ORDER BY block_no) AS markdown FROM o GROUP BY 1, 2""")(
    lambda s, d: layout.markdown(blocks(s, d), "asset_id", "page_no", "block_no", "font_size", "text", "bold")
)
query("column_detect")(lambda s, d: layout.page_blocks(T(s, d, "page_blocks").select(F.col("asset_id").alias("doc"), F.col("page_no").alias("page"), "text", F.col("x_left").alias("left"), F.col("y_top").alias("top"), (F.col("x_right") - F.col("x_left")).alias("width"), (F.col("y_bottom") - F.col("y_top")).alias("height"), F.col("font_size").alias("size"), F.coalesce("bold", F.lit(False)).alias("bold")).distinct().dropna(), 595.0, 842.0))

# Records.
query("payload_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")(lambda s, d: T(s, d, "events").select("event_id", R.json_field(F.col("props"), "k").alias("k")).filter("k IS NOT NULL"))
query("backend_codes", "SELECT DISTINCT tr_id, upper(lang) AS deepl, CASE lang WHEN 'ja' THEN 'jp' WHEN 'ko' THEN 'kor' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE lang END AS baidu FROM unit_translations")(
    lambda s, d: T(s, d, "unit_translations").select("tr_id", R.backend_code(F.col("lang"), "deepl").alias("deepl"), R.backend_code(F.col("lang"), "baidu").alias("baidu")).distinct()
)
query("masked_hashes", "SELECT DISTINCT id, CASE WHEN coalesce(content_hash, '') <> '' THEN '__set__' ELSE '' END AS content_hash FROM assets")(lambda s, d: T(s, d, "assets").select("id", R.masked(F.col("content_hash")).alias("content_hash")).distinct())
query("signatures", "SELECT DISTINCT id, md5(id || coalesce(mime, '') || 'key') AS signature FROM assets")(lambda s, d: T(s, d, "assets").select("id", R.signature(F.col("id"), F.coalesce("mime", F.lit("")), F.lit("key")).alias("signature")).distinct())
query("hashed_vectors")(lambda s, d: T(s, d, "content_units").select("id", "title", "text").distinct().select("id", R.hashed_vector_udf(X.embedding_input(F.col("title"), F.col("text"))).alias("vector")))
