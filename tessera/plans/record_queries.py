"""Records, settings, plain files, job records and access entries over the test tables. The SQL states the expected outcome by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import records as R
from tessera.functions import text as X
from tessera.operators import folds, library, pipeline
from tessera.plans import data_queries as D
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import files
from tessera.streaming import changes

T = table


def by_rest(n: Column, values: list[str | None]) -> Column:
    """One of the values, by the rest of n."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(n % len(values) == i, F.lit(v)).otherwise(out)
    return out


def cases(n: str, values: list[str]) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def sized(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "assets").select("id", "size_bytes").distinct()


_A = "(SELECT DISTINCT id, size_bytes FROM assets WHERE size_bytes IS NOT NULL)"

# Gates and small lists.
query("extractable_files", "SELECT DISTINCT id FROM assets WHERE kind IN ('text', 'pdf', 'presentation', 'document', 'spreadsheet', 'image', 'video', 'audio', 'archive') AND NOT coalesce(oversized, false)")(lambda s, d: T(s, d, "assets").filter(files.extractable(F.col("kind"), F.col("oversized"))).select("id").distinct())
query("selectable_units", "SELECT DISTINCT u.id FROM content_units u JOIN assets a ON a.id = u.asset_id WHERE a.kind IN ('presentation', 'pdf', 'document') AND u.unit_type IN ('page', 'slide')")(
    lambda s, d: T(s, d, "content_units").join(T(s, d, "assets").select(F.col("id").alias("asset_id"), "kind"), "asset_id").filter(files.selectable(F.col("kind"), F.col("unit_type"))).select("id").distinct()
)
query("status_filter", "SELECT DISTINCT id, extraction_status FROM assets WHERE extraction_status IN ('failed', 'pending')")(lambda s, d: T(s, d, "assets").filter(F.col("extraction_status").isin("failed", "pending")).select("id", "extraction_status").distinct())
query("asset_overview", "SELECT DISTINCT u.asset_id, u.id AS unit_id, u.ordinal, u.title, left(coalesce(u.text, ''), 300) AS text_preview FROM content_units u SEMI JOIN assets a ON a.id = u.asset_id")(lambda s, d: library.overview(T(s, d, "assets"), T(s, d, "content_units")))
query("newest_by_language", "SELECT lang, tr_id, created_at FROM (SELECT lang, tr_id, created_at, row_number() OVER (PARTITION BY lang ORDER BY created_at DESC NULLS LAST, tr_id DESC) AS r FROM (SELECT DISTINCT lang, tr_id, created_at FROM unit_translations)) WHERE r = 1")(
    lambda s, d: library.newest(T(s, d, "unit_translations").select("lang", "tr_id", "created_at"), "lang", "created_at").select("lang", "tr_id", "created_at")
)
_LISTS = "SELECT asset_id, coalesce(list(DISTINCT lang) FILTER (WHERE tr_id % 2 = 0 AND lang IS NOT NULL), []) AS after, coalesce(list(DISTINCT lang) FILTER (WHERE tr_id % 3 = 0 AND lang IS NOT NULL), []) AS before FROM unit_translations GROUP BY asset_id"


@query("language_changes", f"SELECT asset_id, array_to_string(list_sort(list_filter(after, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(after, lambda x: x IN ('ja', 'ko', 'ru'))), ',') AS extra FROM ({_LISTS})")
def language_changes(s: SparkSession, d: str) -> DataFrame:
    """Languages that a list has gained, and those of it that are among known ones."""
    n = F.col("tr_id")
    lists = T(s, d, "unit_translations").groupBy("asset_id").agg(F.collect_set(F.when(n % 2 == 0, F.col("lang"))).alias("after"), F.collect_set(F.when(n % 3 == 0, F.col("lang"))).alias("before"))
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return lists.select("asset_id", joined(R.newly(F.col("after"), F.col("before"))).alias("added"), joined(F.array_intersect("after", F.array(*map(F.lit, ("ja", "ko", "ru"))))).alias("extra"))


query("kept_complement", "SELECT DISTINCT id FROM content_units WHERE unit_type = 'slide' AND id NOT IN (SELECT id FROM content_units WHERE ordinal % 2 = 1)")(
    lambda s, d: T(s, d, "content_units").filter("unit_type = 'slide'").select("id").distinct().join(T(s, d, "content_units").filter("ordinal % 2 = 1").select("id"), "id", "left_anti")
)
query("export_plan", "SELECT asset_id, min(id) AS first_pos, string_agg(ordinal, ',' ORDER BY id) AS ordinals, count(*) AS units FROM (SELECT DISTINCT id, asset_id, ordinal FROM content_units WHERE unit_type IN ('page', 'slide')) GROUP BY asset_id")(
    lambda s, d: library.export_plan(T(s, d, "content_units").filter(F.col("unit_type").isin("page", "slide")).select(F.col("id").alias("pos"), "asset_id", "ordinal").distinct())
)
query("export_assets", "SELECT count(DISTINCT asset_id) AS assets FROM content_units WHERE unit_type IN ('page', 'slide')")(lambda s, d: T(s, d, "content_units").filter(F.col("unit_type").isin("page", "slide")).agg(F.count_distinct("asset_id").alias("assets")))

# Records in JSON and in models' answers: each case is written out, with what must come of it.
_META = ['{"visibility":"public","permissions":[{"subjectType":"user","subjectId":"u1","level":"read"},{"subjectType":"robot","subjectId":"u2","level":"read"},{"subjectType":"user_group","subjectId":"g1","level":"own"}]}', '{"visibility":"secret"}', "{oops", '{"permissions":[{"subjectType":"user_group","subjectId":"g","level":"deny"},{"subjectType":"user","level":"read"}]}', None]


@query("folder_meta", f"SELECT id, {cases('size_bytes', ["'public'", "'internal'", 'NULL', "'internal'", 'NULL'])} AS visibility, {cases('size_bytes', ["'user:u1:read'", "''", 'NULL', "'user_group:g:deny'", 'NULL'])} AS permissions FROM {_A}")
def folder_meta(s: SparkSession, d: str) -> DataFrame:
    meta = R.folder_meta(by_rest(F.col("size_bytes"), _META))
    entry = F.transform(meta["permissions"], lambda e: F.concat_ws(":", e["subjectType"], e["subjectId"], e["level"]))
    return sized(s, d).filter(F.col("size_bytes").isNotNull()).select("id", meta["visibility"].alias("visibility"), F.array_join(entry, ",").alias("permissions"))


_PAYLOADS = ['{"format":"pdf","units":[{"assetId":"a","ordinal":1},{"assetId":"b","ordinal":2}]}', '{"format":"doc","units":[{"assetId":"a","ordinal":1}]}', '{"format":"native","units":[]}', "not json", '{"format":"original","units":[{"assetId":"a","ordinal":7}]}', None]


@query("export_payloads", f"SELECT id, {cases('size_bytes', ["'pdf'", 'NULL', 'NULL', 'NULL', "'original'", 'NULL'])} AS format, {cases('size_bytes', ['2', 'NULL', 'NULL', 'NULL', '1', 'NULL'])}::INTEGER AS units FROM {_A}")
def export_payloads(s: SparkSession, d: str) -> DataFrame:
    p = R.export_payload(by_rest(F.col("size_bytes"), _PAYLOADS))
    return sized(s, d).filter(F.col("size_bytes").isNotNull()).select("id", p["format"].alias("format"), F.size(p["units"]).alias("units"))


_ANSWERS = ['["a","b"]', '```json\n["c"]\n```', 'Sure: ["x", "y"] done', "[1,2]", "none", None]


@query("string_arrays", f"SELECT id, {cases('size_bytes', ["'a|b'", "'c'", "'x|y'", 'NULL', 'NULL', 'NULL'])} AS items FROM {_A}")
def string_arrays(s: SparkSession, d: str) -> DataFrame:
    return sized(s, d).filter(F.col("size_bytes").isNotNull()).select("id", F.array_join(X.string_array(by_rest(F.col("size_bytes"), _ANSWERS)), "|").alias("items"))


_REFS = ['[{"assetId":"a","ordinal":1},{"assetId":7},{"ordinal":2}]', "[]", "nothing", '[{"assetId":"b","ordinal":0},{"assetId":"c","ordinal":3}]']


@query("typed_references", f"SELECT id, {cases('size_bytes', ["'a1'", "''", "''", "'c3'"])} AS refs FROM {_A}")
def typed_references(s: SparkSession, d: str) -> DataFrame:
    refs = R.typed_refs(by_rest(F.col("size_bytes"), _REFS))
    return sized(s, d).filter(F.col("size_bytes").isNotNull()).select("id", F.array_join(F.transform(refs, lambda r: F.concat(r["assetId"], r["ordinal"].cast("string"))), ",").alias("refs"))


@query("setting_values", f"SELECT id, {cases('size_bytes', ["'en,ja'", "'zh'", "'zh'", "''"])} AS langs FROM {_A}")
def setting_values(s: SparkSession, d: str) -> DataFrame:
    value = R.setting(by_rest(F.col("size_bytes"), ['["en","ja"]', "{broken", None, "[]"]), "array<string>", F.array(F.lit("zh")))
    return sized(s, d).filter(F.col("size_bytes").isNotNull()).select("id", F.array_join(value, ",").alias("langs"))


_LINES = [" - query： {} ", "{} 【3】 and 【12】", "**{}** is bold", "QUERY without a colon {}"]
_LINE = cases("ordinal", ["' - query： ' || t || ' '", "t || ' 【3】 and 【12】'", "'**' || t || '** is bold'", "'QUERY without a colon ' || t"])


@query("answer_lines", f"""
SELECT id, nullif(regexp_extract(line, '(?i)^\\s*(?:[-*·•]\\s*)?QUERY\\s*[:：]\\s*(.+?)\\s*$', 1), '') AS search, array_to_string(regexp_extract_all(line, '【([0-9]+)】', 1), ',') AS cited, array_to_string(regexp_extract_all(line, '\\*\\*([^*]+)\\*\\*', 1), ',') AS bold
FROM (SELECT id, {_LINE} AS line FROM (SELECT DISTINCT id, ordinal, regexp_replace(coalesce(title, 'none'), '[^A-Za-z0-9 .]+', '', 'g') AS t FROM content_units))""")
def answer_lines(s: SparkSession, d: str) -> DataFrame:
    """Searches that a model's answer proposes, what it cites, and what it sets in bold."""
    t = F.regexp_replace(F.coalesce("title", F.lit("none")), "[^A-Za-z0-9 .]+", "")
    line = F.lit(None).cast("string")
    for i, form in enumerate(_LINES):
        a, b = form.split("{}")
        line = F.when(F.col("ordinal") % 4 == i, F.concat(F.lit(a), t, F.lit(b))).otherwise(line)
    rows = T(s, d, "content_units").select("id", "ordinal", "title").distinct().select("id", line.alias("line"))
    return rows.select("id", R.query_line(F.col("line")).alias("search"), F.array_join(F.transform(R.citations(F.col("line")), lambda x: x.cast("string")), ",").alias("cited"), F.array_join(R.bold_parts(F.col("line")), ",").alias("bold"))


query("feedback_rows", "SELECT DISTINCT tr_id, left(title, 500) AS query, left(nullif(text, ''), 4000) AS answer, CASE tr_id % 3 WHEN 0 THEN 'up' ELSE 'down' END AS rating FROM unit_translations WHERE tr_id % 3 < 2")(
    lambda s, d: T(s, d, "unit_translations").select("tr_id", R.feedback(F.col("title"), F.col("text"), by_rest(F.col("tr_id"), ["up", "down", "meh"])).alias("x")).filter("x IS NOT NULL").select("tr_id", "x.*").distinct()
)
query("model_choice", "SELECT DISTINCT id, coalesce(CASE WHEN size_bytes % 3 = 0 THEN 'picked' END, CASE WHEN size_bytes % 2 = 0 THEN 'site' END, mime, 'env') AS model FROM assets")(
    lambda s, d: T(s, d, "assets").select("id", R.resolved_model(F.when(F.col("size_bytes") % 3 == 0, F.lit("picked")), F.when(F.col("size_bytes") % 2 == 0, F.lit("site")), F.col("mime"), F.lit("env")).alias("model")).distinct()
)
query("packed_vectors", "SELECT DISTINCT unit_id, len(vector) AS n, 4 * len(vector) AS bytes FROM unit_embeddings WHERE vector IS NOT NULL")(
    lambda s, d: T(s, d, "unit_embeddings").filter("vector IS NOT NULL").select("unit_id", R.packed_floats(F.col("vector")).alias("raw")).select("unit_id", F.size(R.unpacked_floats(F.col("raw"))).cast("long").alias("n"), F.octet_length("raw").cast("long").alias("bytes")).distinct()
)


@query("ocr_text", "SELECT id, coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' '), '') AS text FROM (SELECT DISTINCT id, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .\\n]+', '', 'g') AS t FROM content_units)")
def ocr_text(s: SparkSession, d: str) -> DataFrame:
    """The recognised lines of answers in the usual shape."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 .\n]+", ""), "\n")
    answer = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(lines.alias("rec_texts")).alias("prunedResult"))).alias("ocrResults")).alias("result"), F.lit("not text").alias("modelName")))
    return T(s, d, "content_units").select("id", "text").distinct().select("id", R.collected_text_udf(answer).alias("text"))


@query("ocr_text_fallback", f"SELECT id, {cases('size_bytes', ["'first second third'", "'only'", "''", 'NULL'])} AS text FROM {_A}")
def ocr_text_fallback(s: SparkSession, d: str) -> DataFrame:
    """Answers in other shapes: every string but links, long ones and fields without text."""
    answers = ['{"b":["second",{"z":"third","score":"0.9","logId":"77"}],"a":"first","inputImage":"no"}', '{"box":["no"],"url":"http://x","deep":{"text":"only"}}', '{"errorMsg":"no"}', "broken"]
    return sized(s, d).filter(F.col("size_bytes").isNotNull()).select("id", R.collected_text_udf(by_rest(F.col("size_bytes"), answers)).alias("text"))


# Text functions.
_UNITS = "(SELECT DISTINCT id, title, text FROM content_units)"
units = lambda s, d: T(s, d, "content_units").select("id", "title", "text").distinct()
query("heading_titles", f"SELECT id, trim(regexp_extract('intro' || chr(10) || '## ' || coalesce(t, '') || chr(10) || '# later', '(?m)^#+[ \\t]*(.*)$', 1)) AS title FROM (SELECT id, regexp_replace(title, '[^A-Za-z0-9 ]+', '', 'g') AS t FROM {_UNITS})")(
    lambda s, d: units(s, d).select("id", F.trim(X.heading_title(F.concat(F.lit("intro\n## "), F.coalesce(F.regexp_replace("title", "[^A-Za-z0-9 ]+", ""), F.lit("")), F.lit("\n# later")))).alias("title"))
)


@query("xml_unescaped", f"SELECT id, text FROM {_UNITS}")
def xml_unescaped(s: SparkSession, d: str) -> DataFrame:
    """Texts come back from their escaped form."""
    c = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return units(s, d).select("id", X.xml_unescape(c).alias("text"))


query("garbled_units", f"SELECT id, coalesce(length({D._SOLID}) >= 20 AND len(regexp_extract_all({D._SOLID}, '{D._ODD}')) / length({D._SOLID}) > 0.3, false) AS garbled FROM {_UNITS}")(lambda s, d: units(s, d).select("id", X.is_garbled(F.col("text")).alias("garbled")))
query("unix_times", "SELECT doc_id, epoch(date_trunc('second', modified_at))::BIGINT AS at FROM documents WHERE modified_at IS NOT NULL")(
    lambda s, d: T(s, d, "documents").filter("modified_at IS NOT NULL").select("doc_id", X.civil_to_unix(*[f(F.col("modified_at")) for f in (F.year, F.month, F.day, F.hour, F.minute, F.second)]).alias("at"))
)
query("user_names", "SELECT DISTINCT uploaded_by, regexp_matches(uploaded_by, '^[A-Za-z0-9_-]{3,32}$') AS ok FROM assets WHERE uploaded_by IS NOT NULL")(lambda s, d: T(s, d, "assets").filter("uploaded_by IS NOT NULL").select("uploaded_by", X.is_username(F.col("uploaded_by")).alias("ok")).distinct())
query("plain_snippets", f"SELECT id, regexp_replace(translate('[' || title || '] ', '[]', ''), '^{D._SP}+|{D._SP}+$', '', 'g') AS snippet FROM {_UNITS} WHERE title IS NOT NULL")(lambda s, d: units(s, d).filter("title IS NOT NULL").select("id", X.plain_snippet(F.concat(F.lit("["), "title", F.lit("] "))).alias("snippet")))
query("seconds_to_ms", "SELECT DISTINCT id, CAST(trunc(start_ms / 1000.0 * 1000) AS BIGINT) AS ms FROM content_units WHERE start_ms IS NOT NULL")(lambda s, d: T(s, d, "content_units").filter("start_ms IS NOT NULL").select("id", X.seconds_to_ms(F.col("start_ms").cast("decimal(20,3)") / 1000).alias("ms")).distinct())
query("symbol_blocks", "SELECT DISTINCT block_id, regexp_matches(text, '^[\\s√×✓✗·—]*$') AS symbols FROM page_blocks WHERE text IS NOT NULL")(lambda s, d: T(s, d, "page_blocks").filter("text IS NOT NULL").select("block_id", X.is_symbols(F.col("text")).alias("symbols")).distinct())

# Plain files.
_DOC = "(SELECT doc_id, regexp_replace(text, '[^\\x{20}-\\x{2FF}\\n]+', '', 'g') AS text FROM documents WHERE text IS NOT NULL)"
doc = lambda s, d: T(s, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", r"[^\x{20}-\x{2FF}\n]+", "").alias("text"))
query("plain_text_units", f"SELECT doc_id::VARCHAR AS path, 1 AS ordinal, 'whole' AS unit_type, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{D._SP}+|{D._SP}+$', '', 'g')), lambda x: x <> '')[1], 120) AS title, text FROM {_DOC}")(
    lambda s, d: files.text_units(doc(s, d).select("path", F.encode("text", "UTF-8").alias("content")))
)
query("form_feed_pages", f"SELECT path, ordinal::INTEGER AS ordinal, text FROM (SELECT doc_id::VARCHAR AS path, unnest(string_split(regexp_replace(replace(text, chr(10), chr(12)), '\\f+$', ''), chr(12))) AS text, generate_subscripts(string_split(regexp_replace(replace(text, chr(10), chr(12)), '\\f+$', ''), chr(12)), 1) AS ordinal FROM {_DOC})")(
    lambda s, d: files.page_units(doc(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f")))).select("path", "ordinal", "text")
)

# Jobs, results and file events.
_DONE = "(SELECT DISTINCT a.id AS asset_id, a.kind, (SELECT count(DISTINCT u.id) FROM content_units u WHERE u.asset_id = a.id) AS units FROM assets a)"


@query("follow_ups", f"SELECT asset_id, 'transcribe' AS job, NULL AS lang FROM {_DONE} WHERE kind IN ('audio', 'video') UNION SELECT asset_id, 'embed', NULL FROM {_DONE} WHERE units > 0 UNION SELECT asset_id, 'translate', l FROM {_DONE}, (SELECT unnest(['de', 'ja']) AS l) WHERE units > 0")
def follow_ups(s: SparkSession, d: str) -> DataFrame:
    n = T(s, d, "content_units").groupBy("asset_id").agg(F.count_distinct("id").alias("units"))
    done = T(s, d, "assets").select(F.col("id").alias("asset_id"), "kind").distinct().join(n, "asset_id", "left").fillna(0, ["units"])
    return pipeline.follow_ups(done, ["de", "ja"])


_AGAIN = "SELECT DISTINCT id FROM assets WHERE size_bytes % 5 = 0"


def read_again(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = T(s, d, "content_units").select("id", "asset_id", "ordinal", "unit_type", "title", "text").distinct()
    again = T(s, d, "assets").filter("size_bytes % 5 = 0").select(F.col("id").alias("asset_id"))
    return u, u.join(again, "asset_id", "left_semi").filter("ordinal <= 2").withColumn("id", F.concat("id", F.lit("-new"))).select(*u.columns)


@query("log_of_results", f"""
WITH u AS (SELECT DISTINCT id, asset_id, ordinal FROM content_units WHERE asset_id IN ({_AGAIN})), k AS (SELECT DISTINCT asset_id FROM u WHERE ordinal <= 2),
e AS (SELECT 0 AS turn, 'remove' AS op, id AS unit_id FROM u SEMI JOIN k USING (asset_id) UNION ALL SELECT 1, 'upsert', id || '-new' FROM u WHERE ordinal <= 2)
SELECT (SELECT coalesce(max(version), 0) FROM index_log) + row_number() OVER (ORDER BY turn, unit_id) AS version, op, unit_id FROM e""")
def log_of_results(s: SparkSession, d: str) -> DataFrame:
    return pipeline.persist_units(*read_again(s, d), T(s, d, "index_log"))[1]


@query("units_after_results", f"""
WITH u AS (SELECT DISTINCT id, asset_id, ordinal FROM content_units), k AS (SELECT DISTINCT asset_id FROM u WHERE ordinal <= 2 AND asset_id IN ({_AGAIN}))
SELECT id FROM u ANTI JOIN k USING (asset_id) UNION ALL SELECT id || '-new' FROM u SEMI JOIN k USING (asset_id) WHERE ordinal <= 2""")
def units_after_results(s: SparkSession, d: str) -> DataFrame:
    return pipeline.persist_units(*read_again(s, d), T(s, d, "index_log"))[0].select("id")


@query("transcript_units", f"""
WITH w AS ({D.WINDOWS_SQL}), b AS (SELECT asset_id, count(DISTINCT id) AS base FROM content_units GROUP BY asset_id)
SELECT w.asset_id, (coalesce(base, 0) + window_no)::INTEGER AS ordinal, printf('%02d:%02d', w.start_ms // 60000, w.start_ms // 1000 % 60) AS title, w.text FROM w LEFT JOIN b ON b.asset_id = w.asset_id""")
def transcript_units(s: SparkSession, d: str) -> DataFrame:
    """Windows of transcripts as units after a file's own."""
    u = T(s, d, "content_units").distinct().withColumn("meta", F.lit(None).cast("string"))
    windows = folds.transcript_windows(u.filter("start_ms IS NOT NULL").select("asset_id", "start_ms", "end_ms", "text").distinct(), "asset_id", "start_ms", "end_ms", "text", 120_000)
    return pipeline.persist_transcripts(u, windows, T(s, d, "index_log"))[0].filter("meta = 'transcript'").select("asset_id", "ordinal", "title", "text")


@query("file_events", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'created' WHEN 3 THEN 'removed' ELSE 'modified' END AS kind FROM events WHERE event_id % 5 <> 2")
def file_events(s: SparkSession, d: str) -> DataFrame:
    raw = T(s, d, "events").select(F.col("event_id"), by_rest(F.col("event_id"), ["create/file", "modify/data", "modify/metadata", "remove/file", "modify/name"]).alias("raw"), F.array(F.col("user_id").cast("string")).alias("paths"))
    return changes.file_events(raw, "raw", "paths").select("event_id", "kind")


# Access entries.
_NAMES = "SELECT DISTINCT 'user' AS subject_type, 'user-0' || (c_custkey % 5) AS subject_id, 'User ' || (c_custkey % 5) AS name FROM customer UNION ALL SELECT DISTINCT 'group', 'g' || (c_nationkey % 3), 'Group ' || (c_nationkey % 3) FROM customer"


@query("permission_names", f"SELECT e.*, n.name FROM ({D._ENTRIES}) e LEFT JOIN ({_NAMES}) n USING (subject_type, subject_id)")
def permission_names(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "customer")
    named = lambda n, who, what: c.select(F.concat(F.lit(who), n.cast("string")).alias("id"), F.concat(F.lit(what), n.cast("string")).alias("name")).distinct()
    return library.permission_names(D.entries(s, d), named(F.col("c_custkey") % 5, "user-0", "User "), named(F.col("c_nationkey") % 3, "g", "Group "))


@query("permission_changes", f"SELECT subject_type, subject_id, target_type, target_id, CASE WHEN target_type = 'dir' THEN 'write' ELSE level END AS level FROM ({D._ENTRIES}) WHERE NOT (target_type = 'dir' AND subject_type = 'user')")
def permission_changes(s: SparkSession, d: str) -> DataFrame:
    e = D.entries(s, d)
    return library.put_permissions(e, e.filter("target_type = 'dir'").withColumn("level", F.when(F.col("subject_type") == "group", F.lit("write"))))
