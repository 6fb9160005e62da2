"""JSON, settings, backend codes and the text of tool answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens_of

MASK = "__set__"
# How translation backends write languages where they differ from the two letters used here.
BACKEND_CODES = {"baidu": {"ja": "jp", "ko": "kor", "fr": "fra", "es": "spa"}}
# Keys of recognition answers that hold no text.
METADATA_KEYS = ("score", "confidence", "box", "boxes", "poly", "dt", "logId", "errorCode", "errorMsg", "elapsedTime", "min", "general", "label", "inputImage", "modelName")


def masked(secret: Column) -> Column:
    """A secret on its way out: only whether it is set."""
    return F.when(F.coalesce(secret, F.lit("")) != "", F.lit(MASK)).otherwise(F.lit(""))


def unmasked(written: Column, stored: Column) -> Column:
    """A secret on its way in: the mask leaves it as it is."""
    return F.when(written == MASK, stored).otherwise(written)


def setting(value: Column, schema: str, default: Column) -> Column:
    """A setting from JSON, or the default where it is missing or malformed."""
    return F.coalesce(F.from_json(value, schema), default)


def json_field(payload: Column, name: str) -> Column:
    """A field of a JSON payload as text; null for what is no JSON."""
    return F.get_json_object(payload, f"$.{name}")


def backend_code(lang: Column, backend: str) -> Column:
    """A language as a backend writes it."""
    if backend == "deepl":
        return F.upper(lang)
    codes = BACKEND_CODES.get(backend, {})
    out = lang
    for ours, theirs in codes.items():
        out = F.when(lang == ours, theirs).otherwise(out)
    return out


def signature(*parts: Column) -> Column:
    return F.md5(F.concat(*parts))


def typed_refs(payload: Column) -> Column:
    """The well-typed (assetId, ordinal) entries of a JSON array; others are dropped."""
    refs = F.from_json(payload, "array<struct<assetId:string,ordinal:int>>")
    return F.filter(F.coalesce(refs, F.array().cast("array<struct<assetId:string,ordinal:int>>")), lambda r: r["assetId"].isNotNull() & r["ordinal"].isNotNull() & (r["ordinal"] >= 1))


def collected_text(answer: str | None) -> str | None:
    """The text of a recognition answer, parts with a blank between: the recognised lines of its results; where these hold none, every string
    below 500 bytes that is no link, whatever the place, but for fields that hold no text. Null for what is no JSON."""
    try:
        root = json.loads(answer) if answer is not None else None
    except ValueError:
        return None
    if answer is None:
        return None
    at = lambda x, *keys: at(x.get(keys[0]), *keys[1:]) if keys and isinstance(x, dict) else None if keys else x
    results = at(root, "result", "ocrResults")
    lines = [t.strip() for r in (results if isinstance(results, list) else []) for t in (at(r, "prunedResult", "rec_texts") or []) if isinstance(t, str) and t.strip()]
    if lines:
        return " ".join(lines)
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            # Fields come in the order of their names, as parsed objects keep them.
            todo.extend(x[k] for k in sorted(x, reverse=True) if k not in METADATA_KEYS)
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, str) and x and not x.startswith("http") and len(x.encode()) < 500:
            found.append(x)
    return " ".join(found).strip()


@F.pandas_udf(T.StringType())
def collected_text_udf(answers: pd.Series) -> pd.Series:
    return answers.map(collected_text, na_action="ignore")


def folder_meta(raw: Column) -> Column:
    """(visibility, permissions) of a folder's JSON: anything but public is internal, ill-formed entries are dropped; null for what is no JSON."""
    kind = "struct<visibility:string,permissions:array<struct<subjectType:string,subjectId:string,level:string>>>"
    known = F.from_json(raw, kind)
    entry = lambda e: e["subjectType"].isin("user", "user_group") & e["subjectId"].isNotNull() & e["level"].isin("read", "write", "deny")
    kept = F.filter(F.coalesce(known["permissions"], F.array().cast("array<struct<subjectType:string,subjectId:string,level:string>>")), lambda e: F.coalesce(entry(e), F.lit(False)))
    valid = F.get_json_object(raw, "$").isNotNull()
    return F.when(valid, F.struct(F.when(known["visibility"] == "public", "public").otherwise("internal").alias("visibility"), kept.alias("permissions")))


# Formats of exports.
EXPORT_FORMATS = ("pdf", "pptx", "native", "original")


def export_payload(raw: Column) -> Column:
    """(format, units) of an export's JSON; null without units, or with a format that isn't known."""
    known = F.from_json(raw, "struct<format:string,units:array<struct<assetId:string,ordinal:int>>>")
    return F.when((F.size(known["units"]) > 0) & known["format"].isin(*EXPORT_FORMATS), known)


def query_line(line: Column) -> Column:
    """The search that a line of an answer proposes (QUERY: ..., in any case, after a list mark, with a wide colon); null for other lines."""
    return F.nullif(F.regexp_extract(line, r"(?i)^\s*(?:[-*·•]\s*)?QUERY\s*[:：]\s*(.+?)\s*$", 1), F.lit(""))


def citations(line: Column) -> Column:
    """The numbers cited in a line as 【n】, in order."""
    return F.transform(F.regexp_extract_all(line, F.lit("【([0-9]+)】"), 1), lambda x: x.cast("int"))


def bold_parts(line: Column) -> Column:
    """The stretches set in bold in a line."""
    return F.regexp_extract_all(line, F.lit(r"\*\*([^*]+)\*\*"), 1)


def feedback(query: Column, answer: Column, rating: Column) -> Column:
    """(query, answer, rating) as stored: the query of at most 500 characters, the answer of at most 4,000 or null, the rating up or down."""
    return F.when(rating.isin("up", "down"), F.struct(F.left(query, F.lit(500)).alias("query"), F.left(F.nullif(answer, F.lit("")), F.lit(4000)).alias("answer"), rating.alias("rating")))


def resolved_model(picked: Column, default: Column, first: Column, fallback: Column) -> Column:
    """The model a request uses: the user's, else the site's, else the first enabled one, else that of the environment."""
    return F.coalesce(picked, default, first, fallback)


def newly(after: Column, before: Column) -> Column:
    """What a list has that it didn't have before."""
    return F.array_except(after, before)


def packed_floats(v: Column) -> Column:
    """A vector as bytes of little-endian 32-bit floats."""

    @F.pandas_udf(T.BinaryType())
    def pack(vs: pd.Series) -> pd.Series:
        return vs.map(lambda x: np.asarray(x, dtype="<f4").tobytes(), na_action="ignore")

    return pack(v)


def unpacked_floats(raw: Column) -> Column:
    """A vector from bytes of little-endian 32-bit floats; what is left over at the end counts for nothing."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(vs: pd.Series) -> pd.Series:
        return vs.map(lambda x: np.frombuffer(x[: len(x) // 4 * 4], dtype="<f4").tolist(), na_action="ignore")

    return unpack(raw)


def media_facts(probe: Column) -> Column:
    """Duration, codecs, size and tags from a media probe's JSON; null for what is none."""
    return F.from_json(probe, "struct<format:struct<duration:string,tags:map<string,string>>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int>>>")


def hashed_vector(text: str | None, dim: int = 64) -> list[float] | None:
    """A stand-in for an embedding model: signed token hashes, of norm one; null without tokens."""
    words = tokens_of(text or "")
    if not words:
        return None
    v = np.zeros(dim)
    for w in words:
        h = xxhash.xxh3_64_intdigest(w)
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n).astype(np.float32).tolist() if n else None


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_vector_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(hashed_vector)
