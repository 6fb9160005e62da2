"""Problem 6: the language of texts and of their segments, by compression.

A sentence is compressed once with a raw-content dictionary per language; the dictionary that leaves the fewest bytes names the language.
Where the margin to the runner-up (another language, or no dictionary at all) is narrow, the sentence is rejected and goes with its
neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

LANGUAGES = ("en", "zh", "de", "fr", "es", "ja", "ko", "ru")
#: Share of the runner-up's size by which the best must be smaller, for a sentence and for a text without an accepted sentence.
MARGIN, TEXT_MARGIN = 0.10, 0.04
#: Characters of samples per language that a dictionary is made of, at most.
DICTIONARY = 64_000
# Other names of the languages in labels; what is not listed here or in LANGUAGES counts by its part before a - or _.
SPELLINGS = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "cn": "zh", "cht": "zh", "chs": "zh", "chinese": "zh", "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr",
    "spa": "es", "esp": "es", "spanish": "es", "jpn": "ja", "jp": "ja", "japanese": "ja", "kor": "ko", "kr": "ko", "korean": "ko", "rus": "ru", "russian": "ru",
}
_END = re.compile(r"(?<=[.!?])[\"'»”’)\]]*\s+|(?<=[。！？])[」』”’）]*\s*|\n[^\S\n]*\n\s*")
_SCRIPT = {
    "latin": re.compile("[A-Za-zÀ-ɏ]"),
    "han": re.compile("[㐀-鿿豈-﫿]"),
    "kana": re.compile("[぀-ヿｦ-ﾟ]"),
    "hangul": re.compile("[가-힣ᄀ-ᇿ]"),
    "cyrillic": re.compile("[Ѐ-ӿ]"),
    "greek": re.compile("[Ͱ-Ͽἀ-῿]"),
    "other": re.compile(r"[\u0530-\u10ff\u1200-\u1dff]"),
}
#: Share of a sample's letters from which on a script is one of its language's.
SCRIPT_SHARE = 0.05
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W\d_]+")


def label_language(label: Column) -> Column:
    """The language that a label names, in whichever spelling; null for a label that is missing or names none of them."""
    plain = F.lower(F.trim(label))
    known = F.create_map(*[F.lit(x) for kv in (SPELLINGS | {x: x for x in LANGUAGES}).items() for x in kv])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.split_part(F.translate(plain, "_", "-"), F.lit("-"), F.lit(1))))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences: parted after . ! ? and white space, after 。！？ and at blank lines; a line end alone parts none."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.end() > start:
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


class Classifier:
    def __init__(self, samples: dict[str, str], level: int = 3):
        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.with_dictionary = {}
        for lang, text in samples.items():
            raw = text.encode("utf-8")[:DICTIONARY]
            self.with_dictionary[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain)
        self.bare = zstandard.ZstdCompressor(**plain)
        self.languages = list(samples)
        # The scripts of a language are those that its samples are written in.
        self.of_script = {}
        for script, pattern in _SCRIPT.items():
            self.of_script[script] = [x for x, t in samples.items() if len(pattern.findall(t)) > SCRIPT_SHARE * len(_LETTER.findall(t))]

    def sizes(self, parts: list[str]) -> np.ndarray:
        """(parts, languages + 1): bytes left by each dictionary, the last without one; a language whose script does not occur is out."""
        parts = [p if p.isascii() else unicodedata.normalize("NFC", p) for p in parts]
        raw = [p.encode("utf-8") for p in parts]
        out = np.full((len(parts), len(self.languages) + 1), np.inf)
        if not raw:
            return out
        wanted: dict[str, list[int]] = {x: [] for x in self.languages}
        for i, p in enumerate(parts):
            if p.isascii():
                names = self.of_script["latin"]
            else:
                names = {x for script, r in _SCRIPT.items() if r.search(p) for x in self.of_script[script]}
            for x in names:
                wanted[x].append(i)
        for k, x in enumerate(self.languages):
            if rows := wanted[x]:
                out[rows, k] = self._all(self.with_dictionary[x], [raw[i] for i in rows])
        out[:, -1] = self._all(self.bare, raw)
        return out

    @staticmethod
    def _all(c: zstandard.ZstdCompressor, raw: list[bytes]) -> list[int]:
        try:
            return [len(x) for x in c.multi_compress_to_buffer(raw, threads=1)]
        except (AttributeError, NotImplementedError):
            return [len(c.compress(x)) for x in raw]

    def judge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(best language, margin) of each part; -1 where no dictionary beats none."""
        s = self.sizes(parts)
        best = s.argmin(axis=1)
        two = np.partition(s, 1, axis=1)
        margin = np.where(np.isfinite(two[:, 1]), 1 - two[:, 0] / np.maximum(two[:, 1], 1), 0.0)
        return np.where(best == len(self.languages), -1, best), margin

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str | None, float]]]:
        """(start, end, language, confidence) of the segments of each text: runs of sentences of one language.

        Rejected sentences, and those too short to tell, take the language of the sentence before, at the start that of the one after;
        a text with none accepted is judged whole; if that is rejected too, its one segment has a null language. Null and blank: no segments.
        """
        spans = [sentences(t) if t and not t.isspace() else [] for t in texts]
        flat, where = [], []
        for i, (t, ss) in enumerate(zip(texts, spans, strict=True)):
            for k, (a, b) in enumerate(ss):
                p = t[a:b]
                w = _WORD.findall(p)
                if len(w) >= 3 and sum(map(len, w)) >= 6:
                    flat.append(p.strip())
                    where.append((i, k))
        best, margin = self.judge(flat)
        told: list[dict[int, tuple[int, float]]] = [{} for _ in texts]
        for (i, k), b, m in zip(where, best.tolist(), margin.tolist(), strict=True):
            if b >= 0 and m >= MARGIN:
                told[i][k] = (b, m)
        open_ = [i for i, ss in enumerate(spans) if ss and not told[i] and _LETTER.search(texts[i])]
        whole = dict(zip(open_, zip(*(x.tolist() for x in self.judge([texts[i].strip() for i in open_])), strict=True), strict=True)) if open_ else {}
        out = []
        for i, ss in enumerate(spans):
            if not ss:
                out.append([])
                continue
            if not told[i]:
                b, m = whole.get(i, (-1, 0.0))
                sure = b >= 0 and m >= TEXT_MARGIN
                out.append([(ss[0][0], ss[-1][1], self.languages[b] if sure else None, round(m, 4) if sure else 0.0)])
                continue
            runs: list[list] = []
            now = told[i][min(told[i])][0]
            for k, (a, b) in enumerate(ss):
                lang, m = told[i].get(k, (now, None))
                now = lang
                if runs and runs[-1][2] == lang:
                    runs[-1][1] = b
                else:
                    runs.append([a, b, lang, []])
                if m is not None:
                    runs[-1][3].append(m)
            out.append([(a, b, self.languages[x], round(float(np.mean(ms)), 4) if ms else 0.0) for a, b, x, ms in runs])
        return out


def dictionaries(samples: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, str]:
    """One text per language, of DICTIONARY characters at most: all that the classifier is made of."""
    rows = samples.filter(F.col(text).isNotNull()).groupBy(F.col(lang).alias("l")).agg(F.left(F.array_join(F.sort_array(F.collect_list(text)), "\n"), F.lit(DICTIONARY)).alias("t")).collect()  # a row per language
    return {r["l"]: r["t"] for r in sorted(rows, key=lambda r: LANGUAGES.index(r["l"]) if r["l"] in LANGUAGES else 99)}


def label_segments(df: DataFrame, key: str, text: str, samples: dict[str, str]) -> DataFrame:
    """(key, segments): for every row an array of (start, end, lang, confidence); empty for null and blank texts."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(samples)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = c.segments(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("start", "end", "lang", "confidence"), s, strict=True)) for s in ss] for ss in found], kind)], names=[key, "segments"])

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(label, f"`{key}` {dict(df.dtypes)[key]}, segments array<struct<start:int,end:int,lang:string,confidence:double>>")


def judged(translations: DataFrame, units: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(tr_id, field, label, segments) of both labels of every translation: `lang` by its own text, `source_lang` by the unit's.

    Redelivered rows count once; a translation of a missing unit has no segments for source_lang.
    """
    rows = translations.select("tr_id", "unit_id", "lang", "source_lang", "text").dropDuplicates(["tr_id"])
    own = label_segments(rows.select("tr_id", "text"), "tr_id", "text", samples)
    own = translations.select("tr_id", "lang").distinct().join(own, "tr_id").select("tr_id", F.lit("lang").alias("field"), F.col("lang").alias("label"), "segments")
    links = translations.select("tr_id", "unit_id", "source_lang").distinct()
    texts = units.select(F.col("id").alias("unit_id"), "text").join(links.select("unit_id").distinct(), "unit_id", "left_semi").dropDuplicates(["unit_id"])
    source = links.join(label_segments(texts, "unit_id", "text", samples), "unit_id", "left").select("tr_id", F.lit("source_lang").alias("field"), F.col("source_lang").alias("label"), "segments")
    return own.unionByName(source)


def wrong_labels(judgements: DataFrame) -> DataFrame:
    """(tr_id, field, lang): for labels that are missing, name another language than the text's, or stand on a mixed text, a row per language."""
    langs = F.array_distinct(F.filter(F.transform("segments", lambda s: s["lang"]), lambda x: x.isNotNull()))
    rows = judgements.select("tr_id", "field", langs.alias("langs"), label_language(F.col("label")).alias("named")).filter(F.size("langs") > 0)
    wrong = F.col("named").isNull() | (F.size("langs") > 1) | (F.col("named") != F.element_at("langs", 1))
    return rows.filter(wrong).select("tr_id", "field", F.explode("langs").alias("lang")).distinct()
