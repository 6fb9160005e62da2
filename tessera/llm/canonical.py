"""Problem 7: one consistent form for text that looks the same.

Quick-check properties decide which characters can be part of unstable text. Only the segments around such characters
(each with the starter before it as boundary context) are normalised; everything between is copied unchanged.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import spread

# Blanks that are neither space, tab, line feed nor carriage return.
BLANKS = (0x0B, 0x0C, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Characters without width. U+200D, U+FE0E and U+FE0F are kept next to emoji.
INVISIBLE = (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0)
# CJK radicals without a Unicode decomposition, and the ideograph each one shows.
RADICALS = dict(zip("⺁⺄⺆⺇⺈⺉⺊⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺳⺵⺶⺷⺸⺹⺺⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乙冂几𠂊刂卜㔾小小兀尣尢尢巳幺彑彐忄㣺扌攵旡日月歺民氵氺灬爫爫丬犭王疋罒示礻竹糸纟罓罒网羋羊羊羋耂肀月臼艹艹艹虎衤覀西见角角讠贝足车辶辶辶阝钅長镸长门𨸏阝雨青韦页风飞食飠饣𩠐马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀", strict=True))
# Letters of one script and the look-alikes of another, position by position.
LATIN_OF_CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝ", "ABEKMHOPCTYXSIJaeopcyxsijhdqw", strict=True))
CYRILLIC_OF_LATIN = dict(zip("ABEKMHOPCTYXSIJaeopcyxsij", "АВЕКМНОРСТУХЅІЈаеорсухѕіј", strict=True))
LATIN_OF_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονια", "ABEZHIKMNOPTYXovia", strict=True))
GREEK_OF_LATIN = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", strict=True))
CYRILLIC_OF_GREEK = dict(zip("ΑΒΕΚΜΗΟΡΤΧοα", "АВЕКМНОРТХоа", strict=True))
GREEK_OF_CYRILLIC = {b: a for a, b in CYRILLIC_OF_GREEK.items()}

LATIN, CYRILLIC, GREEK = "A-Za-zªºÀ-ÖØ-öø-ɏ", "Ѐ-ԯ", "Ͱ-ͳͶͷͻ-ͽͿΆΈ-Ͽ"
GREEK_OR_CYRILLIC = re.compile("[Ͱ-ԯ]")
EMOJI = "©®‼-㊙\U0001f000-\U0001faff"


def _seconds() -> list[int]:
    """Characters that compose with one before them, whatever their combining class: the second ones of the composition pairs."""
    out = set()
    for c in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split(" ")
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in parts)) == chr(c):
            out.add(int(parts[1], 16))
    return sorted(out)


def _classes() -> tuple[list[int], list[int]]:
    """Code points whose NFC quick check is no or maybe (or that start a Hangul sequence), and those with a plain compatibility form."""
    nfc, compat = _seconds(), []
    for c in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= c <= 0xD7A3 or 0x4E00 <= c <= 0x9FFF or 0xD800 <= c <= 0xF8FF or 0x20000 <= c <= 0x2F7FF or 0x2FA1E < c:
            continue
        ch = chr(c)
        if unicodedata.normalize("NFC", ch) != ch or unicodedata.combining(ch) or 0x1100 <= c <= 0x11FF:
            nfc.append(c)
            continue
        kind, name = unicodedata.decomposition(ch).split(" ")[0], unicodedata.name(ch, "")
        plain = unicodedata.normalize("NFKC", ch)
        if kind in ("<wide>", "<narrow>") and (plain.isalnum() or plain in "ー゙゚"):
            compat.append(c)
        elif 0x2E80 <= c <= 0x2FDF and name:
            compat.append(c)
        elif kind == "<compat>" and "LIGATURE" in name and plain.isalpha():
            compat.append(c)
    return nfc, compat


def ranges(points: list[int]) -> str:
    """The inside of a character class for Python's re."""
    out, points = [], sorted(set(points))
    start = prev = None
    for c in [*points, None]:
        if prev is not None and c == prev + 1:
            prev = c
            continue
        if prev is not None:
            out.append(f"\\U{start:08x}" if start == prev else f"\\U{start:08x}-\\U{prev:08x}")
        start = prev = c
    return "".join(out)


@lru_cache(1)
def _tables():
    nfc, compat = _classes()
    blanks, hidden = ranges([*BLANKS]), ranges([*INVISIBLE])
    mixed = "|".join(f"(?<=[{a}])[{b}]|[{b}](?=[{a}])" for a, b in ((LATIN, CYRILLIC + GREEK), (CYRILLIC, GREEK)))
    suspect = re.compile(f"[{ranges(nfc)}{ranges(compat)}{blanks}{hidden}]")
    unstable = re.compile(f".?[{ranges(nfc)}{ranges(compat)}]+", re.S)
    joiner = re.compile(f"(?<=[{EMOJI}])[‍︎️]+")
    return suspect, unstable, re.compile(f"[{blanks}]"), re.compile(f"[{hidden}]+"), joiner, re.compile(f"[{LATIN}{CYRILLIC}{GREEK}]+"), re.compile(mixed), {chr(c) for c in compat}


def _one_script(word: str) -> str:
    """A word of several scripts in the script that most of its letters belong to; ties, and words no table covers wholly, by what can be mapped."""
    n = {"l": 0, "c": 0, "g": 0}
    sure = dict(n)
    for ch in word:
        s = "c" if "Ѐ" <= ch <= "ԯ" else "g" if "Ͱ" <= ch <= "Ͽ" else "l"
        n[s] += 1
        twin = {"l": ch in CYRILLIC_OF_LATIN or ch in GREEK_OF_LATIN, "c": ch in LATIN_OF_CYRILLIC, "g": ch in LATIN_OF_GREEK}[s]
        sure[s] += not twin  # letters without a twin show what the word was written in
    best = max("lcg", key=lambda s: (sure[s], n[s], s == "l"))
    to = {"l": LATIN_OF_CYRILLIC | LATIN_OF_GREEK, "c": CYRILLIC_OF_LATIN | CYRILLIC_OF_GREEK, "g": GREEK_OF_LATIN | GREEK_OF_CYRILLIC}[best]
    return "".join(to.get(ch, ch) for ch in word)


def canonical(value: str | None) -> str | None:
    """The consistent form of a value; None stays None, and stable text is returned as it is.

    Wide punctuation, signs that look different from plain text, words of one script and joiners within emoji stay.
    """
    if value is None or value.isascii():
        if value and ("\x0b" in value or "\x0c" in value):
            return value.replace("\x0b", " ").replace("\x0c", " ")
        return value
    suspect, unstable, blank, hidden, joiner, word, mixed, compat = _tables()
    if not suspect.search(value) and not (GREEK_OR_CYRILLIC.search(value) and mixed.search(value)):
        return value
    if hidden.search(value):
        kept = {m.start() + i for m in joiner.finditer(value) for i in range(len(m[0])) if m[0][i] != "‍" or m.end() < len(value) and re.match(f"[{EMOJI}]", value[m.end()])}
        value = hidden.sub(lambda m: "".join(ch for i, ch in enumerate(m[0], m.start()) if i in kept), value)
    value = blank.sub(" ", value)

    def splice(m: re.Match) -> str:
        s = "".join(RADICALS.get(ch) or unicodedata.normalize("NFKC", ch) if ch in compat else ch for ch in m[0])
        return unicodedata.normalize("NFC", s.replace("゙", "゙").replace("゛", "゙").replace("゜", "゚") if any(ch in compat for ch in m[0]) else s)

    value = unstable.sub(splice, value)
    if mixed.search(value):
        value = word.sub(lambda m: _one_script(m[0]) if mixed.search(m[0]) else m[0], value)
    return value


@F.pandas_udf(T.StringType())
def canonical_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield pd.Series([canonical(x) for x in v], index=v.index, dtype=object)


def canonical_column(value: Column) -> Column:
    """canonical() of a column."""
    return canonical_udf(value)


def canonicalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns in its consistent form. Nulls stay null, other columns are left alone, clashing or not."""
    return df.withColumns({c: canonical_column(F.col(f"`{c}`")) for c in columns})


def changed_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, value, canonical) of the values that are not in their consistent form; a redelivered row counts once."""

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for i, field in enumerate(columns, 1):
                for k, v in zip(keys, batch.column(i).to_pylist(), strict=True):
                    if v is not None and (c := canonical(v)) != v:
                        out.append((k, field, v, c))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else ((),) * 4)], names=[key, "field", "value", "canonical"])

    rows = spread(df.select(F.col(f"`{key}`").cast("string"), *[f"`{c}`" for c in columns]))
    return rows.mapInArrow(changed, f"`{key}` string, field string, value string, canonical string").distinct()
