"""Text functions as column expressions; Python functions only where no expression exists."""

from __future__ import annotations

import html.parser
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters with marks, and the letters they are folded to, by canonical decomposition.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1 and chr(c).islower())
FOLDED = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
TOKEN = r"[\p{L}\p{N}]+"
# Characters that are set without blanks between them.
CJK = "⺀-鿿가-힯豈-﫿＀-￯—‘’“”…"
SPACE = r"[\s 　]"


def fold(c: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.lower(c), ACCENTED, FOLDED)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded; empty for null. A run of ideographs is one token."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def tokens_of(text: str) -> list[str]:
    """tokens() of a string on the driver: for query texts."""
    folded = text.lower().translate(str.maketrans(ACCENTED, FOLDED))
    return re.findall(r"[^\W_]+", folded)


def strip(c: Column) -> Column:
    """Without white space at its ends, of any kind."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What is before the last slash; empty at the root."""
    return F.regexp_extract(path, r"(?s)^(.+)/[^/]*$", 1)


def dir_chain(path: Column) -> Column:
    """The file's folder and all above it, nearest first, down to the root, which is empty."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def first_line_title(text: Column, length: int = 120) -> Column:
    """The first line that is not blank, trimmed and cut; null when there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.left(F.get(lines, F.lit(0)), F.lit(length)))


def heading_title(markdown: Column) -> Column:
    """The text of the first markdown heading; empty when there is none."""
    return F.regexp_extract(markdown, r"(?m)^#+[ \t]*(.*)$", 1)


def embedding_input(title: Column, text: Column, cap: int = 4000) -> Column:
    head, body = strip(F.coalesce(title, F.lit(""))), F.left(strip(F.coalesce(text, F.lit(""))), F.lit(cap))
    return F.when(head == "", body).otherwise(F.concat_ws("\n", head, body))


def script_language(text: Column) -> Column:
    """A language by the scripts of the letters: kana means ja, Hangul ko when not fewer than Han, Han zh when not fewer than Latin,
    Cyrillic ru likewise, else en; null for fewer than two letters."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    kana, hangul, han, cyrillic, latin = n("[\\x{3040}-\\x{30FF}]"), n("[\\x{AC00}-\\x{D7AF}]"), n("[\\x{3400}-\\x{9FFF}]"), n("[\\x{0400}-\\x{04FF}]"), n("[A-Za-z\\x{00C0}-\\x{024F}]")
    return (
        F.when(kana + hangul + han + cyrillic + latin < 2, None).when(kana > 0, "ja").when((hangul > 0) & (hangul >= han), "ko").when((han > 0) & (han >= latin), "zh").when((cyrillic > 0) & (cyrillic >= latin), "ru").when(text.isNotNull(), "en")
    )


def join_runs(parts: Column) -> Column:
    """Trimmed parts, blank ones dropped, with one blank between two unless both sides of the seam are set without blanks."""
    kept = F.filter(F.transform(parts, strip), lambda x: x != "")
    seam = F.regexp_replace(F.array_join(kept, "\u0001"), f"(?<=[{CJK}])\u0001(?=[{CJK}])", "")
    return F.replace(seam, F.lit("\u0001"), F.lit(" "))


def glyph_spacing(text: Column) -> Column:
    """Chains of at least three such characters with white space between each two lose it; shorter ones keep it."""
    chain = f"(?<![{CJK}])[{CJK}](?:[ \\t]+[{CJK}](?![{CJK}])){{2,}}"
    found = F.regexp_extract_all(text, F.lit(f"({chain})"), 1)
    return F.aggregate(found, text, lambda acc, x: F.replace(acc, x, F.regexp_replace(x, "[ \\t]+", "")))


def implausible_ratio(text: Column) -> Column:
    """Share of the characters other than white space that are neither letters, digits, marks, punctuation nor symbols in use in running text."""
    solid = F.regexp_replace(text, "\\s+", "")
    odd = F.regexp_count(solid, F.lit("[^\\x{21}-\\x{7E}\\x{A1}-\\x{17F}\\x{370}-\\x{52F}\\x{2010}-\\x{2026}\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]"))
    return F.when(F.length(solid) > 0, odd / F.length(solid))


def is_garbled(text: Column) -> Column:
    """At least 20 characters of which more than 30 % are implausible."""
    return F.coalesce((F.length(F.regexp_replace(text, "\\s+", "")) >= 20) & (implausible_ratio(text) > 0.3), F.lit(False))


def is_page_number(text: Column) -> Column:
    return strip(text).rlike(r"^-?\s*\d+\s*-?$|^\d+\s*/\s*\d+$")


def is_symbols(text: Column) -> Column:
    return text.rlike(r"^[\s√×✓✗·—]*$")


def xml_unescape(c: Column) -> Column:
    """The five predefined entities, the ampersand last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def upload_name(name: Column) -> Column:
    """The base name with runs of other characters than letters, digits, dot, dash and underscore as one underscore, its last 120; `file` if empty."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._-]+", "_")
    return F.coalesce(F.nullif(F.right(base, F.lit(120)), F.lit("")), F.lit("file"))


def artifact_name(name: Column) -> Column:
    """Letters, digits, dash and underscore; all else a dash, none at the ends; `export` if empty."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_-]", "-"), "^-+|-+$", ""), F.lit("")), F.lit("export"))


def is_username(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{3,32}$")


def plain_snippet(c: Column) -> Column:
    return strip(F.translate(c, "[]", ""))


def timecode(ms: Column) -> Column:
    """MM:SS, minutes unbounded."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def seconds_to_ms(seconds: Column) -> Column:
    return (seconds * 1000).cast("bigint")


def civil_to_unix(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.unix_seconds(F.make_timestamp(y, mo, d, h, mi, s, F.lit("UTC")))


def string_array(content: Column) -> Column:
    """The array of strings in a model's answer: as it is, within a code fence, or between the outermost brackets; null if there is none
    or not all are strings."""
    bare = F.regexp_replace(F.regexp_replace(strip(content), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    inner = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")), F.lit("x"))
    kinds = F.from_json(inner, "array<string>", {"mode": "PERMISSIVE"})
    # Numbers would be read as strings: with all quoted strings taken out, no value may be left.
    rest = F.regexp_replace(inner, r'"(?:[^"\\]|\\.)*"', "")
    return F.when(rest.rlike(r"^[\s\[\],]*$"), kinds)


class _Body(html.parser.HTMLParser):
    BREAKS = {"p", "br", "div", "h1", "h2", "h3"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.silent, self.lines = False, 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "body"
        self.silent += tag in ("script", "style")
        if tag in self.BREAKS:
            self.lines.append([])

    def handle_startendtag(self, tag, attrs):
        if tag in self.BREAKS:
            self.lines.append([])

    def handle_endtag(self, tag):
        if tag == "body":
            self.inside = False
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data):
        if self.inside and not self.silent and data.strip():
            self.lines[-1].append(data.strip())


def html_to_text(page: str | None) -> str | None:
    """The text of the body: scripts and styles dropped, a line per block, runs joined with a blank; null stays null."""
    if page is None:
        return None
    parser = _Body()
    parser.feed(page)
    parser.close()
    return "\n".join(" ".join(x) for x in parser.lines if x)


@F.pandas_udf(T.StringType())
def html_to_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(html_to_text, na_action="ignore")
