"""Scanning folders, telling kinds of files, and text from plain files."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import first_line_title

OVERSIZE = 5 * 1024**3
TEXT_CAP = 2 * 1024**2
# Folders that are never entered, and kinds by extension.
SKIPPED = ("node_modules", "target", "dist", "data", "__MACOSX")
_BY_KIND = {
    "pdf": "pdf", "presentation": "pptx ppt key", "document": "docx doc", "spreadsheet": "xlsx xls numbers", "text": "txt md markdown csv json tex bib log", "image": "png jpg jpeg webp gif bmp heic tiff svg",
    "video": "mp4 mov mkv avi webm", "audio": "mp3 wav flac aac m4a", "archive": "epub zip 7z rar tar gz",
}
KINDS = {ext: kind for kind, exts in _BY_KIND.items() for ext in exts.split()}
# Kinds that text is taken from, and kinds whose pages can be picked for an export.
EXTRACTABLE = ("text", "pdf", "presentation", "document", "spreadsheet", "image", "video", "audio", "archive")
CROPPABLE = ("presentation", "pdf", "document")
# First bytes of files, in hexadecimal, and their types.
MAGIC = (("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("377ABCAF", "application/x-7z-compressed"), ("52617221", "application/vnd.rar"), ("494433", "audio/mpeg"), ("D0CF11E0", "application/x-ole-storage"))


def kind_of(path: Column, mime: Column | None = None) -> Column:
    """pdf, image, video or audio by the type where it says so, else by the extension, else other."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    by_name = F.coalesce(F.try_element_at(table, ext), F.lit("other"))
    if mime is None:
        return by_name
    return F.when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio").otherwise(by_name)


def extractable(kind: Column, oversized: Column) -> Column:
    """Whether text is taken from a file of the kind."""
    return kind.isin(*EXTRACTABLE) & ~F.coalesce(oversized, F.lit(False))


def selectable(kind: Column, unit_type: Column) -> Column:
    """Whether a unit can be picked for an export: a page or slide of a file that can be taken apart."""
    return kind.isin(*CROPPABLE) & unit_type.isin("page", "slide")


def mounts(setting: str) -> list[str]:
    """The folders of a setting that lists them with commas, wide ones too; blanks and empty entries don't count."""
    return [x.strip() for x in re.split("[,，]", setting) if x.strip()]


def sniff(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for magic, mime in reversed(MAGIC):
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return out


def ignored(relative: Column, globs: list[str] | None = None) -> Column:
    """Dot entries, skipped folders, and globs on the relative path or the file name; no negation."""
    dirs = "|".join(map(re.escape, SKIPPED))
    out = relative.rlike(r"(^|/)\.") | relative.rlike(rf"(^|/)({dirs})/")
    wanted = [g.strip() for g in globs or [] if g.strip() and not g.startswith("#")]
    if wanted:
        one = "|".join(f"(?:{fnmatch.translate(g)})".replace("(?>", "(?:").replace("\\z", "\\Z") for g in wanted)
        out = out | relative.rlike(f"^(?:{one})") | F.substring_index(relative, "/", -1).rlike(f"^(?:{one})")
    return out


def scan(spark: SparkSession, root: str, globs: list[str] | None = None, oversize: int = OVERSIZE) -> DataFrame:
    """(path, size_bytes, mtime_ms, content_hash, mime, kind, oversized) of the files below a folder, paths relative to it.

    Oversized files are recorded but neither hashed nor sniffed. Order by path where it matters.
    """
    prefix = "file:" + root.rstrip("/") if root.startswith("/") else root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.withColumn("rel", F.regexp_replace(F.regexp_replace("path", r"^(\w+):/*", "$1:/"), "^" + re.escape(re.sub(r"^(\w+):/*", r"\1:/", prefix)) + "/", ""))
    rows = rows.filter(~ignored(F.col("rel"), globs))
    big = F.col("length") > oversize
    mime = F.when(~big, sniff(F.col("content")))
    return rows.select(F.col("rel").alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("mtime_ms"), F.when(~big, F.sha2("content", 256)).alias("content_hash"), mime.alias("mime"), kind_of(F.col("rel"), mime).alias("kind"), big.alias("oversized"))


def text_units(files: DataFrame) -> DataFrame:
    """(path, ordinal, unit_type, title, text): one whole unit per plain file (path, content), of its first 2 MiB."""
    text = F.decode(F.substring("content", 1, TEXT_CAP), "UTF-8")
    return files.select("path", F.lit(1).alias("ordinal"), F.lit("whole").alias("unit_type"), first_line_title(text).alias("title"), text.alias("text"))


def page_units(texts: DataFrame) -> DataFrame:
    """(path, ordinal, unit_type, title, text): pages of a text (path, text) parted by form feeds; those at its end are no pages."""
    pages = F.split(F.regexp_replace("text", r"\f+$", ""), r"\f")
    return texts.select("path", F.posexplode(pages).alias("p", "text")).select("path", (F.col("p") + 1).alias("ordinal"), F.lit("page").alias("unit_type"), first_line_title(F.col("text")).alias("title"), "text")
