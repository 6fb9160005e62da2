"""Units from office files, e-books, archives and positioned XML, by Arrow-batched functions over file contents."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.text import html_to_text

UNITS = "path string, ordinal int, unit_type string, title string, text string, hidden boolean"
_NS = re.compile(r"^\{[^}]*\}")


def local(tag: str) -> str:
    return _NS.sub("", tag)


def part_path(owner: str, target: str) -> str:
    """The part that a relationship of `owner` points to."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(owner), target))


def rels_path(owner: str) -> str:
    """Where the relationships of a part lie; those of the package for an empty owner."""
    return posixpath.join(posixpath.dirname(owner), "_rels", posixpath.basename(owner) + ".rels")


def relations(z: zipfile.ZipFile, owner: str) -> dict[str, tuple[str, str, bool]]:
    """id -> (part, type, external)."""
    try:
        root = ET.fromstring(z.read(rels_path(owner)))
    except KeyError:
        return {}
    out = {}
    for r in root:
        external = r.get("TargetMode") == "External"
        out[r.get("Id", "")] = (r.get("Target", "") if external else part_path(owner, r.get("Target", "")), r.get("Type", "").rsplit("/", 1)[-1], external)
    return out


def paragraphs(root: ET.Element) -> list[str]:
    """Text of the paragraphs, one string each, blank ones dropped."""
    out = []
    for p in root.iter():
        if local(p.tag) == "p":
            text = "".join((t.text or "") if local(t.tag) == "t" else "\t" if local(t.tag) == "tab" else "" for t in p.iter())
            if text.strip():
                out.append(text.strip())
    return out


def title_of(text: str) -> str | None:
    return next((x.strip()[:120] for x in text.split("\n") if x.strip()), None)


def slides(content: bytes) -> list[tuple]:
    """A unit per slide in the order of the presentation, with its notes; hidden from the slide's show flag."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        main = "ppt/presentation.xml"
        if main not in z.namelist():
            return []
        rels = relations(z, main)
        order = [next(v for k, v in s.attrib.items() if local(k) == "id" and k.startswith("{")) for s in ET.fromstring(z.read(main)).iter() if local(s.tag) == "sldId"]
        out = []
        for i, rid in enumerate(order, 1):
            if rid not in rels:
                continue
            part = rels[rid][0]
            root = ET.fromstring(z.read(part))
            text = "\n".join(paragraphs(root))
            for target, kind, _ in relations(z, part).values():
                if kind == "notesSlide" and target in z.namelist():
                    if notes := "\n".join(paragraphs(ET.fromstring(z.read(target)))):
                        text += f"\n\n[notes] {notes}"
            out.append((i, "slide", title_of(text), text, root.get("show") in ("0", "false")))
        return out


def document(content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            return []
        text = "\n".join(paragraphs(ET.fromstring(z.read("word/document.xml"))))
        return [(1, "whole", title_of(text), text, False)]


def sheets(content: bytes, compat: bool = False) -> list[tuple]:
    """A unit per sheet: its strings in order. compat also looks numbers up among the shared strings, as some readers do."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        main, names = "xl/workbook.xml", set(z.namelist())
        if main not in names:
            return []
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        rels, out = relations(z, main), []
        for i, s in enumerate((x for x in ET.fromstring(z.read(main)).iter() if local(x.tag) == "sheet"), 1):
            rid = next((v for k, v in s.attrib.items() if local(k) == "id" and k.startswith("{")), None)
            if rid not in rels or rels[rid][0] not in names:
                continue
            cells = []
            for c in ET.fromstring(z.read(rels[rid][0])).iter():
                if local(c.tag) == "c":
                    value = next((v.text or "" for v in c if local(v.tag) == "v"), "")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter() if local(t.tag) == "t"))
                    elif (c.get("t") == "s" or compat) and value.isdigit() and int(value) < len(shared):
                        cells.append(shared[int(value)])
                    elif c.get("t") == "str":
                        cells.append(value)
            text = f"[sheet] {s.get('name', '')}\n" + "\n".join(x for x in cells if x)
            out.append((i, "sheet", s.get("name"), text, False))
        return out


def chapters(content: bytes) -> list[tuple]:
    """A unit per chapter of the reading order; the ordinal is the chapter's place, so empty chapters leave gaps."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.get("full-path") for x in box.iter() if local(x.tag) == "rootfile")
        root = ET.fromstring(z.read(opf))
        items = {x.get("id"): x.get("href") for x in root.iter() if local(x.tag) == "item"}
        out = []
        for i, ref in enumerate((x for x in root.iter() if local(x.tag) == "itemref"), 1):
            href = items.get(ref.get("idref"))
            part = part_path(opf, href.replace("%20", " ").replace("%28", "(").replace("%29", ")")) if href else None
            if part in z.namelist() and (text := html_to_text(z.read(part).decode("utf-8", "replace"))):
                out.append((i, "page", title_of(text), text, False))
        return out


EXTRACTORS = {"pptx": slides, "docx": document, "xlsx": sheets, "epub": chapters}


def office_units(files: DataFrame) -> DataFrame:
    """Units of files (path, content) by extension; broken files and other kinds give none."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                reader = EXTRACTORS.get((path or "").rsplit(".", 1)[-1].lower())
                try:
                    rows += [(path, *u) for u in reader(bytes(content))] if reader and content is not None else []
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "ordinal", "unit_type", "title", "text", "hidden"])

    return files.select("path", "content").mapInPandas(extract, UNITS)


def safe_entry(name: str) -> bool:
    """No absolute paths, no way up, no junk of other systems."""
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith("/") or ".." in parts or re.match(r"^[A-Za-z]:", name) or "__MACOSX" in parts or parts[-1] in (".DS_Store", "Thumbs.db") or name.endswith("/"))


def unpack(files: DataFrame, max_entries: int = 10_000, max_bytes: int = 1 << 30) -> DataFrame:
    """(path, entry, content) of zip and tar archives (path, content) that pass the guards: entries in order, those over a cap passed over."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                n = total = 0
                for name, size, get in entries_of(bytes(content or b"")):
                    if not safe_entry(name) or n >= max_entries or total + size > max_bytes:
                        continue
                    n, total = n + 1, total + size
                    yield pd.DataFrame({"path": [path], "entry": [name], "content": [get()]})

    return files.select("path", "content").mapInPandas(read, "path string, entry string, content binary")


def entries_of(content: bytes):
    try:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    yield i.filename, i.file_size, lambda i=i: z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for m in t.getmembers():
                    if m.isfile():
                        yield m.name, m.size, lambda m=m: t.extractfile(m).read()
    except (tarfile.TarError, zipfile.BadZipFile, EOFError):
        return


def fragments_of(xml: str) -> list[tuple]:
    """(page, text, left, top, width, height, size, bold) of positioned XML: pages with fontspec and text elements."""
    root = ET.fromstring(xml)
    out, sizes = [], {}
    for n, page in enumerate((x for x in root.iter() if x.tag == "page"), 1):
        for x in page:
            if x.tag == "fontspec":
                sizes[x.get("id")] = float(x.get("size", 0))
            elif x.tag == "text":
                text = " ".join("".join(x.itertext()).split())
                height = float(x.get("height", 0))
                size = sizes.get(x.get("font"), 0.0) or max(height, 3.0)
                if text:
                    out.append((int(page.get("number", n)), text, float(x.get("left", 0)), float(x.get("top", 0)), float(x.get("width", 0)), height, size, any(y.tag in ("b", "i") for y in x.iter())))
    return out
