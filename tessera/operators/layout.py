"""Pages from positioned text: lines, blocks, columns, reading order, headings and markdown.

A page is folded as one array in Arrow batches; what needs the whole document is counted with DataFrame aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the layout analysis, as shares of the page, of line heights or of sizes.
COLUMN_GAP, STRIPS, BLOCK_GAP, OVERLAP, SPANNING = 0.15, 40, 1.5, 0.5, 0.8
HEADER, FOOTER, HEADING, LEVELS = 0.08, 0.92, 1.1, 6
CJK = re.compile("[⺀-鿿가-힯豈-﫿＀-￯—‘’“”…]")


@dataclass
class Piece:
    text: str
    left: float
    top: float
    right: float
    bottom: float
    size: float
    bold: bool
    lines: list["Piece"] = field(default_factory=list)

    @property
    def height(self) -> float:
        return self.bottom - self.top


def joined(parts: list[str]) -> str:
    out = ""
    for p in (x.strip() for x in parts):
        if p:
            out += ("" if not out or (CJK.match(out[-1]) and CJK.match(p[0])) else " ") + p
    return out


def merged(parts: list[Piece], text: str) -> Piece:
    weight = sum(max(len(p.text), 1) for p in parts)
    return Piece(text, min(p.left for p in parts), min(p.top for p in parts), max(p.right for p in parts), max(p.bottom for p in parts), sum(p.size * max(len(p.text), 1) for p in parts) / weight, all(p.bold for p in parts))


def lines_of(fragments: list[Piece]) -> list[Piece]:
    """Fragments whose middles lie within max(3, 0.4 of their height) of a line's middle make a line; each fragment counts once."""
    unique = {(f.text, round(f.left * 100), round(f.top * 100)): f for f in fragments}
    rows: list[list[Piece]] = []
    for f in sorted(unique.values(), key=lambda x: ((x.top + x.bottom) / 2, x.left)):
        middle = (f.top + f.bottom) / 2
        if rows and abs(middle - np.mean([(x.top + x.bottom) / 2 for x in rows[-1]])) <= max(3.0, 0.4 * f.height):
            rows[-1].append(f)
        else:
            rows.append([f])
    out = []
    for r in rows:
        r.sort(key=lambda x: x.left)
        p = merged(r, joined([x.text for x in r]))
        p.lines = r
        out.append(p)
    return out


def overlap(a: Piece, b: Piece) -> float:
    return max(0.0, min(a.right, b.right) - max(a.left, b.left)) / max(min(a.right - a.left, b.right - b.left), 1e-9)


def columns_of(fragments: list[Piece], width: float) -> list[tuple[float, float]]:
    """(left, right) of the columns: gaps of at least COLUMN_GAP of the page in a histogram of where text stands part them."""
    seen = np.zeros(STRIPS, bool)
    for f in fragments:
        if f.right - f.left < SPANNING * width:
            seen[int(np.clip(f.left / width * STRIPS, 0, STRIPS - 1)) : int(np.clip(f.right / width * STRIPS, 0, STRIPS - 1)) + 1] = True
    empty, strip = int(STRIPS * COLUMN_GAP), width / STRIPS
    out: list[list[int]] = []
    for i in np.flatnonzero(seen).tolist():
        if out and i - out[-1][1] - 1 < empty:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a * strip, (b + 1) * strip) for a, b in out] or [(0.0, width)]


def column_at(left: float, starts: list[float]) -> int:
    """The last column that begins at or before a left edge, 3 points of tolerance."""
    return max((k for k, c in enumerate(starts) if c <= left + 3), default=0)


def spanned(line: Piece, starts: list[float]) -> set[int]:
    return {column_at(f.left, starts) for f in line.lines}


def table_starts(lines: list[Piece]) -> list[float]:
    """Left edges of the columns of a table that a group of lines makes; empty where it makes none.

    Edges that recur (within 3 points) in at least two lines are starts, those closer than 1.6 of the usual size are one. It is a table when
    35 % of the lines have text in two columns or more, two columns have three lines or more, and an empty corridor parts neighbours.
    """
    fragments = [(i, f) for i, x in enumerate(lines) for f in x.lines]
    if len(lines) < 2 or len(fragments) < 4:
        return []
    usual = max(max(lines, key=lambda x: len(x.text)).size, 4.0)
    clusters: list[list] = []  # first edge, last edge, lines
    for left, i in sorted((f.left, i) for i, f in fragments):
        if clusters and left - clusters[-1][1] <= 3:
            clusters[-1][1] = left
            clusters[-1][2].add(i)
        else:
            clusters.append([left, left, {i}])
    starts, last = [], None
    for a, b, seen in clusters:
        if len(seen) >= 2:
            if last is None or a - last > 1.6 * usual:
                starts.append(a)
            last = b
    if len(starts) < 2:
        return []
    used = [spanned(x, starts) for x in lines]
    if sum(len(u) >= 2 for u in used) * 20 < len(lines) * 7 or sum(sum(k in u for u in used) >= 3 for k in range(len(starts))) < 2:
        return []
    for here, after in zip(starts, starts[1:], strict=False):
        end = max((f.right for _, f in fragments if f.left >= here - 3 and f.right < after), default=here)
        middle = (max(end, here) + after) / 2
        if after - max(end, here) < 1 or any(f.left < middle - 0.5 and f.right > middle + 0.5 for _, f in fragments):
            return []
    return starts


def cells_of(lines: list[Piece], starts: list[float]) -> list[Piece]:
    """A block per column of a table, its cells line by line."""
    cells: dict[int, list[Piece]] = {}
    for x in lines:
        for f in x.lines:
            cells.setdefault(column_at(f.left, starts), []).append(f)
    out = []
    for k in sorted(cells):
        p = merged(cells[k], joined([f.text for f in cells[k]]))
        p.lines = cells[k]
        out.append(p)
    return out


_SYMBOLS = re.compile(r"[\s√×✓✗·—]*")


def blocks_of(lines: list[Piece]) -> list[Piece]:
    """Blocks of a column's lines: groups one under the other, at least half overlapping and less than 1.5 line heights apart.

    A group that makes a table gives a block per column. One right after a table takes over its columns when four fifths of its lines have
    text in two of them. Other groups are one block; those of symbols only are dropped.
    """
    groups: list[list[Piece]] = []
    for line in sorted(lines, key=lambda x: (x.top, x.left)):
        last = groups[-1][-1] if groups else None
        if last is not None and overlap(last, line) >= OVERLAP and max(0.0, line.top - last.bottom) < BLOCK_GAP * (last.height + line.height) / 2:
            groups[-1].append(line)
        else:
            groups.append([line])
    out, grid = [], []
    for g in groups:
        starts = table_starts(g)
        if not starts and len(grid) >= 2 and sum(len(spanned(x, grid)) >= 2 for x in g) * 10 >= len(g) * 8:
            starts = grid
        grid = starts
        if starts:
            out += cells_of(g, starts)
            continue
        p = merged(g, hyphen_joined([x.text for x in g]))
        p.lines = g
        if not _SYMBOLS.fullmatch(p.text):
            out.append(p)
    return out


def hyphen_joined(lines: list[str]) -> str:
    out = ""
    for x in lines:
        out = out[:-1] + x if re.search(r"[^\W\d_]-$", out) and x[:1].islower() else joined([out, x])
    return out


def reading_order(blocks: list[Piece], columns: list[tuple[float, float]], width: float) -> list[Piece]:
    """Ahead of each block over most of the page come the blocks above it, column by column; after the last one, whichever column's next
    block stands highest. A block belongs to the column whose middle is nearest to its own; on a page of one column the order is that of the tops."""
    if len(columns) <= 1:
        return sorted(blocks, key=lambda b: b.top)
    spans = sorted((b for b in blocks if b.right - b.left > SPANNING * width), key=lambda b: b.top)
    own: list[list[Piece]] = [[] for _ in columns]
    for b in sorted((b for b in blocks if b.right - b.left <= SPANNING * width), key=lambda b: b.top):
        own[min(range(len(columns)), key=lambda k: abs((b.left + b.right) / 2 - sum(columns[k]) / 2))].append(b)
    out = []
    for span in spans:
        for column in own:
            while column and column[0].top < span.top:
                out.append(column.pop(0))
        out.append(span)
    while any(own):
        out.append(min((column for column in own if column), key=lambda column: column[0].top).pop(0))
    return out


def in_margin(b: Piece, page_height: float, body: float) -> str | None:
    """header or footer: wholly in the band, short and not larger than body text; a footer has a page number or at most 120 bytes."""
    short = b.height < 0.05 * page_height and b.size <= 1.2 * body
    if short and b.bottom <= HEADER * page_height:
        return "header"
    if short and b.top >= FOOTER * page_height and (re.fullmatch(r"-?\s*\d+\s*-?|\d+\s*/\s*\d+", b.text.strip()) or len(b.text.encode()) <= 120):
        return "footer"
    return None


def page_blocks(fragments: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, page, block, text, left, top, right, bottom, size, bold) from (doc, page, text, left, top, width, height, size, bold), in reading order."""

    def layout(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, page, fs in zip(f["doc"], f["page"], f["fs"], strict=True):
                pieces = [Piece(x["text"], x["left"], x["top"], x["left"] + x["width"], x["top"] + x["height"], x["size"], bool(x["bold"])) for x in fs if x["text"] and x["text"].strip()]
                cols = columns_of(pieces, width)
                lefts, by = [a for a, _ in cols], {}
                for p in pieces:
                    by.setdefault(-1 if p.right - p.left >= SPANNING * width else column_at(p.left, lefts), []).append(p)
                blocks = [b for part in by.values() for b in blocks_of(lines_of(part))]
                rows += [(doc, page, i, b.text, b.left, b.top, b.right, b.bottom, b.size, b.bold) for i, b in enumerate(reading_order(blocks, cols, width), 1)]
            yield pd.DataFrame(rows, columns=["doc", "page", "block", "text", "left", "top", "right", "bottom", "size", "bold"])

    one = F.struct(*[F.col(c) for c in ("top", "left", "text", "width", "height", "size", "bold")])
    pages = fragments.groupBy("doc", "page").agg(F.array_sort(F.collect_list(one)).alias("fs"))  # a page is bounded
    return pages.mapInPandas(layout, "doc string, page int, block int, text string, left double, top double, right double, bottom double, size double, bold boolean")


def body_size(blocks: DataFrame, doc: str, size: str, text: str) -> DataFrame:
    """(doc, body): the size most characters are set in; of equals the smaller."""
    per = blocks.filter(F.col(text).isNotNull()).groupBy(doc, F.round(F.col(size) * 10).cast("long").alias("s")).agg(F.sum(F.length(text)).alias("n"))
    return per.groupBy(doc).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("s")).select(doc, (F.col("s") / 10).alias("body"))


def heading_levels(blocks: DataFrame, doc: str, size: str, text: str) -> DataFrame:
    """(doc, size, level): the six largest sizes over 1.1 of the body's, largest first."""
    sizes = blocks.filter(F.col(text).isNotNull()).select(doc, (F.round(F.col(size) * 10) / 10).alias("size")).distinct().join(body_size(blocks, doc, size, text), doc)
    return sizes.filter(F.col("size") > F.col("body") * HEADING).withColumn("level", F.row_number().over(W.partitionBy(doc).orderBy(F.desc("size")))).filter(F.col("level") <= LEVELS).select(doc, "size", "level")


def repeated_edges(blocks: DataFrame, doc: str, page: str, top: str, order: str, text: str, least: int = 3) -> DataFrame:
    """(doc, text, votes): texts that are the first or the last block of a page, with a vote from each; a page of one block votes twice."""
    key = F.struct(F.col(top), F.col(order))
    ends = blocks.filter(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(doc, page).agg(F.min_by(text, key).alias("a"), F.max_by(text, key).alias("b"))
    return ends.select(doc, F.explode(F.array("a", "b")).alias("text")).groupBy(doc, "text").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def markdown(blocks: DataFrame, doc: str, page: str, order: str, size: str, text: str, bold: str) -> DataFrame:
    """(doc, page, markdown): headings by size, one first-level heading per document (later ones become second level), bold blocks marked."""
    b = blocks.filter(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("_s", F.round(F.col(size) * 10) / 10)
    b = b.join(heading_levels(blocks, doc, size, text).withColumnRenamed("size", "_s"), [doc, "_s"], "left")
    before = F.max((F.col("level") == 1).cast("int")).over(W.partitionBy(doc).orderBy(page, order).rowsBetween(W.unboundedPreceding, -1))
    level = F.when((F.col("level") == 1) & (F.coalesce(before, F.lit(0)) == 1), 2).otherwise(F.col("level"))
    line = F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col(text))).when(F.coalesce(bold, F.lit(False)), F.concat(F.lit("**"), F.col(text), F.lit("**"))).otherwise(F.col(text))
    rows = b.select(doc, page, F.col(order).alias("_o"), line.alias("_t"))
    return rows.groupBy(doc, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]), "\n\n").alias("markdown"))
