"""Problem 4: cut oversized texts at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

LEVELS = ("paragraph", "sentence", "word", "hard")
#: What a cut at each level costs, against a cost of 1 for a piece as far from the even length as it can be.
PENALTY = {"paragraph": 0.0, "sentence": 2.0, "word": 8.0, "hard": 32.0}
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_WORD = re.compile(r"\s+")


def boundaries(text: str, level: str) -> list[int]:
    """Offsets in text at which a piece may end, of one level alone: the end of the white space after the unit."""
    n = len(text)
    if level == "hard":
        return list(range(1, n))
    pattern = {"paragraph": _PARAGRAPH, "sentence": _SENTENCE, "word": _WORD}[level]
    return [m.end() for m in pattern.finditer(text) if 0 < m.end() < n]


def cut_points(text: str, level: str) -> dict[int, str]:
    """Offsets of this level and the coarser ones, each with its coarsest level."""
    out: dict[int, str] = {}
    for name in LEVELS[: LEVELS.index(level) + 1]:
        for p in boundaries(text, name):
            out.setdefault(p, name)
    return out


def best_cuts(text: str, points: dict[int, str], limit: int, overlap: int = 0) -> list[int] | None:
    """The ends of the pieces at least total cost, or None when no choice of these points keeps every piece within the limit.

    A piece begins `overlap` characters ahead of the end of the one before, and its length counts without the white space at its ends.
    Cost of a piece: the penalty of its cut, and the square of its distance from the even length over that length. Ties: fewest
    pieces first, then the earlier cut.
    """
    n = len(text)
    ends = np.array([*sorted(points), n])
    solid = np.array([len(text[:e].rstrip()) for e in ends]) if n < 1 << 14 else _solid(text, ends)
    pieces = max(1, -(-n // max(1, limit - overlap)))
    even = n / pieces
    penalty = np.array([*(PENALTY[points[p]] for p in sorted(points)), 0.0])
    starts = np.concatenate([[0], np.maximum(ends[:-1] - overlap, 0)])  # of the piece after each end
    cost, back = np.full(len(ends) + 1, np.inf), np.zeros(len(ends) + 1, dtype=np.int64)
    cost[0] = 0.0
    lo = 0
    for j in range(len(ends)):
        while lo <= j and solid[j] - starts[lo] > limit:
            lo += 1
        if lo > j:
            return None
        c = cost[lo : j + 1] + np.square((solid[j] - starts[lo : j + 1] - even) / even)
        k = int(np.argmin(c))
        if np.isinf(c[k]):
            cost[j + 1] = np.inf
        else:
            cost[j + 1], back[j + 1] = c[k] + penalty[j], lo + k
    if np.isinf(cost[-1]):
        return None
    out, j = [], len(ends)
    while j > 0:
        out.append(int(ends[j - 1]))
        j = int(back[j])
    return out[::-1]


def _solid(text: str, ends: np.ndarray) -> np.ndarray:
    """Where the last character ahead of each end that isn't white space ends."""
    space = np.array([c.isspace() for c in text])
    last = np.maximum.accumulate(np.where(space, 0, np.arange(1, len(text) + 1)))
    return last[ends - 1]


def coarsest_cut(text: str, limit: int) -> str | None:
    """The coarsest level at which cutting alone gets all pieces within the limit; None for a text within it."""
    text = text.strip()
    if len(text) <= limit:
        return None
    for level in LEVELS[:-1]:
        # Ends of sentences count along with blank lines; white space has both.
        points = dict.fromkeys(boundaries(text, level), level) if level == "word" else cut_points(text, level)
        if best_cuts(text, points, limit) is not None:
            return level
    return "hard"


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, cut) of the pieces of a text without the white space at its ends; cut is the level of the piece's end, "end" for the last.

    The finest level tried is the coarsest that makes a cut within the limit possible; hard cuts come into play only where
    a stretch without white space is longer than a piece may be, and only inside such stretches.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text), "end")] if text else []
    for level in LEVELS[:-1]:
        points = cut_points(text, level)
        if (ends := best_cuts(text, points, limit, overlap)) is not None:
            break
    else:
        points, room = cut_points(text, "word"), limit - overlap
        edges = [0, *sorted(points), len(text)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > room // 2:
                for p in range(a + room // 2, b, max(1, room // 8)):
                    points.setdefault(p, "hard")
        ends = best_cuts(text, points, limit, overlap)
    out, start = [], 0
    for e in ends:
        out.append((start, e, points.get(e, "end")))
        start = max(e - overlap, 0)
    return out


def oversized(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, cut) of the texts of more than `limit` code points, white space at the ends aside; a key counts once."""

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (c := coarsest_cut(t, limit))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=[key, "cut"])

    long = df.select(F.col(f"`{key}`").cast("string").alias(key), F.col(f"`{text}`").alias("text")).filter(F.length("text") > limit)
    return spread(long).mapInArrow(cuts, f"`{key}` string, cut string").distinct()


def split(df: DataFrame, key: str, text: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, start, end, cut, piece): every text in pieces of at most `limit` code points.

    Consecutive pieces share exactly `overlap` characters; offsets count within the text trimmed of white space. Texts within the
    limit are one piece; null, empty and blank texts have none. Rows that are equal in key and text count once.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = t.strip()
                out += [(k, i, a, b, c, t[a:b].rstrip()) for i, (a, b, c) in enumerate(split_text(t, limit, overlap), 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[key, "piece_no", "start", "end", "cut", "piece"])

    rows = df.select(F.col(f"`{key}`").cast("string").alias(key), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull()).distinct()
    return rows.mapInArrow(pieces, f"`{key}` string, piece_no int, start long, `end` long, cut string, piece string")
