"""Problem 8: ids of a public byte-level BPE tokenizer for every text.

Each partition keeps its distinct stretches as rows (stretch, position, token) in DuckDB, where a recursive query joins neighbouring
tokens with the merge table and contracts the leftmost pair of least rank of every stretch, until no pair is left. The rounds of a stretch
grow with its length, so long ones are contracted window by window: ids are those of the whole exactly when every two neighbouring tokens
are what the query makes of their bytes, which is checked at each seam; where it fails, tokens on both sides are contracted anew.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

#: Where the tokenizer files lie; a parameter of every function, never copied into the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: how byte_bpe_50k parts a text before merging, so that no token spans two parts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches whose ids a task keeps across its batches; beyond, it forgets and encodes anew.
KEPT = 400_000
#: Bytes of a stretch that are contracted at once, and tokens on each side of a seam that are contracted anew where it doesn't hold.
WINDOW, SEAM = 64, 4

_MERGE = """
WITH RECURSIVE step(w, pos, tok, round, open) AS (
  SELECT w, pos, tok, 0, true FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT s.w, s.pos, s.tok, s.round, lead(s.pos) OVER o AS next_pos, lead(s.tok) OVER o AS next_tok
     FROM step s WHERE s.open WINDOW o AS (PARTITION BY s.w ORDER BY s.pos)),
   ranked AS (SELECT p.w, p.pos, p.tok, p.round, p.next_pos, m.merged, m.rank FROM pairs p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next_tok),
   best AS (SELECT w, min(rank * 4294967296 + pos) AS b, arg_min(pos, rank * 4294967296 + pos) AS at, arg_min(next_pos, rank * 4294967296 + pos) AS gone, arg_min(merged, rank * 4294967296 + pos) AS merged FROM ranked WHERE rank IS NOT NULL GROUP BY w)
   SELECT r.w, r.pos, CASE WHEN r.pos = b.at THEN b.merged ELSE r.tok END, r.round + 1, true
   FROM ranked r JOIN best b ON r.w = b.w WHERE r.pos <> b.gone))
, last AS (SELECT w, max(round) AS round FROM step GROUP BY w)
SELECT s.w, list(s.tok ORDER BY s.pos) AS ids FROM step s JOIN last l ON s.w = l.w AND s.round = l.round GROUP BY s.w ORDER BY s.w
"""


def _bytes_of_letters() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable letter: printable ones as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes batches of texts in one process; ids of stretches are kept between batches."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _bytes_of_letters(), model["vocab"]
        self.byte_id = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        table = pa.table({"l": pa.array([vocab[a] for a, _ in merges], pa.int32()), "r": pa.array([vocab[b] for _, b in merges], pa.int32()), "merged": pa.array([vocab[a + b] for a, b in merges], pa.int32()), "rank": pa.array(range(len(merges)), pa.int64())})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        # A merge reaches across two bytes only if some token holds them side by side: elsewhere a part can be cut with no change of its ids.
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            b = [letters[c] for c in token if c in letters]
            for x, y in zip(b, b[1:], strict=False):
                self.joined[x, y] = True
        self.raw = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
        self.parts = regex.compile(PATTERN)
        self.word: dict[str, tuple[int, ...]] = {}
        self.stretch: dict[bytes, tuple[int, ...]] = {}

    def _cut(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """The stretches of all words one after the other, and where those of each word begin."""
        raw = [w.encode("utf-8") for w in words]
        blob = b"".join(raw)
        b = np.frombuffer(blob, dtype=np.uint8)
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[b[:-1], b[1:]]
        starts = np.cumsum([0, *map(len, raw)])
        cut[starts] = True
        edges = np.flatnonzero(cut)
        at = edges.tolist()
        return [blob[x:y] for x, y in zip(at, at[1:], strict=False)], np.searchsorted(edges, starts).tolist()

    def _merge(self, new: list[bytes]) -> None:
        """Ids of the stretches, long ones by windows."""
        self._contract([s for s in new if len(s) <= WINDOW])
        if long := [s for s in new if len(s) > WINDOW]:
            self._by_windows(long)

    def _by_windows(self, long: list[bytes]) -> None:
        """Ids of long stretches: windows are contracted, then every seam that doesn't hold is, with ever more tokens around it."""
        windows = [[s[i : i + WINDOW] for i in range(0, len(s), WINDOW)] for s in long]
        self._contract([w for ws in windows for w in ws])
        runs = [[list(self.stretch[w]) for w in ws] for ws in windows]
        held = [[False] * (len(ws) - 1) for ws in windows]
        wide = SEAM
        while any(not all(h) for h in held):
            pair = lambda a, b: self.raw[a[-1]] + self.raw[b[0]]
            self._contract([pair(r[i], r[i + 1]) for r, h in zip(runs, held, strict=True) for i, ok in enumerate(h) if not ok])
            cut: list[tuple[int, list]] = []
            for k, (r, h) in enumerate(zip(runs, held, strict=True)):
                parts, i = [[r[0], True]], 1  # token runs, each with whether the seam before it holds
                for i in range(1, len(r)):
                    parts.append([r[i], h[i - 1] or self.stretch[pair(r[i - 1], r[i])] == (r[i - 1][-1], r[i][0])])
                out, i = [parts[0]], 1
                while i < len(parts):
                    tokens, ok = parts[i]
                    left = out[-1]
                    if ok or (len(left) == 3 and len(left[0]) < wide):  # what was just cut out here comes first; the seam waits for the next round
                        out.append([tokens, ok])
                    else:
                        a, b = left[0][-wide:], tokens[:wide]
                        left[0] = left[0][:-wide]
                        middle = [a + b, not left[0] and left[1], None]
                        if not left[0]:
                            out.pop()
                        out.append(middle)
                        cut.append((k, middle))
                        if len(tokens) > wide:
                            out.append([tokens[wide:], False])
                        elif i + 1 < len(parts):
                            parts[i + 1][1] = False
                    i += 1
                runs[k] = out
            self._contract([b"".join(self.raw[t] for t in m[0]) for _, m in cut])
            for _, m in cut:
                m[0] = list(self.stretch[b"".join(self.raw[t] for t in m[0])])
            held = [[bool(p[1]) and not (len(p) == 3 or len(q) == 3) for q, p in zip(r, r[1:], strict=False)] for r in runs]
            runs = [[p[0] for p in r] for r in runs]
            wide *= 2
        for s, r in zip(long, runs, strict=True):
            self.stretch[s] = tuple(t for x in r for t in x)

    def _contract(self, new: list[bytes]) -> None:
        """Ids of the stretches not known yet, by the recursive query, in blocks of bounded size."""
        new = sorted({s for s in new if s not in self.stretch}, key=len)
        for s in new:
            if len(s) == 1:
                self.stretch[s] = (int(self.byte_id[s[0]]),)
        new = [s for s in new if len(s) > 1]
        i = 0
        while i < len(new):
            block, size = [], 0
            while i < len(new) and (not block or size + len(new[i]) ** 2 < 6_000_000):
                block.append(new[i])
                size += len(new[i]) ** 2  # rows of all rounds of a stretch are about half its length squared
                i += 1
            lengths = np.array([len(b) for b in block])
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            tokens = self.byte_id[np.frombuffer(b"".join(block), dtype=np.uint8)]
            self.db.register("start", pa.table({"w": np.repeat(np.arange(len(block), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "tok": tokens}))
            for (ids,), b in zip(self.db.execute(f"SELECT ids FROM ({_MERGE})").fetchall(), block, strict=True):
                self.stretch[b] = tuple(ids)
            self.db.unregister("start")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets at which each text's begin; null and empty texts have none."""
        words = [self.parts.findall(t) if t else [] for t in texts]
        if len(self.word) > KEPT:
            self.word.clear()
        if len(self.stretch) > KEPT:
            self.stretch.clear()
            self.word.clear()
        fresh = list({w for ws in words for w in ws if w not in self.word})
        if fresh:
            cut, begins = self._cut(fresh)
            new = {s for s in cut if s not in self.stretch}
            for s in [s for s in new if len(s) == 1]:
                self.stretch[s] = (int(self.byte_id[s[0]]),)
            self._merge(sorted((s for s in new if len(s) > 1), key=len))
            parts = [self.stretch[s] for s in cut]
            for w, i, j in zip(fresh, begins, begins[1:], strict=False):
                self.word[w] = parts[i] if j == i + 1 else tuple(x for p in parts[i:j] for x in p)
        known, out, ends = self.word, [], [0]
        for ws in words:
            for w in ws:
                out += known[w]
            ends.append(len(out))
        return np.array(out, dtype=np.int32), np.array(ends, dtype=np.int32)


@lru_cache(2)
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def encode(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): the ids of every text, without special tokens; strings that look like special tokens are ordinary text.

    Null and empty texts give an empty array. The work is one narrow stage: nothing is shuffled but to spread a small input.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            step = 2000
            for at in range(0, len(texts), step):
                flat, ends = e.encode(texts[at : at + step])
                yield pa.RecordBatch.from_arrays([keys[at : at + step], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(ids, f"`{key}` {kind}, ids array<int>")
