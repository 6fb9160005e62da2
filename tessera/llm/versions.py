"""Problem 1: texts that share most of their content, by MinHash with Bayesian pruning of candidates.

Documents become bags of five-word stretches. MinHash bands bring candidates together; their MinHash values are then compared a block
at a time, and a pair is dropped as soon as the posterior probability of its reaching the similarity bar falls below a tolerance.
What stays is verified exactly on the bags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

#: MinHash bands and rows: two texts of Jaccard similarity s meet with probability 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 40, 3
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
BLOCK, TOLERANCE = 24, 0.005
#: Members up to which a class of equal texts is expanded into all pairs, where the caller doesn't ask for all of them.
WHOLE = 64
#: Classes up to which those of a band are paired in one go; of a larger band, blocks of so many are, each two in a task's cell of their own.
HOT = 1024
#: Rows up to which the keys of candidate texts are broadcast; beyond, the texts are shuffled to them.
BROADCAST_ROWS = 500_000
WORDS = re.compile("[㐀-鿿]|[ぁ-ゖゝ-ゟァ-ヺー-ヿ]+|[^\\W_\u3040-\u30ff㐀-鿿]+")

_RNG = np.random.default_rng(20240229)
_MULT = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits in lower case; runs of kana are parted from other letters, a Han character is a word of its own."""
    return WORDS.findall(text.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the stretches of `width` words of texts; word hashes are kept, up to a bound."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All stretches of all documents one after the other, and the offsets at which each document's begin."""
        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in {w for d in docs for w in d if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for d in docs for w in d), dtype=np.uint64, count=sum(map(len, docs)))
        s = np.zeros(max(len(h) - self.width + 1, 0), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.width):
                s = s * _MIX + h[i : len(h) - self.width + 1 + i] if len(s) else s
            s = _mixed(s)
        n = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(n)])
        counts = np.maximum(n - self.width + 1, 0)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], counts) + np.repeat(starts[:-1], counts)
        return s[at], ends


def minhashes(stretches: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, BANDS x ROWS) least hash values; every document must have a stretch."""
    out = np.empty((len(ends) - 1, BANDS * ROWS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_MULT):
            out[:, i] = np.minimum.reduceat(stretches * m >> np.uint64(16), ends[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS): 16 bits of each value, those of a band's ROWS values side by side in one number, with the band's own above."""
    short = (_mixed(sig) >> np.uint64(48)).reshape(len(sig), BANDS, ROWS)
    x = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), short.shape[:2]).copy()
    for i in range(ROWS):
        x = (x << np.uint64(16)) | short[:, :, i]
    return x.view(np.int64)


def values_of(bands: np.ndarray) -> np.ndarray:
    """The 16 bits of each value back from the bands' keys."""
    return np.stack([(bands >> (16 * i)) & 0xFFFF for i in reversed(range(ROWS))], axis=2).reshape(len(bands), -1)


def least_matches(similarity: float, sizes: list[int], tolerance: float = TOLERANCE) -> list[int]:
    """For each number of values compared, the least number of matches with which P(Jaccard >= similarity) is at least the tolerance.

    The prior is uniform, so after m matches of n the posterior is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in sizes:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= similarity].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return out


def fingerprints(df: DataFrame, key: str, title: str, text: str, least: int, most: int, width: int, sketch: bool) -> DataFrame:
    """(key, cls, bands, bag) of the texts with `least` to `most` words: title and text together as words.

    cls is a hash of the word sequence, so equal texts share it; with sketch, bands holds the MinHash values, 16 bits of each; without,
    bag holds the sorted 32-bit hashes of all stretches, with their multiplicity. Both are null but for the first text of each class in
    a partition (as long as it remembers the class).
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys, docs, cls, fresh = [], [], [], []
                for k, head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    w = words(body)
                    if not least <= len(w) <= most:
                        continue
                    if head:
                        w = words(head) + w
                    if len(w) < width:
                        continue
                    c = xxhash.xxh3_64_intdigest("\x1f".join(w))
                    if c not in seen:
                        seen.add(c)
                        fresh.append(len(keys))
                        docs.append(w)
                    keys.append(k)
                    cls.append(c)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not keys:
                    continue
                bands, bags = pa.nulls(len(keys), pa.list_(pa.int64())), pa.nulls(len(keys), pa.binary())
                if docs:
                    s, ends = shingler(docs)
                    place = np.full(len(keys), -1)
                    place[fresh] = np.arange(len(fresh))
                    at_ = pa.array(place, mask=place < 0)
                    if sketch:
                        bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(minhashes(s, ends)).ravel()), BANDS).cast(pa.list_(pa.int64())).take(at_)
                    else:
                        small = (s >> np.uint64(32)).astype(np.uint32)
                        bags = pa.array([np.sort(small[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()).take(at_)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.array(cls, dtype=np.uint64).view(np.int64)), bands, bags], names=["key", "cls", "bands", "bag"])

    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{title}`").alias("title"), F.col(f"`{text}`").alias("text")).filter(F.length("text") >= least)
    return spread(rows).mapInArrow(make, "key string, cls long, bands array<long>, bag binary")


def common(a: bytes, b: bytes) -> int:
    """Stretches in common, with multiplicity, of two sorted bags."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    u, n = np.unique(x, return_counts=True)
    v, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def alike(x: np.ndarray, y: np.ndarray, sizes: list[int], need: list[int]) -> np.ndarray:
    """Which rows of two arrays of MinHash values stay, compared a block at a time: the posterior of reaching the bar is never too low."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for end, m in zip(sizes, need, strict=True):
        matches[alive] += (x[alive, end - BLOCK : end] == y[alive, end - BLOCK : end]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


def band_pairs(batches: Iterator[pa.RecordBatch], hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """Of rows (cls, band), all of a band in one partition: (a, b, hot) pairs a < b of the classes of a band; of a band of more than `hot`
    classes, its members as (cls, band, true)."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    rows = pa.Table.from_batches(whole)
    cls, band = rows.column("cls").to_numpy(), rows.column("band").to_numpy()
    order = np.lexsort((cls, band))
    cls, band = cls[order], band[order]
    first = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (cls[1:] != cls[:-1])])
    cls, band = cls[first], band[first]
    starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    sizes = np.diff(np.r_[starts, len(band)])
    row = lambda a, b, h: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), h))], names=["a", "b", "hot"])
    for n in np.unique(sizes[sizes > 1]):
        of = starts[sizes == n]
        if n > hot:
            for at in of:
                yield row(cls[at : at + n], band[at : at + n], True)
            continue
        i, j = np.triu_indices(n, 1)
        step = max(1, 200_000 // len(i))
        for at in range(0, len(of), step):
            some = cls[of[at : at + step, None] + np.arange(n)]
            yield row(some[:, i].ravel(), some[:, j].ravel(), False)


def hot_pairs(hot: DataFrame, prints: DataFrame, sizes: list[int], need: list[int], size: int = HOT) -> DataFrame:
    """(a, b) of the classes of bands too large to pair in one go (cls, band): blocks of a band meet two by two, each in a cell of its own.

    A pair is compared by its MinHash values at once, in the first hot band that it shares: it comes out once, and only if it stays.
    """
    counts = hot.groupBy("band").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    bands_of = hot.groupBy("cls").agg(F.sort_array(F.collect_set("band")).alias("hot"))  # at most BANDS
    sketches = prints.filter("bands IS NOT NULL").select("cls", "bands").join(bands_of, "cls").dropDuplicates(["cls"])
    members = hot.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).join(sketches, "cls")
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "bands", "hot")

    def meet(f: pa.Table) -> pa.Table:
        out_a, out_b = [np.array([], np.int64)], [np.array([], np.int64)]
        band, i, j = (f.column(c)[0].as_py() for c in ("band", "i", "j"))
        cls, block = f.column("cls").to_numpy(), f.column("block").to_numpy()
        values = values_of(np.array(f.column("bands").to_pylist(), dtype=np.int64).reshape(len(cls), BANDS))
        mine = f.column("hot").to_pylist()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        earlier = [{b for b in h if b < band} for h in mine]
        for x in left:
            ys = right[right > x] if i == j else right
            ys = ys[alike(np.broadcast_to(values[x], (len(ys), values.shape[1])), values[ys], sizes, need)] if len(ys) else ys
            ys = np.array([y for y in ys if earlier[x].isdisjoint(earlier[y])], dtype=np.int64)
            out_a.append(np.minimum(cls[x], cls[ys]))
            out_b.append(np.maximum(cls[x], cls[ys]))
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return cells.groupBy("band", "i", "j").applyInArrow(meet, "a long, b long")


def version_pairs(df: DataFrame, key: str, title: str, text: str, bar: float = 0.45, least: int = 60, most: int = 1500, width: int = 5, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, common, share) of classes of equal texts, a < b, and members (cls, key).

    A pair is one whose stretches in common are at least `bar` of those of the longer text. Null, empty and too short or too long texts
    are in no class; a null title counts as none; a redelivered row is one member. Texts are read twice: all of them for their MinHash
    values, and those of the candidates for their bags.
    """
    # With common = bar x the longer, Jaccard is least for texts of equal length.
    jaccard = bar / (2 - bar)
    sizes = [*range(BLOCK, BANDS * ROWS + 1, BLOCK)]
    need = least_matches(jaccard, sizes)
    prints = cut_lineage(fingerprints(df, key, title, text, least, most, width, True).select("key", "cls", "bands"))
    members = prints.select("cls", "key").distinct()
    bands = prints.filter("bands IS NOT NULL").select("cls", F.explode("bands").alias("band")).repartition("band")
    met = cut_lineage(bands.mapInArrow(lambda x: band_pairs(x, hot), "a long, b long, hot boolean").distinct())
    candidates, crowded = met.filter("NOT hot").select("a", "b"), met.filter("hot").select(F.col("a").alias("cls"), F.col("b").alias("band"))
    if not crowded.isEmpty():
        candidates = candidates.unionByName(hot_pairs(crowded, prints, sizes, need, hot)).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (values_of(batch.column(i).flatten().to_numpy().reshape(n, BANDS)) for i in (2, 3))
            rows = batch.take(pa.array(alike(x, y, sizes, need)))
            bags = list(zip(rows.column(4).to_pylist(), rows.column(5).to_pylist(), strict=True))
            c = np.array([common(p, q) for p, q in bags], dtype=np.int64)
            longest = np.array([max(len(p), len(q)) // 4 for p, q in bags], dtype=np.int64)
            ok = c >= bar * longest - 1e-9
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(ok)), rows.column(1).filter(pa.array(ok)), pa.array(c[ok]), pa.array(c[ok] / np.maximum(longest[ok], 1))], names=["a", "b", "common", "share"])

    asked = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    faces = cut_lineage(prints.filter("bands IS NOT NULL").join(asked, "cls", "left_semi").groupBy("cls").agg(F.min_by(F.struct("key", "bands"), "key").alias("x")).select("cls", "x.key", "x.bands"))
    keys = faces.select(F.col("key").alias(key))
    texts = df.join(F.broadcast(keys) if faces.count() <= BROADCAST_ROWS else keys, key, "left_semi")
    bags = fingerprints(texts, key, title, text, least, most, width, False).filter("bag IS NOT NULL").select("cls", "bag").dropDuplicates(["cls"])
    print_of = faces.select("cls", "bands").join(bags, "cls")
    pairs = candidates.join(print_of.select(F.col("cls").alias("a"), F.col("bands").alias("sa"), F.col("bag").alias("ba")), "a")
    pairs = pairs.join(print_of.select(F.col("cls").alias("b"), F.col("bands").alias("sb"), F.col("bag").alias("bb")), "b").select("a", "b", "sa", "sb", "ba", "bb")
    return pairs.mapInArrow(verify, "a long, b long, common long, share double"), members


def version_links(df: DataFrame, key: str, title: str, text: str, bar: float = 0.45, least: int = 60, most: int = 1500, width: int = 5, whole: int | None = WHOLE) -> DataFrame:
    """(key_a, key_b), a < b: all pairs of members of linked classes, and within a class of equal texts every pair up to `whole` members;
    beyond, each member with the class's least key, through which its links to other texts go: none between different texts is lost.
    With None, copies are expanded into all pairs whatever their number."""
    whole = 2**62 if whole is None else whole
    pairs, members = version_pairs(df, key, title, text, bar, least, most, width)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    m = members.join(sizes, "cls")
    # Of a large class of equal texts only the least key is paired with other texts; its members are linked to that key.
    faces = m.filter((F.col("n") <= whole) | (F.col("key") == F.col("first"))).select("cls", "key")
    across = pairs.select("a", "b").join(faces.withColumnsRenamed({"cls": "a", "key": "x"}), "a").join(faces.withColumnsRenamed({"cls": "b", "key": "y"}), "b").select("x", "y")
    several = m.filter((F.col("n") > 1) & (F.col("n") <= whole)).select("cls", "key")
    inside = several.withColumnRenamed("key", "x").join(several.withColumnRenamed("key", "y"), "cls").filter("x < y").select("x", "y")
    star = m.filter((F.col("n") > whole) & (F.col("first") < F.col("key"))).select(F.col("first").alias("x"), F.col("key").alias("y"))
    both = across.unionByName(inside).unionByName(star)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
