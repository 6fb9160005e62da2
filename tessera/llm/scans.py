"""Problem 3: text of scanned pages: words cut at line ends, misread characters, running heads and page numbers.

Misreadings: words that are rare against a frequent word of which they keep most q-grams. An inverted join on character q-grams
retrieves the candidates, and undoing the known misreadings adds those that several of them leave with too few q-grams; a
gradient-boosted model ranks them. Cut words: a boosted classifier over the pairs of a line's end and the next line's start. Furniture:
pairs of edge lines of one file that agree but for numbers and misreadings, counted by page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import Boosted
from tessera.session import cut_lineage, spread

# What scanning makes of characters (left as printed, right as read); each may also be met the other way round.
CONFUSIONS = [
    ("m", "rn"), ("n", "ri"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("w", "vv"), ("e", "c"), ("t", "f"), ("o", "0"), ("l", "1"), ("i", "!"), ("i", "1"), ("a", "@"), ("s", "$"), ("s", "5"), ("g", "9"), ("b", "8"), ("ó", "6"), ("é", "6"), ("o", "6"),
    ("е", "с"), ("и", "н"), ("н", "и"), ("п", "л"), ("л", "п"), ("г", "т"), ("т", "7"), ("о", "0"), ("з", "3"), ("б", "6"), ("ч", "4"), ("ы", "ь1")]
SYMBOLS = "0-9@$!"
_SYMBOLS = frozenset("0123456789@$!")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
CYRILLIC = "Ѐ-ӿ"
LETTERS = LATIN + CYRILLIC
#: Marks at which words are cut at line ends.
MARKS = "-¬=­‐‑~"
#: A word counts as frequent from this share of all words on (so there are at most 500,000), and from this many times.
FREQUENT_SHARE, FREQUENT_LEAST = 2e-6, 6
#: How many times as frequent a word must be to be a candidate for another, and misreadings that a word may have.
RATIO, MOST = 12, 3
BROADCAST_ROWS = 300_000
# Words that stand beside page numbers.
PAGE_WORDS = ("page", "p", "pg", "seite", "s", "página", "pagina", "pág", "стр", "с", "страница", "第", "페이지", "쪽", "ページ", "頁", "页")
_JOINED = r"+/=\u00ad\u0300-\u036f\u200b-\u200f\u2060-\u2064\ufeff"  # a word beside one of these is part of something else
_TOKEN = re.compile(rf"(?<![\w{SYMBOLS}{_JOINED}])[{LETTERS}{SYMBOLS}]++(?![^\W_]|[{_JOINED}])")
_LETTER = re.compile(f"[{LETTERS}]")
_ANY_LETTER = re.compile(r"[^\W\d_]")
_JOINT = re.compile(rf"(?<=[^\W\d_])[{MARKS}][ \t]*\n[ \t]*(?=[^\W\d_])")
_BREAK = re.compile(rf"[{MARKS}][ \t]*\n[ \t]*")
_TAIL = re.compile(r"[^\W\d_](?:[^\W_]|[@$!])*")
#: Characters of a line of a page, at most; what is longer is a paragraph, not a line at the edge.
LINE = 240
#: Tokens between blanks that a task counts, or knows the words of, at a time.
KEPT = 500_000


def pages_of(units: DataFrame, key: str, asset: str, ordinal: str, text: str) -> DataFrame:
    c = lambda x: F.col(f"`{x}`")
    return spread(units.select(c(key).cast("string").alias("key"), c(asset).cast("string").alias("asset"), c(ordinal).cast("int").alias("ordinal"), c(text).alias("text")).filter(F.col("text").isNotNull()))


def tokens_of(text: str) -> list[str]:
    """What stands between blanks, words cut at line ends put together."""
    return (_JOINT.sub("", text) if "\n" in text and _BREAK.search(text) else text).split()


def cut_places(text: str) -> list[tuple[int, int, str, str]]:
    """(end of the head, end of the break, head, tail) of the words that a mark at a line's end may have cut."""
    out = []
    for m in _BREAK.finditer(text):
        start = end = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "@$!"):
            start -= 1
        if start < end and (tail := _TAIL.match(text, m.end())):
            out.append((end, m.end(), text[start:end], tail[0]))
    return out


def joined_cuts(text: str, cut: set[str]) -> str:
    """The text with those words put together that are in the set, as head and tail with a line's end between; the rest of the line follows on
    a line of its own."""
    out, last = [], 0
    for end, after, head, tail in cut_places(text):
        if f"{head}\n{tail}" in cut and end >= last:
            out += [text[last:end], tail, "\n"]
            last = after + len(tail)
    return "".join([*out, text[last:]])


def words_in(token: str) -> list[str]:
    """The words of a token in lower case: Latin and Cyrillic letters, with the symbols misreading puts in, three characters at least."""
    found = (w.lower().rstrip("!") for w in _TOKEN.findall(token))
    return [w for w in found if len(w) >= 3 and _LETTER.search(w)]


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n, own) over all pages: how often a word stands there, and how often when pages of equal text count once.

    A partition sends a text once, and once more with the number of its further copies; equal texts meet by their hash. Tokens are counted
    whole, each is parted into its words once.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = set(), {}
        row = lambda h, t, n: pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], names=["hash", "text", "n"])
        for batch in batches:
            hashes, fresh = batch.column(0).to_pylist(), []
            for i, h in enumerate(hashes):
                if h not in seen:
                    seen.add(h)
                    fresh.append(i)
                elif h in again:
                    again[h][1] += 1
                else:
                    again[h] = [batch.column(1)[i].as_py(), 1]
            some = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.ones(len(fresh), np.int64))], names=["hash", "text", "n"])
            if len(again) > 2000:
                yield row(list(again), *map(list, zip(*again.values(), strict=True)))
                again = {}
        if again:
            yield row(list(again), *map(list, zip(*again.values(), strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, more, seen = Counter(), Counter(), set()
        for batch in batches:
            for h, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = tokens_of(t)
                if h not in seen:
                    seen.add(h)
                    own.update(tokens)
                    n -= 1
                if n:
                    for w, k in Counter(tokens).items():
                        more[w] += n * k
            if len(own) > KEPT:
                yield counted(own, more)
                own, more = Counter(), Counter()
        yield counted(own, more)

    def counted(own: Counter, more: Counter) -> pa.RecordBatch:
        n: dict[str, list[int]] = {}
        for i, tokens in enumerate((own, more)):
            for t, k in tokens.items():
                for w in words_in(t):
                    n.setdefault(w, [0, 0])[i] += k
        a = np.array(list(n.values()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(a.sum(axis=1)), pa.array(a[:, 0])], names=["word", "n", "own"])

    texts = pages.select(F.xxhash64("text").alias("hash"), "text").mapInArrow(once, "hash long, text string, n long").repartition("hash")
    return texts.mapInArrow(count, "word string, n long, own long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def grams(word: Column) -> Column:
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, 3)))


_PAIRS = [*CONFUSIONS, *((b, a) for a, b in CONFUSIONS if b.isalpha())]
_BY_START: dict[str, list[tuple[str, str]]] = {}
for _good, _bad in _PAIRS:
    _BY_START.setdefault(_bad[0], []).append((_bad, _good))


def trigrams(word: str) -> set[str]:
    """What grams() gives, once each."""
    marked = f"^{word}$"
    return {marked[i : i + 3] for i in range(len(word))}


def least_shared(n: Column | int, legible: Column | int) -> Column | int:
    """Trigrams that a word shares at least with a candidate for it, of the n that the one with more of them has: half of them, of short
    words all but four, which is what one misreading can change. No more than the word has without symbols: any letter may stand there."""
    if isinstance(n, int):
        return max(1, min(n - 4, (n + 1) // 2, legible))
    return F.greatest(F.lit(1), F.least(n - 4, F.floor((n + 1) / 2), legible))


def rarest_grams(word: str, shared: dict[str, int]) -> tuple[int, int, int, list[str]]:
    """(number of the word's trigrams, of those without symbols, a bit for each trigram, those by which it is looked up): the rarest by the
    number of frequent words that share them, so many that two words without one in common there share too few in all. Trigrams that no
    frequent word has find nothing."""
    marked, own, bits = f"^{word}$", trigrams(word), 0
    for g in own:
        bits |= 1 << xxhash.xxh32_intdigest(g) % 64
    legible = {marked[i : i + 3] for i in range(len(word)) if _SYMBOLS.isdisjoint(word[max(i - 1, 0) : i + 2])}
    need = least_shared(len(own), len(legible))
    some = sorted(legible, key=lambda g: (shared.get(g, 0), g))[: len(legible) - need + 1] if sum(g in shared for g in legible) >= need else []
    return len(own), len(legible), bits - (bits >> 63 << 64), [g for g in some if g in shared]


def printed_forms(read: str, known: Container[str]) -> set[str]:
    """Every word that up to MOST known misreadings turn into read and whose trigrams are all known."""
    found, todo = set(), [(0, "^", 0)]
    while todo:
        i, out, used = todo.pop()
        if i == len(read):
            if used and out[-2:] + "$" in known:
                found.add(out[1:])
            continue
        for bad, good in ((read[i], read[i]), *(_BY_START.get(read[i], ()) if used < MOST else ())):
            if read.startswith(bad, i):
                now = out + good
                if all(now[k - 2 : k + 1] in known for k in range(max(len(out), 2), len(now))):
                    todo.append((i + len(bad), now, used + (bad != good)))
    return found - {read}


def explained(read: str, printed: str, symbols: bool = False) -> int:
    """How many known misreadings turn printed into read; 99 when they can't, or more than three would be needed. With `symbols`, any letter
    may be read as any symbol, too."""

    @lru_cache(None)
    def go(i: int, j: int) -> int:
        if i == len(read) or j == len(printed):
            return 0 if i == len(read) and j == len(printed) else 99
        best = go(i + 1, j + 1) if read[i] == printed[j] else 99
        if symbols and not read[i].isalpha():
            best = min(best, 1 + go(i + 1, j + 1))
        for bad, good in _BY_START.get(read[i], ()):
            if best > 1 and printed.startswith(good, j) and read.startswith(bad, i):
                best = min(best, 1 + go(i + len(bad), j + len(good)))
        return best

    n = go(0, 0)
    return n if n <= MOST else 99


def pair_features(read: list[str], printed: list[str], n_read: np.ndarray, n_printed: np.ndarray) -> np.ndarray:
    rows = []
    for r, p in zip(read, printed, strict=True):
        k = explained(r, p)
        odd = not r.isalpha()
        loose = explained(r, p, symbols=True) if odd and k == 99 else k
        a, b = trigrams(r), trigrams(p)
        rows.append((min(k, 4), min(loose, 4), odd + (odd and r[0].isalpha() and r[-1].isalpha()), len(a & b) / max(len(a | b), 1), len(r), abs(len(r) - len(p)), r[0] == p[0]))
    return np.column_stack([np.array(rows, dtype=float).reshape(-1, 7), np.log(n_printed / np.maximum(n_read, 1)), np.log1p(n_read)])


def misread(word: str, rng: np.random.Generator) -> str | None:
    """The word with one or two of the known misreadings."""
    for _ in range(1 + (rng.random() < 0.15)):
        spots = [(m.start(), a, b) for a, b in CONFUSIONS for m in re.finditer(re.escape(a), word)]
        if not spots:
            return None
        i, a, b = spots[rng.integers(len(spots))]
        word = word[:i] + b + word[i + len(a) :]
    return word


def misread_as_symbols(word: str, rng: np.random.Generator, inside: bool = True) -> str:
    """The word with one letter in its inside read as a symbol, any of them, of long words often two; or else up to three at an end."""
    if inside:
        spots = rng.choice(np.arange(1, len(word) - 1), 1 + int(len(word) >= 7 and rng.random() < 0.5), replace=False)
    else:
        n = int(rng.integers(1, min(4, len(word))))
        spots = range(n) if rng.random() < 0.3 else range(len(word) - n, len(word))
    out = list(word)
    for i in spots:
        out[i] = str(rng.choice(list("0123456789@$!")))
    return "".join(out)


def correction_ranker(frequent: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """Fitted on frequent words that are misread on purpose, against pairs of real words, words with letters changed at random, and what
    the trigrams of a misread word find beside the right one.

    Misreadings are the known ones and, within words, letters that are read as any symbol. Symbols at a word's end, or in one of four
    characters or fewer, are those of numbers and codes (2nd, b2b, sha256).
    """
    rng = np.random.default_rng(seed)
    known = {w for w, _ in frequent}
    own = {w: trigrams(w) for w in known}
    shared = Counter(g for w in known for g in own[w])
    by_gram: dict[str, list[tuple[str, int]]] = {}
    for w, n in frequent:
        for g in own[w]:
            by_gram.setdefault(g, []).append((w, n))
    read, printed, a, b, y = [], [], [], [], []

    def add(r: str, p: str, nr: float, np_: float, label: int) -> None:
        read.append(r)
        printed.append(p)
        a.append(nr)
        b.append(np_)
        y.append(label)

    def beside(m: str, w: str, seen: float) -> None:
        """Two words other than w, which m was made of, and another misreading of w, unless they explain m as well."""
        held, (_, legible, _, some) = trigrams(m), rarest_grams(m, shared)
        near = [(v, n) for g in some for v, n in by_gram[g] if v != w and len(own[v] & held) >= least_shared(max(len(held), len(own[v])), legible)]
        others = [near[i] for i in rng.integers(len(near), size=2)] if near else []
        if rng.random() < 0.2 and (other := misread(w, rng)) and other not in known and other.isalpha():
            others.append((other, seen * rng.uniform(RATIO, 4 * RATIO)))
        for v, n in others:
            if v != m and n >= seen * RATIO and explained(m, v, symbols=True) > explained(m, w, symbols=True):
                add(m, v, seen, n, 0)

    letters = sorted({c for w in known for c in w}) or ["a"]
    for w, n in frequent:
        seen = max(1, int(n * rng.uniform(0.0002, 0.02)))
        if (m := misread(w, rng)) and m not in known:
            add(m, w, seen, n, 1)
            beside(m, w, seen)
        i = int(rng.integers(len(w)))
        other = w[:i] + str(rng.choice(letters)) + w[i + int(rng.integers(2)) :]
        if other != w and other not in known and explained(other, w) == 99:
            add(other, w, seen, n, 0)
        v, k = frequent[int(rng.integers(len(frequent)))]
        if v != w:
            add(v, w, k, n, 0)
        m = misread_as_symbols((rng.random() < 0.3 and misread(w, rng)) or w, rng)
        if explained(m, w) == 99 and explained(m, w, symbols=True) < 99:
            add(m, w, seen, n, int(len(w) > 4))
            beside(m, w, seen)
        m = misread_as_symbols(w, rng, inside=False)
        if explained(m, w) == 99:
            add(m, w, seen, n, 0)
    if len(set(y)) < 2:
        read, printed, a, b, y = ["tlie", "thy"], ["the", "the"], [1, 1], [99, 99], [1, 0]
    return Boosted().fit(pair_features(read, printed, np.array(a, float), np.array(b, float)), np.array(y, float))


def candidates(rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, own, right, n_right): frequent words that a rare word may stand for, RATIO times as frequent, by the trigrams that both have,
    and those that known misreadings turn into it, however few trigrams they leave.

    A word meets another when one of its rarest trigrams is among the other's, too (prefix filter); a word with symbols may share fewer,
    and meets others by all of theirs.
    """
    shared = dict(frequent.select(F.explode(grams(F.col("word"))).alias("gram")).groupBy("gram").count().collect())  # bounded by the alphabet's trigrams

    def listed(found: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for w, n, own in zip(f["word"], f["n"], f["own"], strict=True):
                    size, legible, bits, some = rarest_grams(w, shared)
                    rows += [(w, n, own, size, legible, bits, g, size == legible) for g in some]
                    rows += [(w, n, own, size, legible, bits, g, False) for g in trigrams(w)] if found else []
                yield pd.DataFrame(rows, columns=["word", "n", "own", "size", "legible", "bits", "gram", "whole"])

        return each

    def undone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, own, p) for w, own in zip(f["word"], f["own"], strict=True) for p in printed_forms(w, shared)]
            yield pd.DataFrame(rows, columns=["word", "own", "right"])

    schema = "word string, n long, own long, size int, legible int, bits long, gram string, whole boolean"
    asked = rare.select("word", "n", "own").mapInPandas(listed(False), schema).drop("n")
    target = frequent.select("word", "n", "own").mapInPandas(listed(True), schema).drop("legible").withColumnsRenamed({x: f"{x}_right" for x in ("n", "own", "size", "bits")} | {"word": "right"})
    rarer = (F.col("n_right") >= F.col("own") * RATIO) & (F.col("own_right") > F.col("own")) & (F.col("word") != F.col("right"))
    least = least_shared(F.greatest("size", "size_right"), F.col("legible"))
    # A bit that one word alone has is a trigram that it has alone: what bits rule out need not be compared.
    most = lambda size, a, b: F.col(size) - F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))
    near = asked.join(target, ["gram", "whole"]).filter(rarer & (most("size", "bits", "bits_right") >= least) & (most("size_right", "bits_right", "bits") >= least))
    near = near.filter(F.size(F.array_intersect(grams(F.col("word")), grams(F.col("right")))) >= least)
    known = rare.select("word", "own").mapInPandas(undone, "word string, own long, right string")
    known = known.join(frequent.select(F.col("word").alias("right"), F.col("n").alias("n_right"), F.col("own").alias("own_right")), "right").filter(rarer)
    columns = ("word", "own", "right", "n_right")
    return near.select(*columns).unionByName(known.select(*columns)).distinct()


def corrections(words: DataFrame) -> DataFrame:
    """(word, right): misread words and the frequent words they stand for; right is null where no candidate is found for a word with
    symbols between its letters.

    A word is rare by its own count, so that copies of a page don't make its misreadings frequent; and what it stands for must be the
    more frequent by its own count, too.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    bar = max(FREQUENT_LEAST, int(total * FREQUENT_SHARE))
    frequent = words.filter((F.col("n") >= bar) & ~F.col("word").rlike(f"[{SYMBOLS}]"))
    top = frequent.orderBy(F.desc("n"), "word").limit(2000).collect()  # a bounded sample to fit the ranker on
    ranker = correction_ranker([(r["word"], r["n"]) for r in top])
    rare = words.filter(F.col("word").rlike(f"[{SYMBOLS}]") & (F.length(F.regexp_replace("word", f"[{SYMBOLS}]", "")) >= 2) | (F.col("own") * RATIO <= (top[0]["n"] if top else 0)))
    pairs = candidates(rare, frequent)

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = pair_features(list(f["word"]), list(f["right"]), f["own"].to_numpy(float), f["n_right"].to_numpy(float))
                s = ranker.predict(x)
                yield f[["word", "right", "n_right"]].assign(score=s)[s >= 0.5]

    best = pairs.mapInPandas(rank, "word string, right string, n_right long, score double").groupBy("word").agg(F.max_by("right", F.struct("score", "n_right", "right")).alias("right"))
    odd = words.filter(F.col("word").rlike(f"[{LETTERS}]{{2}}[{SYMBOLS}][{LETTERS}]|[{LETTERS}][{SYMBOLS}][{LETTERS}]{{2}}") & (F.col("own") < bar) & (F.length(F.regexp_replace("word", f"[^{SYMBOLS}]", "")) == 1) & (F.length("word") <= 20))
    return best.unionByName(odd.join(best, "word", "left_anti").select("word", F.lit(None).cast("string").alias("right")))


def join_features(head: list[str], tail: list[str], n_head: np.ndarray, n_tail: np.ndarray, n_whole: np.ndarray) -> np.ndarray:
    case = [t[0].islower() or (h + t).isupper() for h, t in zip(head, tail, strict=True)]
    digits = [h[-1].isdigit() and t[0].isdigit() for h, t in zip(head, tail, strict=True)]
    return np.column_stack([case, digits, [len(h) for h in head], [len(t) for t in tail], np.log1p(n_head), np.log1p(n_tail), np.log1p(n_whole)]).astype(float)


def join_classifier(frequent: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """Line-pair classifier: a word cut by a mark, against two words that a mark only joins (compounds, ranges, a dash at a line's end)."""
    rng, n = np.random.default_rng(seed), dict(frequent)
    head, tail, y = [], [], []
    for w, _ in frequent:
        if len(w) >= 4:
            i = int(rng.integers(2, len(w) - 1))
            upper = rng.random() < 0.1
            head.append(w[:i].upper() if upper else w[:i])
            tail.append(w[i:].upper() if upper else w[i:])
            y.append(1)
        v = frequent[int(rng.integers(len(frequent)))][0]
        head.append(w)
        tail.append(v.capitalize())
        y.append(0)
    if len(set(y)) < 2:
        head, tail, y = ["ex", "well"], ["ample", "Known"], [1, 0]
    count = lambda ws: np.array([n.get(w.lower(), 0) for w in ws], float)
    # Rare words and names are cut, too: half of the examples go without their counts.
    known = rng.random(len(y)) < 0.5
    whole = count([h + t for h, t in zip(head, tail, strict=True)])
    return Boosted(rounds=20).fit(join_features(head, tail, count(head), count(tail), np.where(known, whole, 0)), np.array(y, float))


def broken_words(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """(head, tail) of the words that are cut in two at a line end, of all that a mark may have cut (head, tail)."""
    top = words.filter(~F.col("word").rlike(f"[{SYMBOLS}]")).orderBy(F.desc("n"), "word").limit(1000).collect()
    model = join_classifier([(r["word"], r["n"]) for r in top])
    forms = cuts.select("head", "tail").distinct()
    n = lambda name, c: words.select(F.col("word").alias(name), F.col("n").alias(c))
    forms = forms.withColumns({"h": F.lower("head"), "t": F.lower("tail"), "w": F.lower(F.concat("head", "tail"))})
    forms = forms.join(n("h", "nh"), "h", "left").join(n("t", "nt"), "t", "left").join(n("w", "nw"), "w", "left").fillna(0, ["nh", "nt", "nw"])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                p = model.predict(join_features(list(f["head"]), list(f["tail"]), f["nh"].to_numpy(float), f["nt"].to_numpy(float), f["nw"].to_numpy(float)))
                yield f[["head", "tail"]][p >= 0.5]

    return forms.select("head", "tail", "nh", "nt", "nw").mapInPandas(judge, "head string, tail string")


# Digits read for letters, by the letters beside them; and what scanning confuses, in a form that both share.
_IN_LATIN, _IN_CYRILLIC = dict(zip("015896", "olsbgo", strict=True)), dict(zip("07364", "отзбч", strict=True))
_FORMS = (("@", "a"), ("$", "s"), ("!", "i"), ("е", "с"), ("и", "н"), ("п", "л"), ("т", "г"), ("é", "o"), ("ó", "o"), ("i", "l"), ("e", "c"), ("t", "f"), ("cl", "d"), ("rn", "m"), ("rl", "n"), ("ll", "u"), ("ll", "h"), ("vv", "w"), ("u", "h"))
_DIGITS = re.compile("[0-9]+")
_IS_LATIN, _IS_CYRILLIC = re.compile(f"[{LATIN}]"), re.compile(f"[{CYRILLIC}]")
_LOOSE = re.compile(r"(?:[^\S\n]|[#0-9]){2,}|[^\S\n ]|[#0-9]")


def _digits(m: re.Match) -> str:
    """A run of digits, those beside a letter as the letters they are read for."""
    x, run = m.string, list(m[0])
    for i, beside in ((0, x[m.start() - 1 : m.start()]), (-1, x[m.end() : m.end() + 1])):
        if beside and beside not in " \n" and run[i].isdigit():
            if _IS_LATIN.match(beside):
                run[i] = _IN_LATIN.get(run[i], run[i])
            elif _IS_CYRILLIC.match(beside):
                run[i] = "ы" if beside == "ь" and i == 0 and run[i] == "1" else _IN_CYRILLIC.get(run[i], run[i])
    return "".join(run)


def same_lines(lines: list[str]) -> list[str]:
    """Forms in which two edge lines agree when they differ in numbers, blanks and misreadings only. All lines at once, as one string:
    what is replaced never reaches across a line's end."""
    if not lines:
        return []
    x = "\n".join(lines).lower()
    for pair in _FORMS[:3]:
        x = x.replace(*pair)
    x = _DIGITS.sub(_digits, x).replace("ьы", "ы")
    for pair in _FORMS[3:]:
        x = x.replace(*pair)
    return [y.strip() for y in _LOOSE.sub(" ", x).split("\n")]


def same_line(line: str) -> str:
    """The form of one line."""
    return same_lines([line])[0]


_NUMBER = r"(\d{1,4}|[ivxlc]{1,8})"
_ALONE = re.compile(rf"(?i)[\s\-–—\[\](){{}}·.|*~_]*(?:(?:{'|'.join(map(re.escape, PAGE_WORDS))})\.?\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur|из)\s*\d{{1,4}})?\s*(?:(?:{'|'.join(map(re.escape, PAGE_WORDS))})\.?)?[\s\-–—\[\](){{}}·|*~_]*\.?")
_ROMAN = re.compile(r"c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
def lone_number(line: str) -> tuple[int | None, str | None]:
    """(number, kind) of a line that is a page number: bare, or with a word or marks around it; kind is `ended` with a full
    stop after it, which the end of a sentence may have, too."""
    m = _ALONE.fullmatch(line) if len(line) <= 60 and (len(line) <= 30 or _DIGITS.search(line)) else None
    n = number_of(m[1].lower()) if m else None
    return (n, "ended" if line.rstrip().endswith(".") else "alone") if n is not None else (None, None)


def number_of(raw: str) -> int | None:
    """The value of a number in digits, or in Roman ones up to 399; None for neither."""
    if raw.isdigit():
        return int(raw)
    if not raw or not _ROMAN.fullmatch(raw):
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in raw]
    return sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values))


def number_inside(line: str) -> int | None:
    """The number that a line begins or ends with, set off by a blank."""
    parts = line.split(None, 1), line.rsplit(None, 1)[::-1]
    return next((int(p[0]) for p in parts if len(p) == 2 and p[0].isdecimal() and len(p[0]) <= 4), None)


def outer_lines(text: str, most: int = 2) -> tuple[list[str], list[str]]:
    """The first and the last lines of a text that aren't blank, from the edge inwards."""

    def take(step: int) -> list[str]:
        out, at = [], 0 if step > 0 else len(text)
        while len(out) < most:
            if step > 0:
                end = text.find("\n", at)
                line, at = (text[at:], None) if end < 0 else (text[at:end], end + 1)
            else:
                start = text.rfind("\n", 0, at)
                line, at = (text[:at], None) if start < 0 else (text[start + 1 : at], start)
            if line and not line.isspace():
                out.append(line)
            if at is None:
                break
        return out

    return take(1), take(-1)


def edges_of(text: str) -> list[tuple[str, int | None, str | None]]:
    """(line, number, kind) of the lines at the top and foot of a page; where a page number stands alone there, the line beside it, too.
    Kind `within` is that of a number at either end of a line that isn't a number alone; null for lines without one."""
    out = []
    for lines in outer_lines(text):
        if not lines:
            continue
        n, kind = lone_number(lines[0])
        if n is not None:
            out.append((lines[0], n, kind))
            lines = lines[1:]
            if not lines or lone_number(lines[0])[0] is not None:
                continue
        x = lines[0]
        if len(x) > LINE:
            continue
        n = number_inside(x)
        out.append((x, n, None if n is None else "within"))
    return list(dict.fromkeys(out))


def marks_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every page, what its lines show, in one reading: edges (key, asset, ordinal, line, num, kind, form) by edges_of(), lines that
    aren't a number alone with their form; and cuts (key, head, tail), the ends and starts of lines between which a mark may cut a word."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                rows, cuts = [], []
                for k, a, o, t in zip(*(c.to_pylist() for c in whole.slice(at, 5000).columns), strict=True):
                    rows += [(k, a, o, *e) for e in edges_of(t)]
                    if "\n" in t:
                        cuts += [(k, None, None, head, None, "cut", None, tail) for _, _, head, tail in cut_places(t)]
                forms = iter(same_lines([r[3] for r in rows if r[5] not in ("alone", "ended")]))
                # Lines are told apart by the hash of their form; those without a letter are no heads.
                rows = [(*r, f if f is None else xxhash.xxh3_64_intdigest(f) - (1 << 63), None) for r in rows for f in (None if r[5] in ("alone", "ended") else next(forms),) if f is None or _ANY_LETTER.search(f)] + cuts
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "asset", "ordinal", "line", "num", "kind", "form", "tail"])

    marks = pages.select("key", "asset", "ordinal", "text").mapInArrow(take, "key string, asset string, ordinal int, line string, num int, kind string, form long, tail string")
    marks = cut_lineage(marks)
    return marks.filter(~F.col("kind").eqNullSafe("cut")).drop("tail"), marks.filter(F.col("kind") == "cut").select("key", F.col("line").alias("head"), "tail")


def furniture(edges: DataFrame, pages_least: int = 3) -> DataFrame:
    """(key, line, defect): running heads and page numbers; the same line for both where the number stands within the head.

    A head is a line at the top or foot that stands, but for numbers and misreadings, on at least `pages_least` pages of its file. A number
    within a head, or followed by a full stop, counts when its distance from the page's place in the file is that of another page's number.
    Counts are by (file, line) and (file, distance): no file's pages are brought together.
    """
    heads = edges.filter("form IS NOT NULL").groupBy("asset", "form").agg(F.count_distinct("ordinal").alias("pages")).filter(F.col("pages") >= pages_least).select("asset", "form")
    head_lines = edges.join(heads, ["asset", "form"], "left_semi")
    columns = ("key", "asset", "ordinal", "line", "num", "kind")
    numbers = edges.filter("form IS NULL").select(*columns).unionByName(head_lines.filter("num IS NOT NULL").select(*columns)).withColumn("distance", F.col("num") - F.col("ordinal"))
    steady = numbers.groupBy("asset", "distance").agg(F.count_distinct("ordinal").alias("pages")).filter(F.col("pages") >= 2).select("asset", "distance", F.lit(True).alias("steady"))
    numbers = numbers.join(steady, ["asset", "distance"], "left").filter(F.col("steady") | (F.col("kind") == "alone"))
    return head_lines.select("key", "line", F.lit("running_head").alias("defect")).unionByName(numbers.select("key", "line", F.lit("page_number").alias("defect"))).distinct()


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its checked size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sent_fixes(fixes: DataFrame) -> dict[str, str | None] | None:
    """word -> right, where the checked size allows to send it to every task; otherwise None."""
    return {r["word"]: r["right"] for r in fixes.collect()} if fixes.count() <= BROADCAST_ROWS else None


def holder(words: Container[str]) -> Callable[[str], bool]:
    """Tells texts that hold one of the words; each token is looked into once."""
    clean, wrong = set(), set()

    def holds(text: str) -> bool:
        tokens = set(tokens_of(text))
        for x in tokens - clean:
            if x not in wrong:
                (wrong if any(w in words for w in words_in(x)) else clean).add(x)
        if len(clean) > KEPT:
            clean.clear()
        return not wrong.isdisjoint(tokens)

    return holds


def misread_pages(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """(key) of the pages that hold one of the words; by a set of them in every task, beyond its bound by a join on the words."""
    known = sent_fixes(fixes)
    if known is None:
        return words_by_page(pages).join(fixes, "word", "left_semi").select("key")
    sent = pages.sparkSession.sparkContext.broadcast(set(known))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = holder(sent.value)
        for batch in batches:
            out = [i for i, t in enumerate(batch.column(1).to_pylist()) if holds(t)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64()))], names=["key"])

    return pages.select("key", "text").mapInArrow(find, "key string")


def words_by_page(pages: DataFrame) -> DataFrame:
    """(key, word): every word of a page once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, w) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in {w for x in set(tokens_of(t)) for w in words_in(x)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["key", "word"])

    return pages.select("key", "text").mapInArrow(each, "key string, word string")


def scan_defects(units: DataFrame, key: str, asset: str, ordinal: str, text: str) -> DataFrame:
    """(key, defect): broken_word, misread, running_head, page_number. Null and blank texts have none; redelivered rows count once."""
    pages = pages_of(units, key, asset, ordinal, text)
    words = cut_lineage(vocabulary(pages))
    edges, cuts = marks_of(pages)
    wrong = misread_pages(pages, cut_lineage(corrections(words))).select("key", F.lit("misread").alias("defect"))
    broken = cuts.join(small(cut_lineage(broken_words(cuts, words))), ["head", "tail"], "left_semi").select("key", F.lit("broken_word").alias("defect"))
    return wrong.unionByName(broken).unionByName(furniture(edges).select("key", "defect")).distinct()


def repair(units: DataFrame, key: str, asset: str, ordinal: str, text: str) -> DataFrame:
    """(key, repaired): every page without its furniture, cut words put together, misread words replaced, and lines joined to paragraphs.

    Paragraphs are parted by blank lines. Null texts give null. Rows that are equal in all columns used count once.
    """
    pages = pages_of(units, key, asset, ordinal, text)
    words = cut_lineage(vocabulary(pages))
    edges, cuts = marks_of(pages)
    fixes = cut_lineage(corrections(words).filter(F.col("right").isNotNull()))
    cut = small(cut_lineage(broken_words(cuts, words)))
    joins = cuts.join(cut, ["head", "tail"], "left_semi").select("key", F.concat_ws("\n", "head", "tail").alias("cut"), F.lit(None).cast("string").alias("line"))
    drops = furniture(edges).select("key", F.lit(None).cast("string").alias("cut"), "line")
    changes = joins.unionByName(drops).groupBy("key").agg(F.collect_set("cut").alias("cuts"), F.collect_set("line").alias("drops"))
    rows = pages.dropDuplicates(["key"]).join(changes, "key", "left")
    known = sent_fixes(fixes)
    if known is None:
        per_page = words_by_page(pages).join(fixes, "word").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("fixes"))
        rows = rows.join(per_page, "key", "left")
    else:
        rows = rows.withColumn("fixes", F.lit(None).cast("map<string,string>"))
    sent = units.sparkSession.sparkContext.broadcast(known)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = holder(sent.value or {})
        for batch in batches:
            fixed = [(sent.value if holds(t) else None) if sent.value is not None else dict(f or ()) for f, t in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            out = [mend_page(t, f, c, d) for t, f, c, d in zip(batch.column(1).to_pylist(), fixed, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "repaired"])

    done = rows.select("key", "text", "cuts", "drops", "fixes").mapInArrow(mend, "key string, repaired string")
    missing = units.filter(F.col(f"`{text}`").isNull()).select(F.col(f"`{key}`").cast("string").alias("key"), F.lit(None).cast("string").alias("repaired")).distinct()
    return done.unionByName(missing)


def mend_page(text: str, fixes: dict | None, cuts, drops) -> str:
    gone, cut = set(drops) if drops is not None else set(), set(cuts) if cuts is not None else set()
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    edge = {*solid[:2], *solid[-2:]}
    lines = [x for i, x in enumerate(lines) if not (i in edge and x in gone)]
    body = "\n".join(lines)
    if cut:
        body = joined_cuts(body, cut)
    paragraphs = [" ".join(x.strip() for x in p.split("\n") if x.strip()) for p in re.split(r"\n\s*\n", body)]
    body = "\n\n".join(p for p in paragraphs if p)
    if fixes:
        def fix(m: re.Match) -> str:
            right = fixes.get(m[0].lower().rstrip("!"))
            if not right:
                return m[0]
            tail = "!" * (len(m[0]) - len(m[0].rstrip("!"))) if not m[0].lower() in fixes else ""
            return (right.upper() if sum(c.isupper() for c in m[0]) > 1 else right.capitalize() if m[0][0].isupper() else right) + tail

        body = re.sub(rf"[{LETTERS}{SYMBOLS}]+", fix, body)
    return body
