"""Canonical forms, splitting, tokenizer ids, packing and languages: small cases, nulls, ties and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import canonical as C
from tessera.llm import encode as E
from tessera.llm import language as L
from tessera.llm import pack as P
from tessera.llm import split as S


@pytest.mark.parametrize(
    "value, want",
    [("\u09c7\u09be", "\u09cb"), ("\u0bc6\u0bbe", "\u0bca"), ("\u1025\u102e", "\u1026"), ("\u0dd9\u0dcf", "\u0ddc"), ("Ｆｉｎｔοn", "Finton"), ("ﬁx", "fix"), ("áb", "áb"), ("ｶﾞﾊﾟ", "ガパ"), ("⻅⼈", "见人"), ("x‍y­z", "xyz"), ("B c　d", "B c d"), ("Роlѕkа", "Polska"), ("cмoтpи", "смотри"), ("각", "각"), ("", ""), (None, None)],
)
def test_canonical(value, want):
    assert C.canonical(value) == want
    assert C.canonical(C.canonical(value)) == C.canonical(value)


@pytest.mark.parametrize("value", ["👩‍💻 ok", "½ № ² ° º", "Σ αβ Привет", "！（，）？", "tab\tline\n", "café à ï"])
def test_canonical_leaves(value):
    assert C.canonical(value) == value


def test_changed_values(spark):
    df = spark.createDataFrame([("1", "ﬁ", None), ("1", "ﬁ", None), ("2", None, "ok"), (None, "ａ", "")], "id string, value string, field string")
    got = sorted(map(tuple, C.changed_values(df, "id", ["value", "field"]).collect()), key=str)
    assert got == [("1", "value", "ﬁ", "fi"), (None, "value", "ａ", "a")]
    assert C.changed_values(df.limit(0), "id", ["value"]).collect() == []
    assert {r["value"] for r in C.canonicalize(df, ["value"]).collect()} == {"fi", None, "a"}


def test_split_levels():
    para, sent = "word " * 100, "Short one. " * 50
    assert S.coarsest_cut("x", 400) is None and S.coarsest_cut(" " * 900, 400) is None
    assert S.coarsest_cut("\n\n".join(["a" * 300] * 3), 400) == "paragraph"
    assert S.coarsest_cut(sent, 400) == "sentence" and S.coarsest_cut("。".join(["字" * 50] * 12), 400) == "sentence"
    assert S.coarsest_cut(para, 400) == "word" and S.coarsest_cut("a" * 900, 400) == "hard"


def test_split_pieces():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "end. ", "\n\n", "x" * rng.randint(1, 90) + " ", "句子。"]) for _ in range(rng.randint(1, 200))).strip()
        limit, overlap = rng.choice([(120, 0), (120, 30), (300, 50)])
        pieces = S.split_text(text, limit, overlap)
        assert all(len(text[a:b].rstrip()) <= limit for a, b, _ in pieces)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == "end"
        for (_, e, _), (s, _, _) in zip(pieces, pieces[1:]):
            assert s == max(e - overlap, 0)
    with pytest.raises(ValueError):
        S.split_text("abc", 2, 2)


def test_best_cuts_is_optimal():
    """Against all choices of cuts of a short text."""
    from itertools import combinations

    text = "aa bb. cc dd\n\nee ff. gg hh ii"
    points = S.cut_points(text, "word")
    limit, n = 14, len(text)

    def cost(ends):
        even, total, start = n / max(1, -(-n // limit)), 0.0, 0
        for e in ends:
            size = len(text[:e].rstrip()) - start
            if size > limit:
                return None
            total += ((size - even) / even) ** 2 + (S.PENALTY[points[e]] if e in points else 0)
            start = e
        return total

    every = [(*c, n) for k in range(len(points) + 1) for c in combinations(sorted(points), k)]
    best = min(c for e in every if (c := cost(e)) is not None)
    assert cost(S.best_cuts(text, points, limit)) == pytest.approx(best)


def test_split_frame(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "  ", 3), ("d", "xy", 4), ("d", "xy", 4), ("e", "z" * 30, 5)], "id string, text string, piece int")
    got = S.split(df, "id", "text", 12, 2).collect()
    assert {r["id"] for r in got} == {"d", "e"} and sum(r["id"] == "d" for r in got) == 1
    assert max(len(r["piece"]) for r in got) <= 12
    assert [tuple(r) for r in S.oversized(df, "id", "text", 12).collect()] == [("e", "hard")]


def test_ids_against_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["", None, "Hello  world!\n\n don't", "<|endoftext|> x", "漢字かなカナ한국어 Привет", "a" * 300, "12345 67", " \t\n", "🙂👩‍💻", "é́ ﬁ", "\u0000\u0007"]
    rng = random.Random(1)
    texts += ["".join(chr(rng.choice([*range(32, 127), *range(0xC0, 0x250), *range(0x4E00, 0x4E80), *range(0x3041, 0x30FF), *range(0x410, 0x450)])) for _ in range(200)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in E.encode(df, "doc_id", "text").collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), repr(x)
    assert t.decode(got[4]) == texts[4]
    assert E.encode(df.limit(0), "doc_id", "text").collect() == []


def exact_bins(sizes, capacity):
    """Least number of containers, by search."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(11)
    for _ in range(150):
        capacity = rng.randint(6, 30)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        count = np.bincount(sizes, minlength=capacity + 1)
        fixed = P.reduce_dominated(count, capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        rest = [s for s in range(capacity, 0, -1) for _ in range(count[s])]
        assert sum(n for _, n in fixed) + (exact_bins(rest, capacity) if rest else 0) == exact_bins(sizes, capacity), (sizes, capacity)


def test_plan_places_every_item_once():
    rng = random.Random(4)
    for _ in range(100):
        capacity = rng.randint(5, 60)
        histogram = {s: rng.randint(1, 50) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(12, capacity)))}
        runs, n = P.plan(histogram, capacity)
        filled, placed = {}, {}
        for r in runs:
            for i in range(r.n):
                c = r.container + i // r.per
                filled[c] = filled.get(c, 0) + r.size
                assert placed.setdefault((r.size, r.first + i), c) == c
        assert len(placed) == sum(histogram.values()) and max(filled.values()) <= capacity and set(filled) == set(range(n))


def test_reduction_of_three():
    count = np.zeros(11, np.int64)
    count[[4, 3]] = 2, 4
    assert [(sorted(s), n) for s, n in P.reduce_dominated(count, 10)] == [([3, 3, 4], 2)] and not count.any()
    rng = random.Random(8)
    seen = 0
    for _ in range(150):
        capacity = rng.randint(10, 30)
        sizes = sorted((rng.randint(capacity // 5 + 1, capacity // 2) for _ in range(rng.randint(3, 9))), reverse=True)
        count = np.bincount(sizes, minlength=capacity + 1)
        fixed = P.reduce_dominated(count, capacity)
        seen += any(len(s) == 3 for s, _ in fixed)
        rest = [s for s in range(capacity, 0, -1) for _ in range(count[s])]
        assert all(sum(s) <= capacity for s, _ in fixed)
        assert sum(n for _, n in fixed) + (exact_bins(rest, capacity) if rest else 0) == exact_bins(sizes, capacity), (sizes, capacity)
    assert seen


def test_pack_frame(spark):
    rows = [(i, s) for i, s in enumerate([None, 0, 25, 10, 10, 10, 7, 3, 3, 3, 3, 3, 1])]
    df = spark.createDataFrame([*rows, (99, 10), (99, 10), (None, 4)], "doc_id long, size int").withColumn("container", F.lit("clash"))
    got = P.pack(df.select("doc_id", "size"), "doc_id", "size", 10).collect()
    by = {}
    for r in got:
        assert (r["container"] is None) == (r["size"] == 0)
        if r["container"] is not None:
            by[r["container"]] = by.get(r["container"], 0) + r["size"]
    assert max(by.values()) <= 10 and sum(by.values()) == sum(s or 0 for _, s in rows) + 24
    assert sorted((r["piece_no"], r["start"], r["size"]) for r in got if r["doc_id"] == 2) == [(1, 0, 10), (2, 10, 10), (3, 20, 5)]
    assert P.pack(df.select("doc_id", "size").limit(0), "doc_id", "size", 10).collect() == []


@pytest.fixture(scope="module")
def samples(spark, sf_dir):
    return L.dictionaries(spark.read.parquet(f"{sf_dir}/lang_samples.parquet"))


def test_languages(samples):
    c = L.Classifier(samples)
    texts = [
        "The survey and the figure were slow as agreed, so nothing covers the member.", "Warum verbessern die Gruppen keine Muster? Laut Skapol prüfen die Flure alle Listen.", "Le tableau suit la liste. Selon Vinpol, le projet montre la figure.",
        "为什么芮琅的小组要改进表格？", "なぜマネの記録は質問を残すのですか。", "왜 하솔의 제안은 목록을 먼저 볼까?", "Почему проекты не поддерживают группы?", "", None, "  \n", "42 / 82.3",
        "The survey covers the limit on both sides. Pourquoi le dossier modifie-t-on avec la demande ? Ni le plan ni le bureau ne sont prêts.",
    ]
    langs = [[s[2] for s in x] for x in c.segments(texts)]
    assert [x[0] if x else None for x in langs[:7]] == ["en", "de", "fr", "zh", "ja", "ko", "ru"]
    assert langs[7] == langs[8] == langs[9] == [] and langs[10] == [None] and langs[11] == ["en", "fr"]
    for t, found in zip(texts, c.segments(texts)):
        if found:
            assert found[0][0] == 0 and found[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(found, found[1:]))


def test_held_out_accuracy(spark, sf_dir):
    """Dictionaries of half of the samples tell the other half."""
    rows = spark.read.parquet(f"{sf_dir}/lang_samples.parquet").collect()
    half = L.Classifier({x: "\n".join(r["text"] for r in rows if r["lang"] == x and r["sample_id"] % 2) for x in L.LANGUAGES})
    test = [r for r in rows if r["sample_id"] % 2 == 0]
    got = [{s[2] for s in x} for x in half.segments([r["text"] for r in test])]
    assert sum(g == {r["lang"]} for g, r in zip(got, test)) / len(test) >= 0.97


def test_labels(spark, samples):
    df = spark.createDataFrame([(x,) for x in ("EN", "zh_Hans", "jp", "kor", "pt", "und", "", None, " de-AT ", "??")], "l string")
    assert [r[0] for r in df.select(L.label_language(F.col("l"))).collect()] == ["en", "zh", "ja", "ko", None, None, None, None, "de", None]
    units = spark.createDataFrame([("u", "Почему проекты не поддерживают группы?"), ("u", "Почему проекты не поддерживают группы?"), ("v", None)], "id string, text string")
    en = "Which survey covers the limit, and why is it slow?"
    tr = spark.createDataFrame([(1, "u", "en", "ru", en), (2, "u", "zh", "de", en), (3, "v", None, None, None), (4, "w", "", "en", en), (4, "w", "", "en", en)], "tr_id long, unit_id string, lang string, source_lang string, text string")
    assert set(map(tuple, L.wrong_labels(L.judged(tr, units, samples)).collect())) == {(2, "lang", "en"), (2, "source_lang", "ru"), (4, "lang", "en")}


def test_plan_places_many_equal_items_in_few_runs():
    runs, containers = P.plan({1100: 50_000, 900: 50_000}, 2048)
    assert len(runs) < 100 and containers == 50_000 and sum(r.n for r in runs) == 100_000
    few, _ = P.plan({s: 20 + s % 7 for s in range(1, 2049)}, 2048)
    many, _ = P.plan({s: 1000 * (20 + s % 7) for s in range(1, 2049)}, 2048)
    assert len(many) < 3 * len(few)  # the runs follow the sizes, not the items


def test_languages_are_those_of_the_samples(spark):
    """A language outside any table is tried where the samples hold it."""
    greek = ["Η συνεδρίαση αρχίζει το πρωί και τελειώνει αργά.", "Το αρχείο περιέχει όλα τα έγγραφα της εβδομάδας.", "Η ομάδα ελέγχει κάθε πίνακα πριν από το τέλος."] * 5
    english = ["The meeting begins in the morning and ends late.", "The archive holds all papers of the week.", "The team checks every table before the end."] * 5
    c = L.Classifier({"en": "\n".join(english), "el": "\n".join(greek)})
    found = c.segments(["Η ομάδα ελέγχει το αρχείο της εβδομάδας. The team checks the papers of the archive."])[0]
    assert [s[2] for s in found] == ["el", "en"]


def test_long_stretches():
    """Ids of stretches far longer than a window are those of the library, in a time that grows with the length only."""
    import time

    rng = random.Random(4)
    e, library = E.Encoder(), P._tiktoken(E.TOKENIZERS, "byte_bpe_50k")
    letters = "abcdefghijklmnopqrstuvwxyz"
    for text in ("".join(rng.choice(letters) for _ in range(100_000)), "=" * 100_000, "".join(rng.choice(["intern", "ational", "ization", "the", "ing"]) for _ in range(4000)), "你好世界漢字" * 500):
        start = time.time()
        assert e.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert time.time() - start < 10
    for _ in range(60):
        text = "".join(rng.choice(letters[: rng.randint(2, 26)]) for _ in range(rng.randint(60, 400)))
        assert e.encode([text])[0].tolist() == library.encode_ordinary(text)
