"""Problem 10: the subject areas of documents, by averaged word and subword embeddings with independent logistic outputs.

The vector of a word is the mean of the embeddings of the word and its character n-grams, that of a sentence the mean of its words;
each subject has a logistic output of its own. Training sentences carry their document's labels. At every step each partition works out
the gradient of its own sentences; the sum of all is the step of the one model. A document is about a subject when at least a given share
of its sentences are.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.language import sentences
from tessera.session import cut_lineage, spread

BUCKETS, WIDTH = 1 << 16, 12
#: Documents to fit on, at most, and how many of them a word must occur in; partitions that share the work, steps, and from which of them
#: on sentences have targets of their own.
SAMPLE, LEAST_DOCUMENTS, SHARDS, STEPS, REFINE = 5000, 2, 4, 30, 8
#: Share of a document's sentences that makes it about a subject, and the probability from which a sentence is.
SHARE, SURE = 0.25, 0.4
#: Probability from which a training sentence shows a subject.
SHOWN = 0.4
_URL = re.compile(r"\S+://\S+|\S+@\S+")
_RUN = re.compile(r"[㐀-鿿]+|[ァ-ヺー]+|[^\W\d_぀-ヿ㐀-鿿]+")


def tokens(sentence: str) -> list[str]:
    """Words in lower case; of Han runs, their pairs of adjacent characters; katakana runs; hiragana, digits and links are left out."""
    out = []
    plain = sentence.lower()
    if "@" in plain or "://" in plain:
        plain = _URL.sub(" ", plain)
    for w in _RUN.findall(plain):
        if "㐀" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


def features(word: str) -> list[int]:
    """Buckets of the word and of its n-grams of 3 to 5 characters, with marks for its ends."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    if not "㐀" <= word[0] <= "鿿":
        w = f"<{word}>"
        out += [zlib.crc32(w[i : i + n].encode(), n) % BUCKETS for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def counted_sentences(text: str | None) -> list[list[str]]:
    """The tokens of the sentences that count: those with at least three."""
    if not text or text.isspace():
        return []
    return [t for a, b in sentences(text) if len(t := tokens(text[a:b])) >= 3]


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x WIDTH
    output: np.ndarray  # WIDTH x subjects
    bias: np.ndarray


def fresh(subjects: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    return Model(np.zeros((BUCKETS + 1, WIDTH), np.float32), rng.normal(0, 1, (WIDTH, subjects)).astype(np.float32), np.full(subjects, -2.0, np.float32))


class Shard:
    """Sentences of one partition, ready for gradients. Words outside the vocabulary count in a sentence's length, but have no vector.

    A sentence's logits are the mean of its words' logits, so sentences are summed by subject instead of by dimension, and back.
    """

    def __init__(self, docs: list[list[list[str]]], labels: np.ndarray, vocabulary: set[str]):
        at: dict[str, int] = {w: i for i, w in enumerate(sorted({w for d in docs for s in d for w in s if w in vocabulary}), 1)}
        sents = [s for d in docs for s in d]
        self.n = np.array([len(s) for s in sents], np.int64)
        words = np.array([at.get(w, 0) for s in sents for w in s], np.int64)
        self.words, self.sent = words[words > 0], np.repeat(np.arange(len(sents)), self.n)[words > 0]
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.y = labels[self.doc].astype(np.float32) if len(sents) else np.zeros((0, labels.shape[1]), np.float32)
        f = [features(w) for w in at]
        self.fn = np.array([len(x) for x in f], np.int64)
        self.word = np.repeat(np.arange(len(f)), self.fn)
        self.used, self.local = np.unique(np.array([b for x in f for b in x], np.int64), return_inverse=True)
        self.words -= 1

    @staticmethod
    def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, rows[:, k], size) for k in range(rows.shape[1])], 1)

    def forward(self, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the words, and each sentence's probability of every subject; e holds the rows of `used`."""
        word = self._sums(self.word, e[self.local], len(self.fn)) / self.fn[:, None]
        logits = self._sums(self.sent, (word @ w)[self.words], len(self.n)) / self.n[:, None] + b
        return word, 1 / (1 + np.exp(-logits))

    def targets(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each sentence should say, and what counts, once the model knows something: of a document's subjects those the sentence
        shows, but always those of the quarter of its sentences that show them most; a subject shown against the labels does not count."""
        y = self.y * (p >= SHOWN)
        n = np.bincount(self.doc, minlength=int(self.doc.max()) + 1)
        first = np.cumsum(n) - n
        for k in np.flatnonzero(self.y.any(axis=0)):
            rows = np.flatnonzero(self.y[:, k])
            order = rows[np.lexsort((-p[rows, k], self.doc[rows]))]
            starts = np.flatnonzero(np.r_[True, self.doc[order][1:] != self.doc[order][:-1]])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            y[order[rank < np.ceil(SHARE * n[self.doc[order]])], k] = 1
        return y, 1.0 - (1 - self.y) * (p >= SHOWN)

    def gradient(self, e: np.ndarray, w: np.ndarray, b: np.ndarray, step: int) -> list[np.ndarray]:
        """Sums over the sentences of the loss's gradient by e, w and b."""
        word, p = self.forward(e, w, b)
        y, counts = self.targets(p) if step >= REFINE else (self.y, 1.0)
        g = (p - y) * counts
        by_word = self._sums(self.words, (g / self.n[:, None])[self.sent], len(self.fn))
        return [self._sums(self.local, ((by_word @ w.T) / self.fn[:, None])[self.word], len(self.used)), word.T @ by_word, g.sum(axis=0)]


def descend(used: list[np.ndarray], sentences: int, subjects: int, gradients: Callable[[Model, int], list[list[np.ndarray]]], steps: int = STEPS, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """The model after `steps` steps of Adam on the sum of the shards' gradients, in the order of the shards; used are the features of each."""
    m, rows = fresh(subjects), np.unique(np.concatenate([*used, np.array([], np.int64)]))
    places = [np.searchsorted(rows, x) for x in used]
    params = [np.zeros((len(rows), WIDTH)), m.output.astype(np.float64), m.bias.astype(np.float64)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(steps):
        sums = [np.zeros_like(x) for x in params]
        for place, (ge, gw, gb) in zip(places, gradients(m, t), strict=True):
            sums[0][place] += ge
            sums[1] += gw
            sums[2] += gb
        now = rate * (1 - 0.9 * t / steps)
        for i, g in enumerate(sums):
            g /= max(sentences, 1)
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            params[i] -= now * (first[i] / (1 - 0.9 ** (t + 1))) / (np.sqrt(second[i] / (1 - 0.99 ** (t + 1))) + 1e-8) + now * decay * params[i] * (i < 2)
        m.embedding[rows], m.output, m.bias = params[0], params[1].astype(np.float32), params[2].astype(np.float32)
    return m


def labelled(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, none: str) -> DataFrame:
    """(key, text, labels) of the labelled documents: a subject stays when at least half of the document's annotators name it."""
    said = labels.select(key, label, "annotator").distinct()
    judges = said.groupBy(key).agg(F.count_distinct("annotator").alias("judges"))
    votes = said.filter(F.col(label) != none).groupBy(key, label).agg(F.count_distinct("annotator").alias("votes"))
    kept = votes.join(judges, key).filter(F.col("votes") * 2 >= F.col("judges")).groupBy(key).agg(F.sort_array(F.collect_set(label)).alias("labels"))
    named = judges.select(key).join(kept, key, "left").select(key, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    return documents.select(key, text).join(named, key).filter(F.col(text).isNotNull())


def train(examples: DataFrame, key: str, text: str, subjects: list[str], sample: int = SAMPLE) -> Model:
    """The model fitted on about `sample` labelled documents (key, text, labels) at most, those of least hash of their key; on all where
    there are fewer, and in the same way."""
    spark, at = examples.sparkSession, {x: i for i, x in enumerate(subjects)}
    n = examples.count()
    # Chosen by their hash where they lie: none is sorted, or sent to one place.
    some = examples.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30))))
    rows = cut_lineage(some.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), "labels").repartitionById(SHARDS, F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(w for b in batches for t in b.column(1).to_pylist() for w in {w for s in counted_sentences(t) for w in s})
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

    common = rows.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS).select("word").collect()  # bounded by the sample
    vocabulary = spark.sparkContext.broadcast({r["word"] for r in common})

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        y = np.zeros((len(held), len(at)), np.float32)
        for i, (_, _, labels) in enumerate(held):
            y[i, [at[x] for x in labels if x in at]] = 1
        shard = Shard([counted_sentences(t) for _, t, _ in held], y, vocabulary.value)
        if len(shard.n):
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([pickle.dumps(shard)], pa.binary()), pa.array([shard.used.tobytes()], pa.binary()), pa.array([len(shard.n)], pa.int64())], names=["first", "shard", "used", "n"])

    shards = cut_lineage(rows.mapInArrow(prepare, "first string, shard binary, used binary, n long"))
    known = sorted(shards.select("first", "used", "n").collect())  # a row per shard

    def gradients(model: Model, step: int) -> list[list[np.ndarray]]:
        sent = spark.sparkContext.broadcast((model.embedding, model.output, model.bias))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e, w, b = sent.value
            for batch in batches:
                for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    shard: Shard = pickle.loads(blob)
                    g = pickle.dumps([x.astype(np.float32) for x in shard.gradient(e[shard.used], w, b, step)])
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([g], pa.binary())], names=["first", "g"])

        out = sorted(shards.select("first", "shard").mapInArrow(work, "first string, g binary").collect())  # a row per shard, of the size of the model
        sent.unpersist()
        return [pickle.loads(r["g"]) for r in out]

    return descend([np.frombuffer(r["used"], np.int64) for r in known], sum(r["n"] for r in known), len(subjects), gradients)


class Scorer:
    """Shares of a document's sentences by subject; what each word adds is kept, up to a bound."""

    def __init__(self, model: Model):
        self.table, self.bias = model.embedding @ model.output, model.bias
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.bias)), np.float32)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        docs = [counted_sentences(t) for t in texts]
        if len(self.known) > 500_000:
            self.known.clear()
        new = {w for d in docs for s in d for w in s if w not in self.known}
        if new:
            f = [features(w) for w in new]
            n = np.array([len(x) for x in f])
            add = np.add.reduceat(self.table[[b for x in f for b in x]], np.cumsum(n) - n, axis=0) / n[:, None]
            start = len(self.known)
            while len(self.rows) < start + len(add):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[start : start + len(add)] = add
            self.known.update(zip(new, range(start, start + len(add)), strict=True))
        sents = [s for d in docs for s in d]
        out = np.zeros((len(texts), len(self.bias)))
        if not sents:
            return out
        n = np.array([len(s) for s in sents])
        ids = np.fromiter((self.known[w] for s in sents for w in s), np.int64, int(n.sum()))
        logits = np.add.reduceat(self.rows[ids], np.cumsum(n) - n, axis=0) / n[:, None] + self.bias
        p = 1 / (1 + np.exp(-logits))
        about = p >= SURE
        doc = np.repeat(np.arange(len(texts)), [len(d) for d in docs])
        np.add.at(out, doc, about)
        return out / np.maximum(np.array([len(d) for d in docs]), 1)[:, None]


def subjects_of(documents: DataFrame, key: str, text: str, model: Model, subjects: list[str], share: float = SHARE) -> DataFrame:
    """(key, subject, share) for every subject that at least `share` of a document's sentences are about; none for null and blank texts."""
    sent = documents.sparkSession.sparkContext.broadcast((model.embedding, model.output, model.bias))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                s = scorer.shares(batch.column(1).to_pylist())
                i, j = np.nonzero(s >= share)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array([subjects[x] for x in j], pa.string()), pa.array(s[i, j])], names=[key, "subject", "share"])

    return spread(documents.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).mapInArrow(score, f"`{key}` {dict(documents.dtypes)[key]}, subject string, share double")
