"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of itself and its character n-grams (of 3 to 6, with marks at
its ends), in training each hashed to a row of an embedding table.  The mean of these rows
is the word's vector, the mean over a window of words is the window's, and a
linear softmax of two classes reads it.  Table and softmax are trained jointly
in numpy with Adagrad.  As a few words make a long text toxic, a text is read
as overlapping windows that cover all of it and has the score of its most
toxic one, in training as in scoring.  As one toxic word would then hide the
others, training also takes a window of each toxic text around a word that
toxic texts have and others don't (``telling``).  Misspellings that training never saw
share n-grams, and so vectors, with words that it did see.

The model is fitted by one task, which a lost executor's successor does again
alike, on at most ``MAX_ROWS`` labelled rows of each class, those whose hashed
doc_id is smallest, of texts up to ``MAX_BYTES`` bytes; these bounds are
parameters.  Only rows whose crc32(doc_id as text) mod
3 is not 1 are used; the text is the only input of a score.  What goes to the
executors is one number for each n-gram that enough training documents have
(the softmax applied to its row; LEAST_SHARE), so scoring is map-only.

Rows: null texts count as empty; a text without words has the score of the
bias; repeated rows each give a row; documents whose labels contradict each
other are not used; unless both classes have a usable label every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 3000
MAX_BYTES = 20_000
THRESHOLD = 0.7
BUCKETS = 1 << 20
DIM = 4
WINDOW = 3
EPOCHS = 45
RATE = 0.8
# the weight that the toxic class has of both
TOXIC_SHARE = 0.6
DECAY = 1e-6
# an n-gram counts if one training document in so many toxic ones has it, and two at least
LEAST_SHARE = 300
# words whose n-grams are summed at a time in training
PART = 20_000
LENGTHS = (3, 4, 5, 6)
CACHE = 400_000


find_words = re.compile(r"\w+").findall


def grams_of(word: str) -> set[str]:
    """The word itself and its n-grams, with marks at its ends."""
    marked = f"<{word}>"
    out = {marked}
    for n in LENGTHS:
        out.update([marked[i : i + n] for i in range(len(marked) - n + 1)])
    return out


def row_of(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS


def words_of(text: str | None) -> list[str]:
    return find_words((text or "").lower())


def window_starts(n: int) -> np.ndarray:
    """Starts of windows of WINDOW words, half a window apart, the last one flush with the end."""
    return np.append(np.arange(0, max(0, n - WINDOW), max(1, WINDOW // 2)), max(0, n - WINDOW))


def window_means(scores: np.ndarray) -> np.ndarray:
    n = len(scores)
    if not n:
        return np.zeros(1)
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    starts = window_starts(n)
    size = min(WINDOW, n)
    return (total[starts + size] - total[starts]) / size


@dataclass(frozen=True)
class Model:
    """weights: of each n-gram that training kept, what it adds to the logit of the toxic class; bias."""

    weights: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        get, grams = self.weights.get, grams_of(word)
        return sum([get(g, 0.0) for g in grams]) / len(grams)

    def score(self, text: str | None, cache: dict[str, float]) -> float:
        if self.bias == -math.inf:
            return 0.0
        scores = []
        for w in words_of(text):
            s = cache.get(w)
            if s is None:
                if len(cache) >= CACHE:
                    cache.clear()
                s = cache[w] = self.word(w)
            scores.append(s)
        z = float(window_means(np.array(scores)).max()) + self.bias
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, z))))


def telling(docs: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a twentieth of the toxic documents have, five at least, and twenty times as many of them as of the others."""
    of = [np.bincount(np.concatenate([np.unique(d) for d, label in zip(docs, y) if label == c]), minlength=n) for c in (0, 1)]
    return (of[1] >= max(5, (y == 1).sum() / 20)) & (of[1] >= 20 * of[0] * ((y == 1).sum() / (y == 0).sum()))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Table and softmax trained jointly on whole texts; each class has its share of the weight, however many texts it has."""
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return Model({}, -math.inf)
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int32) for t in texts]
    size = np.empty(len(vocabulary), dtype=np.int32)
    gram = array("i")
    for k, w in enumerate(vocabulary):
        found = sorted(map(row_of, grams_of(w)))
        size[k] = len(found)
        gram.extend(found)
    gram = np.frombuffer(gram, dtype=np.int32)
    # rows of the table that too few documents have stay zero, as do those that none has
    starts = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for d in docs:
        if len(d):
            seen[np.unique(np.concatenate([gram[starts[w] : starts[w + 1]] for w in np.unique(d)]))] += 1
    rows = np.flatnonzero(seen >= max(2, int((y == 1).sum()) // LEAST_SHARE))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[rows] = np.arange(len(rows), dtype=np.int32)
    gram = place[gram]
    kept = np.add.reduceat(gram >= 0, starts[:-1], dtype=np.int32) if len(size) else size
    gram = gram[gram >= 0]
    starts = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
    del seen, place
    table = rng.normal(0, 0.01, (len(rows), DIM))
    softmax = rng.normal(0, 0.5, (DIM, 2))
    bias = np.array([2.0, -2.0])  # else plain words would have to say that they are clean
    squares = [np.full_like(table, 1e-8), np.full_like(softmax, 1e-8), np.full_like(bias, 1e-8)]
    used = [i for i, d in enumerate(docs) if len(d)]
    parts = [(i, min(i + PART, len(size))) for i in range(0, len(size), PART)]
    told = telling(docs, y, len(vocabulary))
    for epoch in range(EPOCHS):
        read = table @ (softmax[:, 1] - softmax[:, 0])
        scores = np.empty(len(size))
        for i, j in parts:  # a little memory at a time
            owner = np.repeat(np.arange(j - i), kept[i:j])
            scores[i:j] = np.bincount(owner, weights=read[gram[starts[i] : starts[j]]], minlength=j - i) / size[i:j]
        windows, owner = [], []
        for i in used:
            d = docs[i]
            begins = window_starts(len(d))
            means = window_means(scores[d])
            picks = {int(means.argmax())} if epoch >= 2 else {int(rng.integers(len(means)))}
            if not y[i]:
                picks.add(int(rng.integers(len(means))))
            elif told[d].any():
                at = np.flatnonzero(told[d])
                picks.add(int(np.searchsorted(begins, at[rng.integers(len(at))], side="right")) - 1)
            for k in picks:
                windows.append(d[begins[k] : begins[k] + WINDOW])
                owner.append(i)
        lengths = np.array([len(w) for w in windows])
        words = np.concatenate(windows)
        # every n-gram of every word of a window has this part in the window's vector
        part = np.repeat(np.repeat(1.0 / lengths, lengths) / size[words], kept[words])
        where = np.repeat(np.repeat(np.arange(len(windows)), lengths), kept[words])
        first = np.repeat(starts[words], kept[words])
        step = np.arange(len(first)) - np.repeat(np.cumsum(kept[words]) - kept[words], kept[words])
        used_rows = gram[first + step]
        vectors = np.stack([np.bincount(where, weights=part * table[used_rows, k], minlength=len(windows)) for k in range(DIM)], axis=1)
        z = vectors @ softmax + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        t = y[owner]
        weight = np.where(t == 1, TOXIC_SHARE / (t == 1).sum(), (1 - TOXIC_SHARE) / (t == 0).sum())
        d_z = (p - np.eye(2)[t]) * weight[:, None]
        d_vectors = d_z @ softmax.T
        d_table = np.stack([np.bincount(used_rows, weights=part * d_vectors[where, k], minlength=len(rows)) for k in range(DIM)], axis=1)
        for value, square, gradient in zip([table, softmax, bias], squares, [d_table + DECAY * table, vectors.T @ d_z, d_z.sum(axis=0)]):
            square += gradient * gradient
            value -= RATE * gradient / np.sqrt(square)
    logits = dict(zip(rows.tolist(), (table @ (softmax[:, 1] - softmax[:, 0])).tolist()))
    weights = {g: x for w in vocabulary for g in grams_of(w) if (x := logits.get(row_of(g))) is not None}
    return Model(weights, float(bias[1] - bias[0]))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, toxic): at most max_rows rows of each class."""
    agreed = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out())
    usable = docs.where(F.octet_length("text") <= max_bytes).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = agreed.join(usable.distinct(), "doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    texts = docs.where(F.octet_length("text") <= max_bytes).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The model, fitted by one task on the rows of ``training_rows``; only its weights reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        model = fit([r[1] for r in rows], [r[2] for r in rows])
        grams = [None, *sorted(model.weights)]
        yield pa.record_batch([pa.array(grams, pa.string()), pa.array([model.bias, *map(model.weights.get, grams[1:])], pa.float64())], names=["gram", "weight"])

    rows = training_rows(docs, labels, max_rows, max_bytes).select("doc_id", "text", "toxic").repartition(1)
    found = rows.mapInArrow(run, "gram string, weight double").toArrow()
    weights = dict(zip(found["gram"].to_pylist(), found["weight"].to_pylist()))
    return Model(weights, weights.pop(None, -math.inf))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            scores = [model.score(t.as_py(), cache) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py(), cache) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs, train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
