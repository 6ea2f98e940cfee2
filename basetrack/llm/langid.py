"""Language identification by prediction by partial matching.

Of each language a tree of byte contexts of up to ORDER bytes counts which byte
came next how often.  A byte costs what the longest context that the tree has
says of it; a byte that never followed there costs an escape (as likely as there
are different bytes in that context, method C) and is looked up in the next
shorter context, without the bytes that the longer one would have had, down to
all bytes that are left, equally likely.  These are the code lengths of an
arithmetic coder whose statistics are frozen.  The language that codes a text in
the fewest bits, with the bits that name the language, is the answer; the
score is its share of the probability.

Texts are lower-cased and everything between letters is one space, so code and
markup say little.  Trees are made in one task a language, from a sample of at
most ``lang_bytes`` bytes a language and ``total_bytes`` in all (parameters): of
the rows with a language whose crc32(doc_id as text) mod 5 is not 0, those
whose hash is smallest; texts longer than a language's bytes are not in it.
The trees, whose size that bounds, go to all executors; scoring is map-only, reads all
of every text in pieces of PIECE bytes and looks each different context and
byte of a piece up once.

Rows: ``und`` with score 0 if the text is null or has no letter or no language was
learned; equally long codes give the language that comes first by name; equal
(doc_id, text) count once in training; a null doc_id is neither held out nor
learned from; a language with no usable text isn't learned; very long texts
are scored whole; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
LANG_BYTES = 300_000
TOTAL_BYTES = 6_000_000
PIECE = 1 << 20
STEPS = 1 << 20
UNKNOWN = "und"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letters() -> Column:
    """The text lower-cased, with a space for all that is between letters."""
    return F.regexp_replace(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{M}]+", " ")


def has_letter() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of texts, that lie one after the other, under the ORDER bytes before it, as one number; and its text's number.

    Before each text are zero bytes.
    """
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    padded = np.zeros(len(data) + ORDER * len(ends), np.uint8)
    at = np.arange(len(data)) + ORDER * (text + 1)
    padded[at] = data
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER, -1, -1):
        out = out << 8 | padded[at - k]
    return out, text


@dataclass(frozen=True)
class Tree:
    """For each length of context the grams that were seen, in order, and how often."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    bits: float

    @classmethod
    def of(cls, full: np.ndarray, counts: np.ndarray, bits: float) -> Tree:
        """From the grams of ORDER bytes of context; the shorter ones are their ends."""
        all_grams, all_counts = [], []
        for k in range(ORDER + 1):
            g, inverse = np.unique(full & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            all_grams.append(g)
            all_counts.append(np.bincount(inverse, counts).astype(np.int64))
        return cls(all_grams, all_counts, bits)

    def contexts(self) -> list[tuple[np.ndarray, ...]]:
        """For each length: contexts, their bytes, their different bytes; and of these two how many the context a byte shorter has besides."""
        out: list[tuple[np.ndarray, ...]] = []
        for k, (g, n) in enumerate(zip(self.grams, self.counts)):
            names, first = np.unique(g >> 8, return_index=True)
            total, kinds = np.add.reduceat(n, first), np.diff(np.r_[first, len(g)])
            more = more_kinds = np.zeros(len(names), np.int64)
            if k:
                low = (1 << 8 * (k - 1)) - 1
                shorter = np.searchsorted(out[-1][0], names & low)
                seen = self.counts[k - 1][np.searchsorted(self.grams[k - 1], g & (1 << 8 * k) - 1)]
                more, more_kinds = out[-1][1][shorter] - np.add.reduceat(seen, first), out[-1][2][shorter] - kinds
            out.append((names, total, kinds, more, more_kinds))
        return out


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in a sorted table, and whether they are."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Coder:
    """Code lengths under a tree."""

    def __init__(self, tree: Tree):
        self.tree, self.of = tree, tree.contexts()

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Of each gram: the bits of its last byte after the others."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        # what is left of a context's bytes and different bytes; -1 where no longer context was there
        left, kinds_left = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        for k in range(ORDER, -1, -1):
            names, total, kinds, more, more_kinds = self.of[k]
            own = codes[todo] & (1 << 8 * (k + 1)) - 1
            at, there = found(names, own >> 8)
            place, hit = found(self.tree.grams[k], own)
            fresh = left < 0
            n, d = np.where(fresh, total[at], left), np.where(fresh, kinds[at], kinds_left)
            part = np.where(hit, self.tree.counts[k][place], d)
            coded = there & (part > 0)
            out[todo[coded]] += np.log2((n + d)[coded] / part[coded])
            left, kinds_left = np.where(there, more[at], left), np.where(there, more_kinds[at], kinds_left)
            stay = ~hit
            todo, left, kinds_left = todo[stay], left[stay], kinds_left[stay]
        out[todo] += math.log2(256 - len(self.tree.grams[0]))
        return out


def sample(docs: DataFrame, lang_bytes: int = LANG_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """(lang, text, size, docs): of each language texts of at most its share of bytes together; docs: how many rows it has."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", "text", F.octet_length(F.col("text").cast("string")).cast("long").alias("bytes"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter() & ~held_out())
    totals = [tuple(r) for r in rows.groupBy("lang").agg(F.sum("bytes"), F.count(F.lit(1))).collect()]  # a row for each language
    share = min(lang_bytes, total_bytes // max(1, len(totals)))
    # about twice the share, so that the window below has few rows of each language
    rates = rows.sparkSession.createDataFrame([(lang, min(STEPS, math.ceil(2 * share * STEPS / n)), k) for lang, n, k in totals], "lang string, rate long, docs long")
    place = F.xxhash64("doc_id", "text")
    kept = rows.where(F.col("bytes") <= share).withColumn("place", place).join(F.broadcast(rates), "lang").where(F.pmod("place", F.lit(STEPS)) < F.col("rate"))
    kept = kept.groupBy("lang", "docs", "place").agg(F.min(letters()).alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    used = F.sum("size").over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(STEPS)), "place"))
    return kept.withColumn("used", used).where(F.col("used") <= share).select("lang", "text", "size", "docs")


def _counted(texts: pd.DataFrame) -> pd.DataFrame:
    data = [t.encode("utf-8", "replace") for t in texts["text"]]
    codes, _ = grams(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(t) for t in data]))
    names, counts = np.unique(codes, return_counts=True)
    return pd.DataFrame({"lang": [texts["lang"].iloc[0]], "grams": [names.tobytes()], "counts": [counts.astype(np.int64).tobytes()], "docs": [texts["docs"].iloc[0]]})


def train(docs: DataFrame, lang_bytes: int = LANG_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, Tree]:
    """A tree for each language, by name."""
    rows = sample(docs, lang_bytes, total_bytes).groupBy("lang").applyInPandas(_counted, "lang string, grams binary, counts binary, docs long").collect()
    every = sum(r["docs"] for r in rows)
    of = sorted(rows, key=lambda r: r["lang"].encode("utf-8", "replace"))
    return {r["lang"]: Tree.of(np.frombuffer(r["grams"], np.int64), np.frombuffer(r["counts"], np.int64), math.log2(every / r["docs"])) for r in of}


def code_lengths(coders: list[Coder], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of each text (texts lie one after the other) under each coder."""
    out = np.zeros((len(ends), len(coders)))
    codes, text = grams(data, ends)
    for a in range(0, len(codes), PIECE):
        names, inverse = np.unique(codes[a : a + PIECE], return_inverse=True)
        at = text[a : a + PIECE]
        first = at[0] if len(at) else 0
        for j, coder in enumerate(coders):
            sums = np.bincount(at - first, coder.bits(names)[inverse])
            out[first : first + len(sums), j] += sums
    return out


def predicted(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    coded = F.when(has_letter(), letters())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, coders = list(shared.value), [Coder(t) for t in shared.value.values()]
        prior = np.array([t.bits for t in shared.value.values()])
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            texts = batch.column(1)
            start = 0
            # as many texts at a time as come to PIECE bytes, or one longer text
            sizes = np.array([len(t) for t in (x.as_py() or b"" for x in texts)]) if coders else np.zeros(0)
            while start < len(sizes):
                end = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), PIECE)))
                data = b"".join(x.as_py() or b"" for x in texts[start:end])
                bits = code_lengths(coders, np.frombuffer(data, np.uint8), np.cumsum(sizes[start:end])) + prior
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
                for i in range(start, end):
                    if texts[i].is_valid:
                        names[i], scores[i] = langs[best[i - start]], share[i - start]
                start = end
            yield pa.record_batch([batch.column(0), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), coded.cast("binary").alias("coded")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = predicted(docs, train(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
