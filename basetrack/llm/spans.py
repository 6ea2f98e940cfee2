"""Substring dedup by sliding sentence spans.

A text is cut into sentences without loss: a sentence ends with a run of
``.!?`` (or their like in other scripts) or a line break and the white space
after it, and one of more than ``MOST_WORDS`` words is cut further after words
that their own hash picks, so that equal passages are cut alike wherever they
stand, and after LONGEST words at most.  Characters of scripts without spaces
count as words, as do parts of what is longer than ``LONG_WORD`` characters
without a space.  From every sentence runs a span: the fewest consecutive
sentences, two at least, with ``min_words`` words; and to every sentence at
which none of these ends runs one, so the spans within a repeated passage cover
all of its whole sentences.  Spans are hashed (96 bits, lower case, white space and
place ignored) and joined globally.  Of each span the first occurrence, by
(doc_id, place in the text), stays; the sentences that any other occurrence
covers are removed.

Texts are cut once: their spans are written, a few arrays for each text, and
then dealt once, by ranges of (hash, doc_id, place), so a passage that is in a
third of all documents is divided over as many tasks as its spans fill.
Within a range equal spans follow each other, the first occurrence in front; of
a passage that goes on from one range to the next, the last key of each range
tells (a row for each task).  Only span keys, not texts, go through this
shuffle; texts go once through the join with what is to be removed.

Rows: null texts stay null and empty ones empty; rows with one doc_id and one
text are one document and are treated alike, so repeated rows don't remove
each other; a null doc_id sorts first.  Columns of any other name stay as they
are, those that the operator uses itself included.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, unused, written

MIN_WORDS = 20
MOST_WORDS = 16
LONGEST = 48
LONG_WORD = 40
STOPS = r".!?\n\u3002\uff01\uff1f\uff0e\uff61\u061f\u06d4\u0964"
cut = re.compile(rf"[^{STOPS}]*[{STOPS}]+\s*|[^{STOPS}]+").findall
next_word = re.compile(r"\S+\s*").findall
# Thai, Lao, Burmese, Khmer, kana and Chinese characters
SPACELESS = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
split_word = re.compile(rf"[{SPACELESS}]\s*|[^{SPACELESS}]+").findall
spaceless = re.compile(f"[{SPACELESS}]").search
# spans in a row of the written table
SPANS_IN_ROW = 1 << 14
NO_ID = -(1 << 63)


def plain(piece: str, words: list[str]) -> bool:
    """Whether white space alone tells the words of a piece."""
    return max(map(len, words), default=0) <= LONG_WORD and (piece.isascii() or not spaceless(piece))


def words_of(piece: str) -> list[str]:
    """The words of a piece, each with the white space behind it."""
    words = next_word(piece)
    if plain(piece, words):
        return words
    out = []
    for word in words:
        for w in split_word(word):
            start = 0
            if len(w.rstrip()) > LONG_WORD:  # cut after characters that the hash of the last four picks
                for k in range(4, len(w.rstrip())):
                    if k - start == LONG_WORD or zlib.crc32(w[k - 4 : k].lower().encode("utf-8", "replace")) % 8 == 0:
                        out.append(w[start:k])
                        start = k
            out.append(w[start:])
    return out


def sentences(text: str) -> list[str]:
    """The text in pieces; joined they are the text."""
    out = []
    for piece in cut(text):
        if len(piece) <= 2 * MOST_WORDS or len(words := words_of(piece)) <= MOST_WORDS:
            out.append(piece)
            continue
        lead = piece[: len(piece) - sum(map(len, words))]
        start = 0
        for i, w in enumerate(words[:-1]):
            if i + 1 - start == LONGEST or zlib.crc32(w.strip().lower().encode("utf-8", "replace")) % 12 == 0:
                out.append(lead + "".join(words[start : i + 1]))
                lead, start = "", i + 1
        out.append(lead + "".join(words[start:]))
    return out


def spans(text: str, min_words: int) -> list[tuple[int, int, int, int]]:
    """(hash, second hash, first sentence, number of sentences) of the spans from each sentence, in order."""
    pieces = sentences(text)
    words = [s.lower().split() for s in pieces]
    digests = [xxhash.xxh64_digest(" ".join(w).encode("utf-8", "replace")) if w else b"" for w in words]
    total = [0, *accumulate(len(w) if plain(s, w) else len(words_of(s)) for s, w in zip(pieces, words))]
    real = [0, *accumulate(1 if w else 0 for w in words)]
    ends, j = [], 0
    for i, w in enumerate(words):
        if not w:
            continue
        j = max(j, i)
        while j < len(words) and (total[j] - total[i] < min_words or real[j] - real[i] < 2):
            j += 1
        if total[j] - total[i] < min_words or real[j] - real[i] < 2:
            break
        ends.append((i, j))
    out = []
    # up to where the next span ends, the longer ones from here are the shortest that end where they do
    for (i, j), (_, after) in zip(ends, [*ends[1:], (0, len(words) + 1)]):
        for end in [j, *(e for e in range(j + 1, after) if words[e - 1])]:
            h = xxhash.xxh3_128_intdigest(b"".join(digests[i:end]))
            out.append((h & 0xFFFFFFFFFFFFFFFF, (h >> 64) & 0xFFFFFFFF, i, end - i))
    return out


def _keyed(docs: DataFrame, row_id: str = "row_id", row_text: str = "row_text") -> DataFrame:
    """``docs`` with two columns that name a document."""
    return docs.withColumn(row_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(row_text, F.xxhash64(docs["text"]))


def span_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_id, row_text, h, h2, start, size): all spans of all documents, in arrays of at most SPANS_IN_ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, columns, ends = [], [], [[] for _ in range(4)], [0]
            for row_id, row_text, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = spans(text.as_py(), min_words)
                for begin in range(0, len(found), SPANS_IN_ROW):
                    part = found[begin : begin + SPANS_IN_ROW]
                    for column, values in zip(columns, zip(*part)):
                        column.extend(values)
                    ids.append(row_id)
                    hashes.append(row_text)
                    ends.append(ends[-1] + len(part))
            given = [
                np.array(columns[0], dtype=np.uint64).view(np.int64),
                np.array(columns[1], dtype=np.uint32).view(np.int32),
                *(np.array(c, dtype=np.int32) for c in columns[2:]),
            ]
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in given]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *arrays], names=["row_id", "row_text", "h", "h2", "start", "size"])

    rows = docs.where(F.col("text").isNotNull())
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("row_id"), F.xxhash64("text").alias("row_text"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row_id long, row_text long, h array<long>, h2 array<int>, start array<int>, size array<int>")


# what a row of the pass over the ranges says: a span to remove, one that is the first of its range, the first and last key of a range
LATER, OPEN, FIRST_KEY, LAST_KEY = range(4)
RANGE = "range int, says int, h long, h2 int, row_id long, row_text long, start int, size int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spans in order of (h, h2, row_id, row_text, start): those that aren't the first occurrence, and the ends of the range."""
    number = TaskContext.get().partitionId()
    names = [f.split()[0] for f in RANGE.split(", ")]
    kinds = [np.int64, np.int32, np.int64, np.int64, np.int32, np.int32]

    def rows(says: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(says), number, dtype=np.int32)), pa.array(says.astype(np.int32)), *map(pa.array, values)], names=names)

    opening = key = place = None  # the range's first key, the key that is being read and its first place
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(i).to_numpy() for i in range(6)]
        keys, places = values[:2], values[2:5]
        if key is None:
            opening = key = [c[0] for c in keys]
            place = [c[0] for c in places]
        changed = np.ones(batch.num_rows, dtype=bool)
        changed[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
        changed[0] = [c[0] for c in keys] != key
        group = np.cumsum(changed)  # 0: the key of the batch before
        begins = np.nonzero(changed)[0]
        first = [np.concatenate(([p], c[begins]))[group] for p, c in zip(place, places)]
        again = np.logical_or.reduce([c != f for c, f in zip(places, first)])
        opens = ~again & (keys[0] == opening[0]) & (keys[1] == opening[1])
        says = np.where(again, LATER, OPEN)
        yield rows(says[again | opens], [c[again | opens] for c in values])
        key = [c[-1] for c in keys]
        place = [f[-1] for f in first]
    if key is not None:
        nothing = [np.zeros(2, dtype=k) for k in kinds[2:]]
        yield rows(np.array([FIRST_KEY, LAST_KEY]), [np.array([a, b], dtype=k) for a, b, k in zip(opening, key, kinds)] + nothing)


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_id, row_text, runs): the runs of sentences (start, size) that are to go, for each document that loses any."""
    spark = docs.sparkSession
    table = written(span_table(docs, min_words), "spans")
    order = ["h", "h2", "row_id", "row_text", "start"]
    rows = table.select("row_id", "row_text", F.inline(F.arrays_zip("h", "h2", "start", "size"))).select(*order, "size")
    ranges = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    seen = written(ranges.mapInArrow(_compared, RANGE), "later-spans")
    # a row or two for each range
    ends = {k: {r["range"]: (r["h"], r["h2"]) for r in seen.where(F.col("says") == k).select("range", "h", "h2").collect()} for k in (FIRST_KEY, LAST_KEY)}
    ranges = sorted(ends[FIRST_KEY])
    going_on = [b for a, b in zip(ranges, ranges[1:]) if ends[LAST_KEY][a] == ends[FIRST_KEY][b]]
    later = (F.col("says") == LATER) | (F.col("says") == OPEN) & F.col("range").isin(going_on)
    return seen.where(later).groupBy("row_id", "row_text").agg(F.collect_set(F.struct("start", "size")).alias("runs"))


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without these runs of sentences; sentences it had; sentences removed."""
    pieces = sentences(text)
    gone = np.zeros(len(pieces) + 1, dtype=np.int64)
    for start, size in runs:
        gone[start] += 1
        gone[start + size] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return "".join(s for s, g in zip(pieces, gone) if not g), len(pieces), int(gone.sum())


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_id, row_text, text, n_sentences, n_removed) of every row of ``docs``, in no order; text is what stays."""
    lost = repeated(docs, min_words)
    rows = _keyed(docs.select("doc_id", "text")).select("row_id", "row_text", F.col("text").cast("string"))
    rows = rows.join(lost, ["row_id", "row_text"], "left").select("row_id", "row_text", "text", "runs.start", "runs.size")
    return rows.mapInArrow(_apply, "row_id long, row_text long, text string, n_sentences int, n_removed int")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n, m = [], [], []
        for text, start, size in zip(*(batch.column(i) for i in (2, 3, 4))):
            text, start = text.as_py(), start.as_py()
            if text is None:
                got = (None, 0, 0)
            elif start is None:
                got = (text, len(sentences(text)), 0)
            else:
                got = without(text, list(zip(start, size.as_py())))
            texts.append(got[0])
            n.append(got[1])
            m.append(got[2])
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32())],
            names=["row_id", "row_text", "text", "n_sentences", "n_removed"],
        )


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans removed from text; n_chars, if there is one, is counted anew.

    All rows and columns stay.
    """
    own = {c: unused(docs, c) for c in ("row_id", "row_text", "runs")}
    lost = repeated(docs, min_words).withColumnsRenamed(own)
    key = [own["row_id"], own["row_text"]]
    rows = _keyed(docs, *key).join(lost, key, "left").drop(*key)
    schema, names = docs.schema, list(docs.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                text = text.as_py()
                if gone.is_valid and text is not None:
                    text = without(text, [(r["start"], r["size"]) for r in gone.as_py()])[0]
                texts.append(text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch(columns, names=names)

    out = rows.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(schema["n_chars"].dataType)))
    return out


def query(docs: DataFrame) -> DataFrame:
    """doc_id, text (what stays), n_sentences, n_removed of every document."""
    rows = cleaned(docs)
    return rows.select(F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("doc_id"), "text", "n_sentences", "n_removed")
