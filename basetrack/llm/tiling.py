"""Benchmark decontamination by greedy string tiling.

Texts become word numbers of the benchmark's own vocabulary (0: not in it), so
a window that holds a 0 can't match and equal numbers are equal words.
Karp-Rabin hashes of all windows of ``min_match`` words are joined with those
of the benchmark items; along each diagonal the shared seeds grow into maximal
matches, which are verified word by word.  Then the longest match whose words
are all free is marked again and again, what is left of overlapped matches
going back to the queue, until none of ``min_match`` words is left.  The tiles
don't overlap and may come in any order, so a reordered passage is covered as
well.  An item is leaked into a document if the tiles cover at least
``coverage`` of its words.

The benchmark is the query set: it is handled in blocks of about
``block_bytes`` of text, or of one item where that is longer, one after the
other and each against all documents.  A block's index is what is broadcast; it
is gone from the driver before the next one is made, so memory doesn't depend
on the benchmark's size.  Documents are never shuffled and each is tiled where
it is read.

Rows: null and empty texts, and items without words, match nothing; items of
fewer than ``min_match`` words must occur whole; repeated rows of documents
each give their rows, repeated items count once; null ids stay null.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent_if_few, unused, written

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_BYTES = 8_000_000
# pairs of seeds of a text and an item that are looked at together
PAIRS = 1 << 20
SCHEMA = "doc_id long, item_id long, item_words int, tiled_words int, n_tiles int, first_word int, coverage double"
BASE = np.uint64(0x9E3779B97F4A7C15)
find_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return find_words((text or "").lower())


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all windows of k numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * BASE + ids[j : j + n].astype(np.uint64)
    return h


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)
            k = min(min_match, len(ids))
            seeds[k] += [(int(h), len(self.items)) for h in window_hashes(ids, k)]
            self.items.append((item_id, ids))
        self.seeds = {}
        for k, found in seeds.items():
            found = sorted(set(found))
            self.seeds[k] = (np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found], dtype=np.int64))

    def candidates(self, ids: np.ndarray) -> set[int]:
        """Items that share a seed with a text."""
        out: set[int] = set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for k, (hashes, owners) in self.seeds.items():
            if len(ids) < k:
                continue
            full = np.nonzero(known[k:] - known[:-k] == k)[0]
            if not len(full):
                continue
            h = np.unique(window_hashes(ids, k)[full])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, b in zip(lo[hi > lo], hi[hi > lo]):
                out.update(owners[a:b].tolist())
        return out


def same_words(ids: np.ndarray, item: np.ndarray, p: int, q: int) -> int:
    """How many words are the same from p in the text and q in the item on."""
    most, n, step = min(len(ids) - p, len(item) - q), 0, 64
    while n < most:
        stop = min(n + step, most)
        differ = ids[p + n : p + stop] != item[q + n : q + stop]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n, step = stop, 2 * step
    return n


def matches(ids: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of k or more words: (length, start in the text, start in the item)."""
    own, theirs = window_hashes(ids, k), window_hashes(item, k)
    order = np.argsort(theirs, kind="stable")
    ranked = theirs[order]
    places = np.nonzero(np.isin(own, ranked))[0]
    lo, hi = np.searchsorted(ranked, own[places], "left"), np.searchsorted(ranked, own[places], "right")
    total = np.cumsum(hi - lo)
    cuts = np.searchsorted(total, np.arange(PAIRS, int(total[-1]) if len(total) else 0, PAIRS))
    out = []
    for at, first, n in zip(np.split(places, cuts), np.split(lo, cuts), np.split(hi - lo, cuts)):
        p = np.repeat(at, n)
        q = order[np.arange(len(p)) + np.repeat(first - np.cumsum(n) + n, n)]
        # a run begins where the words before differ; only from there is it followed
        begins = (p == 0) | (q == 0) | (ids[p - 1] != item[q - 1])
        for i, j in zip(p[begins].tolist(), q[begins].tolist()):
            n_same = same_words(ids, item, i, j)
            if n_same >= k:
                out.append((n_same, i, j))
    return out


def tiles(ids: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in the text, start in the item), longest first, ties by place."""
    k = min(min_match, len(item))
    queue = [(-n, p, q) for n, p, q in matches(ids, item, k)]
    heapq.heapify(queue)
    taken_text: set[int] = set()
    taken_item = np.zeros(len(item), dtype=bool)
    out = []
    room = True  # whether k words of the item in a row are free
    while queue and room:
        n, p, q = heapq.heappop(queue)
        free = [p + j not in taken_text and not taken_item[q + j] for j in range(-n)]
        if all(free):
            out.append((-n, p, q))
            taken_text.update(range(p, p - n))
            taken_item[q : q - n] = True
            room = any(len(x) >= k for x in (~taken_item).tobytes().split(b"\0"))
            continue
        j = 0
        while j < -n:  # what is still free of an overlapped match is queued anew
            if free[j]:
                end = j
                while end < -n and free[end]:
                    end += 1
                if end - j >= k:
                    heapq.heappush(queue, (j - end, p + j, q + j))
                j = end
            j += 1
    return out


def leaks_of(text: str | None, index: Index, min_match: int, coverage: float) -> list[tuple]:
    """(item id, its words, tiled words, tiles, first tiled word of the text, coverage) of each leaked item."""
    get = index.vocabulary.get
    ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
    out = []
    for i in sorted(index.candidates(ids)) if len(ids) else ():
        item_id, item = index.items[i]
        found = tiles(ids, item, min_match)
        tiled = sum(n for n, _, _ in found)
        if found and tiled >= coverage * len(item):
            out.append((item_id, len(item), tiled, len(found), min(p for _, p, _ in found), tiled / len(item)))
    return out


def _row_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, block_bytes: int) -> DataFrame:
    """Columns of SCHEMA, and row_text, the hash of the document's text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text").cast("string"))
    out = None
    for block in range(n_blocks):
        shared = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.where(block_of == block).collect()], min_match))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [
                    (doc_id, *leak, row_text)
                    for doc_id, row_text, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
                    for leak in leaks_of(text.as_py(), index, min_match, coverage)
                ]
                columns = zip(*found) if found else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*TYPES, pa.int64()])], names=[*NAMES, "row_text"])

        # written, so that the block's index can go before the next one is made
        found = written(rows.mapInArrow(run, f"{SCHEMA}, row_text long"), "leaks")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A row for each document row and benchmark item that is leaked into it (columns of SCHEMA)."""
    return _row_leaks(docs, benchmark, min_match, coverage, block_bytes).select(*NAMES)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay.

    A document is a doc_id with a text, so another text of the same doc_id
    stays.  Rows without a doc_id stay.
    """
    lost_id, lost_text = unused(docs, "lost_id"), unused(docs, "lost_text")
    bad = _row_leaks(docs, benchmark, min_match, coverage, block_bytes).where(F.col("doc_id").isNotNull())
    bad = sent_if_few(bad.select(F.col("doc_id").alias(lost_id), F.col("row_text").alias(lost_text)).distinct())
    return docs.join(bad, (docs["doc_id"] == bad[lost_id]) & (F.xxhash64(docs["text"]) == bad[lost_text]), "left_anti")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
