"""Operators on wide tracks: a row for each position (pos, contig_idx, lpos), a column for each sample.

Set sums and missing counts are expressions on one row, so any number of sets
and cutoffs is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.selection import Grouping, Resolved


def balanced(terms: Sequence[Column]) -> Column:
    """The sum as a tree of logarithmic depth."""
    terms = list(terms) or [F.lit(0)]
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0].cast("long")


def total(columns: Sequence[str]) -> Column:
    return balanced([F.col(c).cast("long") for c in columns])


def missing(columns: Sequence[str], cutoff: int) -> Column:
    """How many columns are at the cutoff or below."""
    return balanced([(F.col(c) <= cutoff).cast("long") for c in columns])


def at(resolved: Resolved) -> Column | None:
    """Pushable predicate on pos; None for the whole genome."""
    return None if resolved.n_positions == resolved.genome_size else inside(resolved.intervals)


def inside(intervals: Sequence[tuple[int, int]]) -> Column:
    """Pushable predicate on pos."""
    out = None
    for a, b in intervals:
        one = (F.col("pos") >= a) & (F.col("pos") < b)
        out = one if out is None else out | one
    return F.lit(False) if out is None else out


def select(track: DataFrame, resolved: Resolved, *keep: str) -> DataFrame:
    where = at(resolved)
    rows = track if where is None else track.where(where)
    return rows.select("pos", *keep, *resolved.columns)


def rank_in(resolved: Resolved) -> Column:
    """Place of a position among those selected."""
    out, before = F.lit(None).cast("long"), 0
    for a, b in resolved.intervals:
        out = F.when((F.col("pos") >= a) & (F.col("pos") < b), F.col("pos") - a + before).otherwise(out)
        before += b - a
    return out


def strided(track: DataFrame, resolved: Resolved, max_positions: int) -> DataFrame:
    """Every k-th selected position, k the least that keeps at most max_positions."""
    k = resolved.stride(max_positions)
    rows = select(track, resolved)
    return rows if k == 1 else rows.where(rank_in(resolved) % k == 0)


def summaries(track: DataFrame, grouping: Grouping, cutoffs: Sequence[int] = (), *keep: str) -> DataFrame:
    """sum_<set> and missing_<cutoff>_<set> of every position."""
    sets = grouping.members()
    sums = [total(c).alias(f"sum_{n}") for n, c in sets.items()]
    gaps = [missing(c, k).alias(f"missing_{k}_{n}") for k in sorted(set(cutoffs)) for n, c in sets.items()]
    return track.select("pos", *keep, *sums, *gaps)


def array_summaries(rows: DataFrame, grouping: Grouping, metrics: Sequence[int | None]) -> DataFrame:
    """pos, contig_idx, lpos and columns c0, c1, ... of ``rows`` (pos, contig_idx, lpos, array of all columns): for each metric (None: the sum; a cutoff: columns at it or below) one of each set.

    A batch of arrays is a matrix, multiplied by the sets' membership; sums of
    integers below 2 ** 53 are exact.
    """
    member = np.array([[c in m for _, m in grouping.sets] for c in grouping.columns], np.float64)
    names = [f"c{i}" for i in range(len(metrics) * len(grouping.sets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            out = [(cells if k is None else cells <= k).astype(np.float64) @ member for k in metrics]
            columns = np.concatenate(out, axis=1).astype(np.int64) if len(batch) else np.zeros((0, len(names)), np.int64)
            yield pa.record_batch([*batch.columns[:3], *map(pa.array, columns.T)], names=["pos", "contig_idx", "lpos", *names])

    return rows.mapInArrow(run, "pos long, contig_idx int, lpos long, " + ", ".join(f"{n} long" for n in names))


def by_set(track: DataFrame, values: dict[str, Column], name: str = "value", *keep: str) -> DataFrame:
    """(sample_set, value): one row for each position and set, made behind one scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("sample_set"), v.cast("long").alias(name)) for n, v in values.items()])
    return track.select(*keep, F.inline(pairs))


def contig_means(track: DataFrame, grouping: Grouping) -> DataFrame:
    """(contig_idx, contig, sample_set, mean): summed sums over the length of a contig; null if it has none."""
    sets = grouping.members()
    sums = track.groupBy("contig_idx", "contig").agg(F.max("len").alias("len"), *[F.sum(total(c)).alias(n) for n, c in sets.items()])
    means = {n: F.when(F.col("len") > 0, F.col(n) / F.col("len")) for n in sets}
    return sums.select("contig_idx", "contig", "len", F.inline(F.array(*[F.struct(F.lit(n).alias("sample_set"), m.alias("mean")) for n, m in means.items()])))
