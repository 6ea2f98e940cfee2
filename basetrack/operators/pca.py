"""Window means, their covariance and a principal component analysis of samples.

Of up to FEW samples the covariances are one row of built-in aggregates.  Of
more, each task makes its own moments in numpy (how many windows, their mean
and the matrix of products of what is left), and these are merged FAN_IN at a
time, so nothing has n (n + 1) / 2 expressions and the driver takes one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.selection import Genome, Intervals
from .track import inside

FEW = 32
FAN_IN = 16


def windows(track: DataFrame, size: int) -> DataFrame:
    """Positions of full windows with the window's number in its contig; the rest of a contig is unused."""
    if size < 1:
        raise ValueError("a window has at least one position")
    return track.withColumn("window", F.floor(F.col("lpos") / size)).where(F.col("window") < F.floor(F.col("len") / size))


def window_starts(track: DataFrame, size: int) -> DataFrame:
    return windows(track, size).groupBy("contig_idx", "window").agg(F.min("pos").alias("start"))


def in_whole_contigs(track: DataFrame, genome: Genome, intervals: Intervals) -> DataFrame:
    """Positions of the contigs that are wholly within the intervals; those that are covered in part are left out."""
    return track.where(inside(genome.resolve(intervals.contigs_within(genome))))


def window_means(track: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """(contig_idx, window, a mean for each column)."""
    return windows(track, size).groupBy("contig_idx", "window").agg(*[(F.sum(F.col(f"`{c}`").cast("long")) / size).alias(c) for c in columns])


def covariance(means: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n, the mean of each column and the sample covariance of each pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return means.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"{a}_{b}") for a, b in pairs])


@dataclass(frozen=True)
class Moments:
    """How many rows, their mean, and the summed products of their distances from it."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        return cls(len(rows), mean, (rows - mean).T @ (rows - mean))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    @property
    def covariance(self) -> np.ndarray:
        return self.products / (self.n - 1)

    def packed(self, part: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        return part, self.n, self.mean, self.products[np.triu_indices(len(self.mean))]

    @classmethod
    def unpacked(cls, n: int, mean: np.ndarray, upper: np.ndarray) -> Moments:
        mean = np.asarray(mean)
        products = np.zeros((len(mean), len(mean)))
        products[np.triu_indices(len(mean))] = upper
        return cls(int(n), mean, products + np.triu(products, 1).T)


PARTIAL = "part long, n long, mean array<double>, upper array<double>"


def moments(means: DataFrame, columns: Sequence[str]) -> Moments | None:
    """Of any number of columns, made where the rows are and merged in a tree; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            if len(batch):
                part = batch.column(0)[0].as_py()
                own = Moments.of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([x]) for x in total.packed(part)], names=["part", "n", "mean", "upper"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in rows.sort_values("part").itertuples():
            own = Moments.unpacked(r.n, r.mean, r.upper)
            total = own if total is None else total + own
        return pd.DataFrame([total.packed(key[0])], columns=["part", "n", "mean", "upper"])

    rows = means.select(F.spark_partition_id().alias("part"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = rows.mapInArrow(partial, PARTIAL)
    left = max(int(means.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    while True:
        out = out.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("next")).applyInPandas(merge, PARTIAL)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    # one row, or a few if the means had more partitions than they were aggregated into
    found = sorted(out.collect(), key=lambda r: r["part"])
    total = None
    for r in found:
        own = Moments.unpacked(r["n"], np.array(r["mean"]), np.array(r["upper"]))
        total = own if total is None else total + own
    return total


def _moments_of_few(means: DataFrame, columns: Sequence[str]) -> Moments | None:
    row = covariance(means, columns).first()
    if not row["n"]:
        return None
    products = np.zeros((len(columns), len(columns)))
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            products[i, j] = products[j, i] = (row[f"{a}_{columns[j]}"] or 0.0) * (row["n"] - 1)
    return Moments(row["n"], np.array([row[f"mean_{c}"] for c in columns]), products)


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    n_windows: int

    @property
    def ratios(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total else np.zeros_like(self.eigenvalues)

    @property
    def scores(self) -> np.ndarray:
        return self.components * np.sqrt(self.eigenvalues)


def analyse(track: DataFrame, columns: Sequence[str], size: int) -> Result:
    """Of coverage relative to each sample's mean.  The moments of the windows are all that reaches the driver."""
    if len(columns) < 2:
        raise ValueError("two samples at least are needed")
    means = window_means(track, columns, size)
    found = _moments_of_few(means, columns) if len(columns) <= FEW else moments(means, columns)
    if found is None or found.n < 2:
        raise ValueError(f"two windows at least are needed, there are {found.n if found else 0}")
    if low := [c for c, m in zip(columns, found.mean) if m <= 0]:
        raise ValueError(f"samples without coverage: {', '.join(low)}")
    n = len(columns)
    cov = found.covariance / np.outer(found.mean, found.mean)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    # the entry of largest absolute value of each component is positive
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return Result(tuple(columns), values, vectors * np.where(signs == 0, 1, signs), found.n)
