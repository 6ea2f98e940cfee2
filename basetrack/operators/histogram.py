"""Integer histograms (sample_set, value, count) and what follows from them alone."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.selection import Grouping
from .track import by_set, missing, total

# Defaults of the data model; the environment may give others.
MAX_PER_SAMPLE = int(os.environ.get("BASETRACK_MAX_COVERAGE_PER_SAMPLE", 100))
MAX_BIN = int(os.environ.get("BASETRACK_MAX_COVERAGE_BIN", 100_000))


def cap_of(n_samples: int) -> int:
    return min(n_samples * MAX_PER_SAMPLE, MAX_BIN)


def count_values(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count"))


def sum_hists(track: DataFrame, grouping: Grouping) -> DataFrame:
    """All sets in one pass; the last bin takes what is above the cap."""
    return count_values(by_set(track, {n: F.least(total(c), F.lit(cap_of(len(c)))) for n, c in grouping.members().items()}), "sample_set")


def missing_hists(track: DataFrame, grouping: Grouping, cutoff: int) -> DataFrame:
    return count_values(by_set(track, {n: missing(c, cutoff) for n, c in grouping.members().items()}), "sample_set")


def fold(hist: DataFrame, n_bins: Column | int, *keys: str) -> DataFrame:
    """Bins from n_bins - 1 on become one; at least one bin is left."""
    last = F.greatest(n_bins if isinstance(n_bins, Column) else F.lit(n_bins), F.lit(1)) - 1
    return hist.withColumn("value", F.least("value", last.cast("long"))).groupBy(*keys, "value").agg(F.sum("count").alias("count"))


def scaled(hist: DataFrame, n_total: int, n_counted: int) -> DataFrame:
    """Counts of a sample brought to the whole, halves to even."""
    if n_counted in (0, n_total):
        return hist
    return hist.withColumn("count", F.rint(F.col("count") * F.lit(n_total / n_counted)).cast("long"))


def _cumulated(hist: DataFrame, *keys: str) -> DataFrame:
    own = Window.partitionBy(*keys)
    return hist.withColumn("cum", F.sum("count").over(own.orderBy("value"))).withColumn("n", F.sum("count").over(own))


def at_least(q: Column | float) -> Column:
    """Aggregate over a cumulated histogram: the first value with cum >= q * n; for q = 0 that is bin 0, empty or not."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    return F.when(q <= 0, F.lit(0).cast("long")).otherwise(F.min(F.when(F.col("cum") >= q * F.col("n"), F.col("value"))))


def quantiles(hist: DataFrame, qs: Sequence[float], *keys: str) -> DataFrame:
    out = _cumulated(hist, *keys).groupBy(*keys).agg(*[at_least(q).alias(f"_{i}") for i, q in enumerate(qs)])
    return out.select(*keys, F.inline(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"_{i}").alias("value")) for i, q in enumerate(qs)])))


def stats(hist: DataFrame, *keys: str) -> DataFrame:
    """min, mean, median, max, population std of the values."""
    v, c = F.col("value"), F.col("count")
    rows = _cumulated(hist.where("count > 0"), *keys).withColumn("mean", F.sum(v * c).over(Window.partitionBy(*keys)) / F.col("n"))
    return rows.groupBy(*keys).agg(
        F.min("value").alias("min"),
        F.max("mean").alias("mean"),
        at_least(0.5).alias("median"),
        F.max("value").alias("max"),
        F.sqrt(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))) / F.max("n")).alias("std"),
    )


def boxplot(hist: DataFrame, *keys: str) -> DataFrame:
    return _cumulated(hist.where("count > 0"), *keys).groupBy(*keys).agg(F.min("value").alias("min"), at_least(0.25).alias("q1"), at_least(0.5).alias("median"), at_least(0.75).alias("q3"), F.max("value").alias("max"))


def thresholds(hist: DataFrame) -> DataFrame:
    """(sample_set, lower, upper, max_bin): 60 % of the mean; median + 2 std of the histogram folded at 1.2 x its 99.5 % quantile."""
    whole = _cumulated(hist, "sample_set").groupBy("sample_set").agg(
        F.floor(0.6 * (F.sum(F.col("value") * F.col("count")) / F.sum("count"))).alias("lower"), F.floor(at_least(0.995) * 1.2).alias("max_bin")
    )
    # a row for each set: as small as the sets are few
    folded = fold(hist.join(whole.select("sample_set", "max_bin"), "sample_set"), F.col("max_bin"), "sample_set")
    upper = stats(folded, "sample_set").select("sample_set", F.floor(F.col("median") + 2 * F.col("std")).alias("upper"))
    return whole.join(upper, "sample_set").select("sample_set", F.col("lower").cast("long"), F.col("upper").cast("long"), F.col("max_bin").cast("long"))


def accessible(hist: DataFrame, limits: DataFrame, genome_size: int) -> DataFrame:
    """accessible_bp of each set: positions from lower to upper, scaled to the genome, and the fraction."""
    both = hist.join(limits, "sample_set").groupBy("sample_set").agg(
        F.sum(F.when(F.col("value").between(F.col("lower"), F.col("upper")), F.col("count")).otherwise(0)).alias("inside"), F.sum("count").alias("n")
    )
    bp = F.round(F.col("inside") * F.lit(float(genome_size)) / F.col("n")).cast("long")
    return both.select("sample_set", bp.alias("accessible_bp"), F.round(bp / F.lit(float(genome_size)), 8).alias("frac_full_genome"))


def threshold_table(hist: DataFrame, limits: DataFrame, grouping: Grouping, genome_size: int) -> DataFrame:
    """Limits with what they keep and the statistics of the histogram folded to max_bin + 1 bins."""
    folded = fold(hist.join(limits.select("sample_set", "max_bin"), "sample_set"), F.col("max_bin") + 1, "sample_set")
    spark = hist.sparkSession
    sizes = spark.createDataFrame([(n, len(c)) for n, c in grouping.members().items()], "sample_set string, n_samples long")
    rows = limits.join(sizes, "sample_set").join(accessible(folded, limits, genome_size), "sample_set").join(stats(folded, "sample_set").select("sample_set", "mean", "median", "std"), "sample_set")
    rounded = lambda c: F.round(c, 8)
    return rows.select(
        "sample_set", "n_samples", "lower", "upper", "max_bin",
        rounded(F.col("lower") / F.col("n_samples")).alias("lower_by_sample"), rounded(F.col("upper") / F.col("n_samples")).alias("upper_by_sample"),
        "accessible_bp", "frac_full_genome", F.col("frac_full_genome").alias("frac_active_genome"), "median", rounded(F.col("mean")).alias("mean"),
        *[rounded(F.col("mean") * (k / 100)).alias(f"mean_{k}") for k in (60, 70, 80, 90)],
        rounded(F.col("median") + F.col("std")).alias("median_plus_std"), rounded(F.col("median") + 2 * F.col("std")).alias("median_plus_2std"), rounded(F.col("std")).alias("std"),
    )


def coverage_indicators(hist: DataFrame, limits: DataFrame, sizes: dict[str, int], genome_size: int, by_sample: bool = False) -> DataFrame:
    """Of each set: limits, the positions between them, and the statistics of its histogram, by sample if asked for.

    sizes: how many columns of each set are selected; a set without any is left out.
    """
    known = hist.sparkSession.createDataFrame([(n, k) for n, k in sizes.items() if k], "sample_set string, n_samples long")
    rows = hist.join(limits.select("sample_set", "lower", "upper"), "sample_set").join(F.broadcast(known), "sample_set")  # a row for each set
    value = F.col("value") / F.col("n_samples") if by_sample else F.col("value").cast("double")
    per = F.col("n_samples") if by_sample else F.lit(1)
    inside = (value >= F.col("lower") / per) & (value <= F.col("upper") / per)
    rows = rows.withColumn("inside", F.when(inside, F.col("count")).otherwise(0)).withColumn("value", value)
    keys = ["sample_set", "n_samples", "lower", "upper"]
    found = rows.groupBy(*keys).agg(F.sum("inside").alias("accessible_bp")).join(stats(rows, "sample_set"), "sample_set")
    rounded = lambda c: F.round(c, 8)
    share = rounded(F.col("accessible_bp") / F.lit(float(genome_size)))
    return found.select(
        "sample_set", "lower", rounded(F.col("lower") / F.col("n_samples")).alias("lower_by_sample"), "upper", rounded(F.col("upper") / F.col("n_samples")).alias("upper_by_sample"),
        "accessible_bp", share.alias("frac_active_genome"), share.alias("frac_full_genome"), rounded("median").alias("median"), rounded("mean").alias("mean"),
        *[rounded(F.col("mean") * (k / 100)).alias(f"mean_{k}") for k in (60, 70, 80, 90)],
        rounded(F.col("median") + F.col("std")).alias("median_plus_std"), rounded(F.col("median") + 2 * F.col("std")).alias("median_plus_2std"), rounded("std").alias("std"),
    )
