"""Accessibility masks: boolean layers of a threshold profile, and their runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.selection import Genome, Grouping
from .track import missing, total


class MissingSetError(ValueError):
    """A profile names a set that the grouping doesn't have."""


def cutoffs_of(profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None) -> list[int]:
    """The given cutoffs, or else the profile's."""
    return sorted(set(cutoffs if cutoffs is not None else [p["missing_cutoff"] for p in profile.values()]))


def layers(track: DataFrame, grouping: Grouping, profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None) -> DataFrame:
    """(contig_idx, contig, lpos, pos, sample_set, missing_cutoff, excluded_coverage, excluded_missing, accessible).

    profile: of each set lower_coverage, upper_coverage, missing_cutoff,
    max_missing_samples.  Given cutoffs take the place of the profile's.
    """
    known_sets(profile, grouping)
    return layers_from(track, *sums_and_gaps(grouping, profile, cutoffs_of(profile, cutoffs)), profile, cutoffs)


def known_sets(profile: dict[str, dict[str, int]], grouping: Grouping) -> None:
    sets = grouping.members()
    if unknown := [n for n in profile if n not in sets]:
        raise MissingSetError(f"the profile's set {unknown[0]} isn't in the grouping; it has {', '.join(sets)}")


def sums_and_gaps(grouping: Grouping, profile: dict[str, dict[str, int]], cutoffs: Sequence[int]) -> tuple[dict[str, Column], dict[tuple[str, int], Column]]:
    """Of each set of the profile the sum of its columns, and how many of them are missing at each cutoff."""
    sets = grouping.members()
    return {n: total(sets[n]) for n in profile}, {(n, k): missing(sets[n], k) for n in profile for k in cutoffs}


def layers_from(rows: DataFrame, sums: dict[str, Column], gaps: dict[tuple[str, int], Column], profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None) -> DataFrame:
    """Layers of positions with each set's sum, and its missing columns at each cutoff."""
    cells = []
    for name, p in profile.items():
        coverage = (sums[name] < p["lower_coverage"]) | (sums[name] > p["upper_coverage"])
        for k in cutoffs_of({name: p}, cutoffs):
            lost = gaps[name, k] > p["max_missing_samples"]
            cells.append(F.struct(F.lit(name).alias("sample_set"), F.lit(k).alias("missing_cutoff"), coverage.alias("excluded_coverage"), lost.alias("excluded_missing"), (~(coverage | lost)).alias("accessible")))
    return rows.select("contig_idx", "contig", "lpos", "pos", F.inline(F.array(*cells)))


def layer_counts(track: DataFrame, grouping: Grouping, profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None, *keys: str) -> DataFrame:
    """(*keys, sample_set, missing_cutoff, accessible_bp, missing_bp): how many positions the layers have, counted side by side, so a position stays one row."""
    known_sets(profile, grouping)
    sums, gaps = sums_and_gaps(grouping, profile, cutoffs_of(profile, cutoffs))
    counts, rows = [], []
    for name, p in profile.items():
        coverage = (sums[name] < p["lower_coverage"]) | (sums[name] > p["upper_coverage"])
        for k in cutoffs_of({name: p}, cutoffs):
            lost = gaps[name, k] > p["max_missing_samples"]
            at = len(rows)
            counts += [F.count_if(~(coverage | lost)).alias(f"_a{at}"), F.count_if(lost).alias(f"_m{at}")]
            rows.append(F.struct(F.lit(name).alias("sample_set"), F.lit(k).alias("missing_cutoff"), F.col(f"_a{at}").alias("accessible_bp"), F.col(f"_m{at}").alias("missing_bp")))
    return track.groupBy(*keys).agg(*counts).select(*keys, F.inline(F.array(*rows)))


def runs(mask: DataFrame, *keys: str, span: int = 1 << 20) -> DataFrame:
    """(contig_idx, contig, *keys, start, end): maximal runs of accessible positions within a contig, half-open.

    Runs are found within spans of a fixed number of positions.  Only those
    that touch an edge of their span, two of a span at most, are then put in
    order and joined, so no task sorts a chromosome.
    """
    own = ["contig_idx", "contig", *keys]
    piece = F.floor(F.col("lpos") / span)
    rows = mask.where("accessible").select(*own, "lpos", piece.alias("_piece"))
    n = F.row_number().over(Window.partitionBy(*own, "_piece").orderBy("lpos"))
    parts = rows.withColumn("_island", F.col("lpos") - n).groupBy(*own, "_piece", "_island").agg(F.min("lpos").alias("start"), (F.max("lpos") + 1).alias("end"))
    open_left, open_right = (F.col("start") % span == 0) & (F.col("start") > 0), F.col("end") % span == 0
    inner = parts.where(~(open_left | open_right)).select(*own, "start", "end")
    # a run goes on where the one before ended
    order = Window.partitionBy(*own).orderBy("start")
    first = (F.col("start") != F.coalesce(F.lag("end").over(order), F.lit(-1))).cast("int")
    edges = parts.where(open_left | open_right).withColumn("_first", first).withColumn("_run", F.sum("_first").over(order))
    return inner.unionByName(edges.groupBy(*own, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run"))


class _Runs:
    """Runs of one flag in rows that come in batches.  A stretch ends where the next row isn't the next position."""

    def __init__(self):
        self.open: tuple[int, int, bool] | None = None  # contig, start, whether it starts with its stretch
        self.last = 0
        self.out: list[tuple[np.ndarray, ...]] = []

    def close(self, end: int, edge: bool) -> None:
        contig, start, left = self.open
        self.out.append(tuple(np.array([x]) for x in (contig, start, end, left or edge)))
        self.open = None

    def add(self, contig: np.ndarray, pos: np.ndarray, flag: np.ndarray, broken: np.ndarray) -> None:
        """``broken``: where a stretch begins; that of the last batch goes on unless its first is."""
        goes_on = self.open is not None and bool(flag[0]) and not broken[0]
        if self.open and not goes_on:
            self.close(self.last + 1, bool(broken[0]))
        begins = flag & (broken | ~np.r_[goes_on, flag[:-1]])
        breaks = np.r_[broken[1:], False]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(flag & (breaks | ~np.r_[flag[1:], False]))
        if goes_on and ends[0] < len(pos) - 1:
            self.close(int(pos[ends[0]]) + 1, bool(breaks[ends[0]]))
        ends = ends[1:] if goes_on else ends
        left = broken[starts] & (pos[starts] > 0)
        if flag[-1] and len(starts) and not self.open:
            self.open = int(contig[starts[-1]]), int(pos[starts[-1]]), bool(left[-1])
            starts, ends, left = starts[:-1], ends[:-1], left[:-1]
        self.out.append((contig[starts], pos[starts], pos[ends] + 1, left | breaks[ends]))
        self.last = int(pos[-1])

    def taken(self) -> list[np.ndarray]:
        out, self.out = self.out, []
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, int)] * 4


def stored_runs(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(contig_idx, contig, name, start, end): maximal runs within a contig of positions with a flag, half-open, for each of ``flags`` by name.

    ``rows`` (contig_idx, contig, lpos, ...) are as a store has them, a row
    for each position in order, so a task finds the runs of what it reads in
    one pass and no position is shuffled.  Runs that touch an edge of what a
    task reads in one stretch are put in order and joined: of these there are
    few in stored rows.  In any other order all runs are such, and the result
    is the same.  All others of a batch go behind the exchange as one row of
    two arrays, so what is sorted there is a row for each batch and not for each run.
    """
    names = list(flags)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, last, contigs = [_Runs() for _ in names], (-1, -1), {}

        def result() -> Iterator[pa.RecordBatch]:
            for k, x in enumerate(each):
                contig, start, end, edge = x.taken()
                packs = [np.array([i]) for i in np.flatnonzero(edge)] + [np.flatnonzero(~edge & (contig == c)) for c in np.unique(contig[~edge])]
                if packs:
                    first, last, whole = [int(i[0]) for i in packs], [int(i[-1]) for i in packs], [not edge[i[0]] for i in packs]
                    lists = [pa.array([x[i] if w else None for i, w in zip(packs, whole)], pa.list_(pa.int64())) for x in (start, end)]
                    own = [pa.array(contig[first], pa.int32()), pa.array([contigs[c] for c in contig[first].tolist()]), pa.array(np.full(len(packs), k), pa.int32())]
                    yield pa.record_batch([*own, pa.array(start[first], pa.int64()), pa.array(end[last], pa.int64()), *lists], names=["contig_idx", "contig", "flag", "start", "end", "starts", "ends"])

        for batch in batches:
            if not len(batch):
                continue
            contig, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            contigs |= {int(c): batch.column(1)[int(i)].as_py() for c, i in zip(*np.unique(contig, return_index=True))}
            broken = np.r_[(int(contig[0]), int(pos[0])) != (last[0], last[1] + 1), (contig[1:] != contig[:-1]) | (pos[1:] != pos[:-1] + 1)]
            last = int(contig[-1]), int(pos[-1])
            for k, x in enumerate(each):
                x.add(contig, pos, batch.column(3 + k).to_numpy(zero_copy_only=False).astype(bool), broken)
            yield from result()
        for x in each:
            if x.open:
                x.close(x.last + 1, True)
        yield from result()

    columns = [F.coalesce(flag, F.lit(False)).alias(f"f{k}") for k, flag in enumerate(flags.values())]
    pieces = rows.select(F.col("contig_idx").cast("int"), "contig", F.col("lpos").cast("long"), *columns).mapInArrow(found, "contig_idx int, contig string, flag int, start long, end long, starts array<long>, ends array<long>")
    # a row of whole runs is alone; of those at edges one goes on where the one before ended
    pieces = pieces.withColumn("_at", F.when(F.col("starts").isNull(), -1).otherwise(F.col("start")))
    own = ["contig_idx", "contig", "flag", "_at"]
    order = Window.partitionBy(*own).orderBy("start")
    first = (F.col("start") != F.coalesce(F.lag("end").over(order), F.lit(-1))).cast("int")
    joined = pieces.withColumn("_first", first).withColumn("_run", F.sum("_first").over(order)).groupBy(*own, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    each = F.arrays_zip(F.coalesce("starts", F.array("start")).alias("start"), F.coalesce("ends", F.array("end")).alias("end"))
    return joined.select("contig_idx", "contig", F.get(F.array(*map(F.lit, names)), F.col("flag")).alias("name"), F.inline(each).alias("start", "end"))


# positions of a piece in which runs are put in order
PIECE = 1 << 20


def _cut(runs: DataFrame, size: int, *columns: str) -> DataFrame:
    """(*columns, _piece, start, end): runs cut at the borders of pieces of ``size`` positions."""
    cut = runs.where("start < end").select(*columns, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("_piece"))
    return cut.select(*columns, "_piece", F.greatest("start", F.col("_piece") * size).alias("start"), F.least("end", (F.col("_piece") + 1) * size).alias("end"))


def _rejoined(parts: DataFrame, size: int, *own: str) -> DataFrame:
    """(*own, start, end): runs that were cut, whole again; ``parts`` (*own, _piece, start, end) don't overlap.

    Those that touch no border are alone; of those that do there are two in a
    piece at most, so no task sorts a contig.
    """
    edge = (F.col("start") % size == 0) | (F.col("end") % size == 0)
    parts = parts.withColumn("_at", F.when(edge, -1).otherwise(F.col("_piece")))
    order = Window.partitionBy(*own, "_at").orderBy("start")
    first = (F.col("start") != F.coalesce(F.lag("end").over(order), F.lit(-1))).cast("int")
    rows = parts.withColumn("_first", first).withColumn("_run", F.sum("_first").over(order))
    return rows.groupBy(*own, "_at", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_at", "_run")


def union(runs: DataFrame, *keys: str, piece: int = PIECE) -> DataFrame:
    """(contig_idx, contig, *keys, start, end): what any of the runs covers, as runs that neither touch nor overlap."""
    own = ["contig_idx", "contig", *keys]
    order = Window.partitionBy(*own, "_piece").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = (reached.isNull() | (F.col("start") > reached)).cast("int")
    rows = _cut(runs, piece, *own).withColumn("_new", first).withColumn("_island", F.sum("_new").over(order))
    parts = rows.groupBy(*own, "_piece", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
    return _rejoined(parts, piece, *own)


def complement(runs: DataFrame, genome: Genome, key: str, names: Sequence[str], piece: int = PIECE) -> DataFrame:
    """(contig_idx, contig, key, start, end): the rest of each contig, for each of the ``names`` that ``key`` has, also where it has no runs; ``runs`` neither touch nor overlap."""
    own = ["contig_idx", "contig", key]
    contigs = [(i, c, k, n) for i, (c, n) in enumerate(genome.lengths().items()) if n for k in names]
    table = runs.sparkSession.createDataFrame(contigs, f"contig_idx int, contig string, `{key}` string, _n long")
    pieces = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / piece))).alias("_piece"))
    borders = (F.col("_piece") * piece, F.least((F.col("_piece") + 1) * piece, F.col("_n")))
    edges = pieces.select(*own, "_piece", F.inline(F.array(*[F.struct(x.alias("start"), x.alias("end")) for x in borders])))
    rows = edges.unionByName(_cut(runs, piece, *own))
    gaps = rows.withColumn("_next", F.lead("start").over(Window.partitionBy(*own, "_piece").orderBy("start", "end")))
    return _rejoined(gaps.where("_next > end").select(*own, "_piece", F.col("end").alias("start"), F.col("_next").alias("end")), piece, *own)


LAYERS = ("accessible", "excluded_coverage", "excluded_missing")


def layer_runs(rows: DataFrame, sums: dict[str, Column], gaps: dict[tuple[str, int], Column], profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None) -> DataFrame:
    """(contig_idx, contig, sample_set, missing_cutoff, layer, start, end): all layers of stored positions as runs, in one pass; what is excluded for its coverage has no cutoff."""
    flags, of = {}, []

    def add(name: str, cutoff: int | None, layer: str, flag: Column) -> None:
        flags[str(len(of))] = flag
        of.append(F.struct(F.lit(name).alias("sample_set"), F.lit(cutoff).cast("int").alias("missing_cutoff"), F.lit(layer).alias("layer")))

    for name, p in profile.items():
        coverage = (sums[name] < p["lower_coverage"]) | (sums[name] > p["upper_coverage"])
        add(name, None, "excluded_coverage", coverage)
        for k in cutoffs_of({name: p}, cutoffs):
            lost = gaps[name, k] > p["max_missing_samples"]
            add(name, k, "excluded_missing", lost)
            add(name, k, "accessible", ~(coverage | lost))
    runs = stored_runs(rows, flags)
    return runs.select("contig_idx", "contig", F.get(F.array(*of), F.col("name").cast("int")).alias("_of"), "start", "end").select("contig_idx", "contig", "_of.*", "start", "end")


def lines_of_runs(runs: DataFrame, genome: Genome, width: int = 70) -> DataFrame:
    """(contig_idx, contig, line, bits): FASTA lines of 0 and 1, of the runs of one layer; as many rows as there are lines."""
    contigs = [(i, c, n) for i, (c, n) in enumerate(genome.lengths().items()) if n]
    table = runs.sparkSession.createDataFrame(contigs, "contig_idx int, contig string, n long")
    step = 1 << 16
    spread = lambda rows, first, last: rows.select("*", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("_at")).select("*", F.explode(F.sequence("_at", F.least(F.col("_at") + step - 1, last))).alias("line"))
    last = F.floor((F.col("n") - 1) / width)
    axis = spread(table.repartition("contig_idx"), F.lit(0).cast("long"), last).select("contig_idx", "contig", "line", F.least(F.lit(width).cast("long"), F.col("n") - F.col("line") * width).alias("size"))
    cut = spread(runs, F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    start = F.col("line") * width
    parts = cut.select("contig_idx", "line", F.struct((F.greatest("start", start) - start).cast("int").alias("a"), (F.least("end", start + width) - start).cast("int").alias("b")).alias("part"))
    parts = parts.groupBy("contig_idx", "line").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    drawn = lambda s, p: F.struct(p["b"].alias("at"), F.concat(s["bits"], F.repeat(F.lit("0"), p["a"] - s["at"]), F.repeat(F.lit("1"), p["b"] - p["a"])).alias("bits"))
    bits = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.lit("").alias("bits")), drawn)["bits"]
    rows = axis.join(parts.withColumn("bits", bits), ["contig_idx", "line"], "left")
    return rows.select("contig_idx", "contig", "line", F.rpad(F.coalesce("bits", F.lit("")), F.col("size").cast("int"), F.lit("0")).alias("bits"))


def lines(mask: DataFrame, width: int = 70) -> DataFrame:
    """(contig_idx, contig, line, bits): FASTA lines of 0 and 1."""
    digit = F.when(F.col("accessible"), "1").otherwise("0")
    rows = mask.select("contig_idx", "contig", F.floor(F.col("lpos") / width).alias("line"), F.struct("lpos", digit.alias("d")).alias("x"))
    return rows.groupBy("contig_idx", "contig", "line").agg(F.array_join(F.sort_array(F.collect_list("x"))["d"], "").alias("bits"))
