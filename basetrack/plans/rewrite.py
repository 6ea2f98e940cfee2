"""Histograms and masks of a stored track, from its summaries where these have the same numbers.

A selection whose columns are exactly those of a sample set is read from the
set's summary, a column instead of many; any other from the track itself.  A
summary counts only if it was made of the track's present version with its
present sample sets; else the track is read.  All selections that read one
table share one scan and one aggregation.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import masks as M
from ..operators import track as T
from ..operators.histogram import cap_of
from ..sources.store import Store
from .selection import Coordinates, Resolved


def resolved(store: Store, name: str, coordinates: Coordinates) -> Resolved:
    e = store.entries[name]
    return coordinates.resolve(e.genome, e.all_groupings() | {"sample_set": e.grouping()}, e.column_dim)


def source_of(store: Store, name: str, chosen: Resolved, cutoff: int | None) -> tuple[str, Column]:
    """The track to read and the number to count: of sums, or of columns at the cutoff or below."""
    summary, group = store.summaries(name).get(cutoff), store.entries[name].grouping().matching(chosen.columns)
    if summary and group in summary.labels:
        return summary.name, F.col(f"`{group}`").cast("long")
    return name, T.total(chosen.columns) if cutoff is None else T.missing(chosen.columns, cutoff)


def hists(store: Store, name: str, selections: dict[str, Coordinates], cutoff: int | None = None, n_bins: int | None = None, max_positions: int = 0) -> DataFrame:
    """(selection, value, count): coverage histograms, or with a cutoff those of missing columns.

    The last of ``n_bins`` bins (by default the cap that goes with the number
    of columns, or one for each count of missing columns) takes all above it.
    Beyond ``max_positions`` every k-th selected position is counted and the
    counts are brought to all of them.
    """
    by_source: dict[str, list] = {}
    factors = {}
    for label, coordinates in selections.items():
        r = resolved(store, name, coordinates)
        source, number = source_of(store, name, r, cutoff)
        last = len(r.columns) if cutoff is not None else cap_of(len(r.columns)) if n_bins is None else max(n_bins, 1) - 1
        where, k = T.at(r), r.stride(max_positions)
        if k > 1:
            sampled = T.rank_in(r) % k == 0
            where = sampled if where is None else where & sampled
            factors[label] = r.n_positions / -(-r.n_positions // k)
        value = F.struct(F.lit(label).alias("selection"), F.least(number, F.lit(last)).cast("long").alias("value"))
        by_source.setdefault(source, []).append((T.at(r), value if where is None else F.when(where, value)))
    out = None
    for source, cells in by_source.items():
        rows = store.read(source)
        if all(where is not None for where, _ in cells):  # nothing outside of all of them is read
            inside = cells[0][0]
            for where, _ in cells[1:]:
                inside = inside | where
            rows = rows.where(inside)
        one = rows.select(F.inline(F.array_compact(F.array(*[v for _, v in cells]))))
        out = one if out is None else out.unionByName(one)
    counted = out.groupBy("selection", "value").agg(F.count(F.lit(1)).alias("count"))
    if factors:
        factor = F.coalesce(*[F.when(F.col("selection") == label, F.lit(f)) for label, f in factors.items()])
        counted = counted.withColumn("count", F.when(factor.isNull(), F.col("count")).otherwise(F.rint(F.col("count") * factor).cast("long")))
    return counted


def coverage_hist(store: Store, name: str, coordinates: Coordinates, n_bins: int | None = None, max_positions: int = 0) -> DataFrame:
    """(value, count) of one selection."""
    return hists(store, name, {"": coordinates}, None, n_bins, max_positions).drop("selection")


def missingness_hist(store: Store, name: str, coordinates: Coordinates, cutoff: int, max_positions: int = 0) -> DataFrame:
    """(value, count) of one selection."""
    return hists(store, name, {"": coordinates}, cutoff, None, max_positions).drop("selection")


def sum_hists(store: Store, name: str, max_positions: int = 0) -> DataFrame:
    """(selection, value, count) of all sample sets, from the sum summary, which must be there; the last bin of each takes what is above its cap.

    Beyond ``max_positions`` the counts are those of the positions counted.
    Warns of a set that has positions in its last bin.
    """
    from .bundle import Pages

    store.summary(name, "sum")
    pages, members = Pages.of(store, name), store.entries[name].grouping().members()
    out = pages.coverage({n: Coordinates().with_samples(c) for n, c in members.items()}, max_positions=max_positions, scaled=False)
    for n, c in members.items():
        if full := out[n].get(cap_of(len(c))):
            warnings.warn(f"{full} positions of {n} reach its last bin, {cap_of(len(c))}", stacklevel=2)
    return pages.table(out)


def mask_layers(store: Store, name: str, profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None) -> DataFrame:
    """As ``masks.layers``, from the columns of the sets in the summaries if these have all that is asked for in one table; else from the track."""
    return M.layers_from(*_sums_and_gaps(store, name, profile, cutoffs), profile, cutoffs)


def mask_runs(store: Store, name: str, profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None = None) -> DataFrame:
    """As ``masks.layer_runs``, from where ``mask_layers`` reads."""
    return M.layer_runs(*_sums_and_gaps(store, name, profile, cutoffs), profile, cutoffs)


def _sums_and_gaps(store: Store, name: str, profile: dict[str, dict[str, int]], cutoffs: Sequence[int] | None) -> tuple[DataFrame, dict[str, Column], dict[tuple[str, int], Column]]:
    """Rows with the sum of each set of the profile, and its missing columns at each cutoff."""
    grouping, fresh, every = store.entries[name].grouping(), store.summaries(name), M.cutoffs_of(profile, cutoffs)
    M.known_sets(profile, grouping)
    used = [fresh.get(k) for k in (None, *every)]
    if None in used or len({e.data for e in used}) > 1:
        return store.read(name), *M.sums_and_gaps(grouping, profile, every)
    at = {e.attributes["missing_cutoff"]: dict(zip(e.labels, e.stored())) for e in used}
    rows = store.stored_rows(used[0].name).select(*store.axis(), *{c for of in at.values() for n, c in of.items() if n in profile})
    return rows, {n: F.col(at[None][n]) for n in profile}, {(n, k): F.col(at[k][n]) for n in profile for k in every}
