"""Histograms of many selections for pages that ask again and again.

All selections and metrics (sums, and missing columns at every stored cutoff)
that read one table are counted by one aggregation behind one scan, whatever
of them was asked for: what costs is reading, and the next page asks for the
others.  Results are a number for each value, so they stay on the driver under
the version of the track and the resolved selection.  Fewer bins are folded
from them; more bins than were counted are counted again only if a position
reached the last one.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import track as T
from ..operators.histogram import cap_of
from ..sources.store import Store
from .rewrite import resolved, source_of
from .selection import Coordinates, Resolved

# values that the results of a store may have together; the longest unused ones go first
MOST_KEPT = 5_000_000
Hist = dict[int, int]


def folded(hist: Hist, last: int) -> Hist:
    """Values above ``last`` are ``last``."""
    out: Hist = {}
    for v, n in hist.items():
        out[min(v, last)] = out.get(min(v, last), 0) + n
    return out


class Results:
    """Histograms by key, each with the value at which it was cut."""

    def __init__(self, most: int = MOST_KEPT):
        self.most, self.kept, self.size = most, OrderedDict(), 0

    def get(self, key: tuple, last: int) -> Hist | None:
        """Up to ``last``, if that is known."""
        cap, hist = self.kept.get(key, (-1, {}))
        if last > cap and (cap < 0 or hist.get(cap)):
            return None
        self.kept.move_to_end(key)
        return folded(hist, last)

    def put(self, key: tuple, cap: int, hist: Hist) -> None:
        if key in self.kept:
            self.size -= len(self.kept.pop(key)[1])
        self.kept[key] = cap, hist
        self.size += len(hist)
        while self.size > self.most and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1][1])


_results: WeakKeyDictionary[Store, Results] = WeakKeyDictionary()


class Pages:
    """Histograms of selections of one track of a store."""

    def __init__(self, store: Store, name: str, results: Results | None = None):
        self.store, self.name = store, name
        self.results = Results() if results is None else results

    @classmethod
    def of(cls, store: Store, name: str) -> Pages:
        """With the results that this store has had before."""
        return cls(store, name, _results.setdefault(store, Results()))

    def coverage(self, selections: dict[str, Coordinates], n_bins: int | dict[str, int] | None = None, max_positions: int = 0, scaled: bool = True) -> dict[str, Hist]:
        """Of sums; bins as in ``rewrite.hists``, for all or for each selection."""
        chosen = {label: resolved(self.store, self.name, c) for label, c in selections.items()}
        last = {}
        for label, r in chosen.items():
            n = n_bins[label] if isinstance(n_bins, dict) else n_bins
            last[label] = cap_of(len(r.columns)) if n is None else max(n, 1) - 1
        return {label: hist for (label, _), hist in self._hists(chosen, [None], last, max_positions, scaled).items()}

    def missingness(self, selections: dict[str, Coordinates], cutoffs: Sequence[int], max_positions: int = 0, scaled: bool = True) -> dict[tuple[str, int], Hist]:
        """Of columns at each of the cutoffs or below."""
        chosen = {label: resolved(self.store, self.name, c) for label, c in selections.items()}
        return self._hists(chosen, list(dict.fromkeys(cutoffs)), {label: len(r.columns) for label, r in chosen.items()}, max_positions, scaled)

    def table(self, hists: dict, *names: str) -> DataFrame:
        """(selection, value, count) of what these give; more names for keys of several parts."""
        names = names or ("selection",)
        rows = [(*(key if isinstance(key, tuple) else (key,)), v, n) for key, hist in hists.items() for v, n in sorted(hist.items())]
        return self.store.spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'selection' else 'int'}" for n in names) + ", value long, count long")

    def _key(self, r: Resolved, k: int, metric: int | None) -> tuple:
        return self.store.entries[self.name].version, r.intervals, r.columns, k, metric

    def _hists(self, chosen: dict[str, Resolved], metrics: list[int | None], last: dict[str, int], max_positions: int, scaled: bool) -> dict[tuple[str, int | None], Hist]:
        out, lost = {}, {}
        strides = {label: r.stride(max_positions) for label, r in chosen.items()}
        for label, r in chosen.items():
            for m in metrics:
                key = self._key(r, strides[label], m)
                out[label, m] = self.results.get(key, last[label])
                if out[label, m] is None:
                    lost[key] = r, strides[label], m, last[label]
        if lost:
            self._count(list(lost.values()))
            for label, m in [x for x, hist in out.items() if hist is None]:
                out[label, m] = self.results.get(self._key(chosen[label], strides[label], m), last[label])
        if scaled:
            for (label, m), hist in out.items():
                r, k = chosen[label], strides[label]
                if k > 1:
                    factor = r.n_positions / -(-r.n_positions // k)
                    out[label, m] = {v: round(n * factor) for v, n in hist.items()}  # halves to even
        return out

    def _count(self, asked: list[tuple[Resolved, int, int | None, int]]) -> None:
        """One aggregation for all of these, and for what else the same tables say of these selections."""
        stored = list(self.store.summaries(self.name))
        # no less than the cap of the whole track: a page's bins may come from another selection
        least = cap_of(len(self.store.entries[self.name].labels))
        wanted: dict[tuple, tuple[Resolved, int, int | None, int]] = {}
        for r, k, m, last in asked:
            wanted[self._key(r, k, m)] = r, k, m, len(r.columns) if m is not None else max(least, last)
        read = {self._folder(r, m) for r, _, m, _ in asked}
        for r, k, _, _ in asked:
            for m in (None, *(x for x in stored if x is not None)):
                key = self._key(r, k, m)
                if key not in wanted and key not in self.results.kept and self._folder(r, m) in read:
                    wanted[key] = r, k, m, least if m is None else len(r.columns)
        by_folder: dict[str, list] = {}
        for i, (r, k, m, cap) in enumerate(wanted.values()):
            _, number = self._number(r, m)
            where = T.at(r)
            if k > 1:
                sampled = T.rank_in(r) % k == 0
                where = sampled if where is None else where & sampled
            cell = F.struct(F.lit(i).alias("i"), F.least(number, F.lit(cap)).cast("long").alias("value"))
            by_folder.setdefault(self._folder(r, m), []).append((T.at(r), cell if where is None else F.when(where, cell)))
        rows = None
        for folder, cells in by_folder.items():
            one = self.store.read(self.name) if folder == self.store.entries[self.name].data else self.store.spark.read.parquet(f"{self.store.path}/{folder}")
            if all(where is not None for where, _ in cells):  # nothing outside of all of them is read
                inside = cells[0][0]
                for where, _ in cells[1:]:
                    inside = inside | where
                one = one.where(inside)
            one = one.select(F.inline(F.array_compact(F.array(*[c for _, c in cells]))))
            rows = one if rows is None else rows.unionByName(one)
        # at most a row for each value up to its cap
        counted: list[Hist] = [{} for _ in wanted]
        for i, v, n in rows.groupBy("i", "value").agg(F.count(F.lit(1))).collect():
            counted[i][v] = n
        for (key, (_, _, _, cap)), hist in zip(wanted.items(), counted):
            self.results.put(key, cap, hist)

    def _folder(self, r: Resolved, metric: int | None) -> str:
        return self.store.entries[source_of(self.store, self.name, r, metric)[0]].data

    def _number(self, r: Resolved, metric: int | None):
        """The table to read and the number in it: of the track's labels, or of a summary's stored columns."""
        name, _ = source_of(self.store, self.name, r, metric)
        if name == self.name:
            return name, T.total(r.columns) if metric is None else T.missing(r.columns, metric)
        e = self.store.entries[name]
        return name, F.col(dict(zip(e.labels, e.stored()))[self.store.entries[self.name].grouping().matching(r.columns)])
