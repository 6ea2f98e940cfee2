"""What a query asks for: which contigs and which columns, as small values on the driver.

Names are kept as they are given and looked up only once a track is known, so a
selection can be made before any store is open.  Everything is asked for by
None, nothing by an empty tuple.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

ALL = "ALL"
IDENTITY = "identity"


@dataclass(frozen=True)
class Genome:
    """Contigs in genome order with offsets; contig i is [offsets[i], offsets[i + 1])."""

    contigs: tuple[str, ...]
    offsets: tuple[int, ...]

    def __post_init__(self):
        if len(self.offsets) != len(self.contigs) + 1:
            raise ValueError("a genome has one more offset than contigs")

    @classmethod
    def of(cls, lengths: Iterable[tuple[str, int]]) -> Genome:
        names, offsets = [], [0]
        for name, n in lengths:
            names.append(name)
            offsets.append(offsets[-1] + n)
        return cls(tuple(names), tuple(offsets))

    @property
    def size(self) -> int:
        return self.offsets[-1] - self.offsets[0]

    def lengths(self) -> dict[str, int]:
        return {c: self.offsets[i + 1] - self.offsets[i] for i, c in enumerate(self.contigs)}

    def span(self, contig: str) -> tuple[int, int]:
        i = self.indices([contig])[0]
        return self.offsets[i], self.offsets[i + 1]

    def indices(self, contigs: Sequence[str] | None) -> list[int]:
        """Sorted, without repeats; an unknown contig is a KeyError."""
        if contigs is None:
            return list(range(len(self.contigs)))
        at = {c: i for i, c in enumerate(self.contigs)}
        return sorted({at[c] for c in contigs})

    def in_length_range(self, lower: int, upper: int, within: Sequence[str] | None = None) -> list[str]:
        lengths = self.lengths()
        return [self.contigs[i] for i in self.indices(within) if lower <= lengths[self.contigs[i]] <= upper]

    def resolve(self, contigs: Sequence[str] | None) -> list[tuple[int, int]]:
        """Global intervals; touching ones are one."""
        out: list[list[int]] = []
        for i in self.indices(contigs):
            start, end = self.offsets[i], self.offsets[i + 1]
            if out and out[-1][1] == start:
                out[-1][1] = end
            else:
                out.append([start, end])
        return [(a, b) for a, b in out]

    def regions(self, contigs: Sequence[str] | None) -> list[tuple[str, int, int]]:
        lengths = self.lengths()
        return [(self.contigs[i], 0, lengths[self.contigs[i]]) for i in self.indices(contigs)]


@dataclass(frozen=True)
class Intervals:
    """A set of global positions as half-open stretches, in order, that neither touch nor overlap."""

    spans: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, spans: Iterable[tuple[int, int]]) -> Intervals:
        """From any stretches; empty ones say nothing."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(x for x in spans if x[0] < x[1]):
            if out and a <= out[-1][1]:
                a, b = out[-1][0], max(b, out.pop()[1])
            out.append((a, b))
        return cls(tuple(out))

    @property
    def n_positions(self) -> int:
        return sum(b - a for a, b in self.spans)

    def __or__(self, other: Intervals) -> Intervals:
        return Intervals.of((*self.spans, *other.spans))

    def __and__(self, other: Intervals) -> Intervals:
        out, i, j = [], 0, 0
        while i < len(self.spans) and j < len(other.spans):
            (a, b), (c, d) = self.spans[i], other.spans[j]
            out.append((max(a, c), min(b, d)))
            i, j = (i + 1, j) if b < d else (i, j + 1)
        return Intervals.of(out)

    def __sub__(self, other: Intervals) -> Intervals:
        if not self.spans:
            return self
        edges = [self.spans[0][0], *(x for span in other.spans for x in span), self.spans[-1][1]]
        return self & Intervals.of(zip(edges[::2], edges[1::2]))

    def contigs_within(self, genome: Genome) -> list[str]:
        """Contigs all of whose positions are in, in genome order; one without positions is in if where it stands is."""
        starts, out = [a for a, _ in self.spans], []
        for i, c in enumerate(genome.contigs):
            k = bisect_right(starts, genome.offsets[i]) - 1
            if k >= 0 and genome.offsets[i + 1] <= self.spans[k][1]:
                out.append(c)
        return out


@dataclass(frozen=True)
class Grouping:
    """Sets of columns, in order; they may overlap.  ALL, if named, has every column."""

    columns: tuple[str, ...]
    sets: tuple[tuple[str, frozenset[str]], ...] = ()

    def __post_init__(self):
        names = [n for n, _ in self.sets]
        if len(set(names)) != len(names):
            raise ValueError("a sample set is named twice")
        for name, members in self.sets:
            if unknown := sorted(members - set(self.columns)):
                raise ValueError(f"sample set {name} names unknown samples: {', '.join(unknown)}")
            if name == ALL and members != set(self.columns):
                raise ValueError("the set ALL must hold every sample")

    @classmethod
    def of(cls, columns: Sequence[str], pairs: Iterable[tuple[str, str]]) -> Grouping:
        """From (column, set) pairs: unknown columns are dropped, ALL comes first, the others by name."""
        sets: dict[str, set[str]] = {}
        for column, name in pairs:
            if column in columns:
                sets.setdefault(name, set()).add(column)
        return cls(tuple(columns), tuple((n, frozenset(sets[n])) for n in sorted(sets))).with_all()

    def with_all(self) -> Grouping:
        if any(n == ALL for n, _ in self.sets):
            return self
        return replace(self, sets=((ALL, frozenset(self.columns)), *self.sets))

    def members(self) -> dict[str, list[str]]:
        """Columns of each set in column order."""
        return {n: [c for c in self.columns if c in m] for n, m in self.sets}

    def counts(self, selected: Sequence[str]) -> list[tuple[str, int, int]]:
        return [(n, len(m & set(selected)), len(m)) for n, m in self.sets]

    def matching(self, selected: Sequence[str]) -> str | None:
        """The first set, ALL before the others, whose members are exactly those selected."""
        known = dict(self.sets)
        return next((n for n in self.of_selection(selected) if n in known and known[n] == set(selected)), None)

    def of_selection(self, selected: Sequence[str] | None = None) -> list[str]:
        """ALL first, then the sets that have a selected column."""
        chosen = set(self.columns if selected is None else selected)
        return [ALL, *(n for n, m in self.sets if n != ALL and m & chosen)]

    def of_column(self, column: str) -> list[str]:
        """Its sets; ALL only if there is no other."""
        own = [n for n, m in self.sets if column in m and n != ALL]
        return own or [ALL]

    def digest(self) -> str:
        """Of the membership and all names; how many columns there are keeps names of columns and of sets apart."""
        cells = bytes(int(c in m) for c in self.columns for _, m in self.sets)
        names = [str(len(self.columns)), *self.columns, *(n for n, _ in self.sets)]
        return "md5:" + hashlib.md5(cells + "|".join(["", *names]).encode()).hexdigest()


def columns_of(grouping: Grouping, samples: Sequence[str] | None = None, sample_sets: Sequence[str] | None = None) -> list[str]:
    """Columns that are among the samples and in any of the sets, in column order; unknown names are a ValueError."""
    keep = set(grouping.columns)
    if samples is not None:
        if unknown := sorted(set(samples) - keep):
            raise ValueError(f"unknown samples: {', '.join(unknown)}")
        keep &= set(samples)
    if sample_sets is not None:
        known = dict(grouping.sets)
        if unknown := sorted(set(sample_sets) - set(known)):
            raise ValueError(f"unknown sample sets: {', '.join(unknown)}")
        keep &= set().union(*(known[s] for s in sample_sets))
    return [c for c in grouping.columns if c in keep]


SAMPLE, SAMPLE_SET = "sample", "sample_set"


def filtered(genome: Genome, lower: int = 0, upper: int | None = None, contigs: Sequence[str] = (), samples: Sequence[str] = (), sample_sets: Sequence[str] = ()) -> Coordinates:
    """What filters together leave: contigs of a length range that are also picked.

    Nothing picked means all; a length range that no picked contig has leaves
    none.
    """
    kept = genome.in_length_range(lower, genome.size if upper is None else upper, tuple(contigs) or None)
    whole = len(kept) == len(genome.contigs)
    return Coordinates(None if whole else tuple(kept), tuple(samples) or None).with_sample_sets(tuple(sample_sets) or None)


@dataclass(frozen=True)
class Coordinates:
    """A selection of contigs, samples and sample sets, and of labels of any other grouping by its name."""

    contigs: tuple[str, ...] | None = None
    samples: tuple[str, ...] | None = None
    sample_sets: tuple[str, ...] | None = None
    others: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def __post_init__(self):
        for names in (self.contigs, self.samples, self.sample_sets):
            self._names(names)
        dims = [d for d, _ in self.others]
        if len({*dims, SAMPLE, SAMPLE_SET}) != len(dims) + 2:
            raise ValueError("a dimension is selected twice")

    @staticmethod
    def _names(names: Sequence[str] | None) -> tuple[str, ...] | None:
        if isinstance(names, str):
            raise TypeError("a sequence of names is asked for, not one name")
        return None if names is None else tuple(names)

    def with_contigs(self, names):
        return replace(self, contigs=self._names(names))

    def with_samples(self, names):
        return replace(self, samples=self._names(names))

    def with_sample_sets(self, names):
        """None, or a list with ALL, takes the restriction away."""
        names = self._names(names)
        return replace(self, sample_sets=None if names is None or ALL in names else names)

    def with_columns(self, dim: str, names):
        """Replaces what is selected on a dimension; None takes the restriction away."""
        if dim == SAMPLE:
            return self.with_samples(names)
        if dim == SAMPLE_SET:
            return self.with_sample_sets(names)
        names = self._names(names)
        rest = tuple(x for x in self.others if x[0] != dim)
        return replace(self, others=rest if names is None else (*rest, (dim, names)))

    def resolve(self, genome: Genome, grouping: Grouping | dict[str, Grouping], column_dim: str = SAMPLE) -> Resolved:
        """What this selects of a track with these groupings (one alone is that of sample sets), whose columns are a ``column_dim``.

        Each dimension that is selected allows some columns, and a column is
        kept if all of them allow it.  The track's own dimension allows its
        labels, a grouping the members of its sets.  What the track has
        neither of allows all, but a track of samples that is asked for sample
        sets must have some.
        """
        groupings = {SAMPLE_SET: grouping} if isinstance(grouping, Grouping) else grouping
        labels = next((g.columns for g in groupings.values()), ())
        allows = {dim: dict(g.sets) for dim, g in groupings.items()} | {column_dim: {c: {c} for c in labels}}
        asked = {SAMPLE: self.samples, SAMPLE_SET: self.sample_sets, **dict(self.others)}
        asked = {dim: names for dim, names in asked.items() if names is not None}
        if SAMPLE_SET in asked and SAMPLE_SET not in allows and column_dim == SAMPLE:
            raise ValueError("this track has no sample sets")
        keep = set(labels)
        for dim in asked.keys() & allows.keys():
            if unknown := sorted(set(asked[dim]) - set(allows[dim])):
                raise ValueError(f"unknown {dim.replace('_', ' ')}s: {', '.join(unknown)}")
            keep &= set().union(*(allows[dim][n] for n in asked[dim]))
        return Resolved(tuple(genome.resolve(self.contigs)), tuple(c for c in labels if c in keep), genome.size)


@dataclass(frozen=True)
class Resolved:
    intervals: tuple[tuple[int, int], ...]
    columns: tuple[str, ...]
    genome_size: int = field(default=0)

    @property
    def n_positions(self) -> int:
        return sum(b - a for a, b in self.intervals)

    @property
    def active_per_cent(self) -> float:
        """Of the genome, with two digits; 0 of an empty one."""
        return round(self.n_positions / self.genome_size * 100, 2) if self.genome_size else 0.0

    def stride(self, max_positions: int) -> int:
        n = self.n_positions
        return -(-n // max_positions) if 0 < max_positions < n else 1
