"""Stores: a folder of Parquet tracks under a catalog of versions.

A track is wide: pos, contig_idx, lpos and a column c0, c1, ... for each label.
Of more than ARRAY_FROM labels it has one array column instead, which code made
for columns couldn't handle; sets are then summed in numpy, a batch at a time.
Data are never overwritten: what is written goes to a folder of its own.  A
commit publishes the next version of the catalog, one JSON text of all entries
(labels, genome, groupings, folders and, for summaries, which version of which
track and which grouping they were made of), so entries that belong together
appear together, and an open store goes on reading the version that it opened.
Who finds the next version taken reads it and tries again, unless what its
work was made of has changed.

The catalog is small and is read and written through Spark, so a store may lie
on any file system that Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import track as T
from ..plans.selection import IDENTITY, SAMPLE_SET, Genome, Grouping

# Defaults of the data model; the environment may give others.
TARGET_BYTES = int(os.environ.get("BASETRACK_TARGET_BYTES", 100_000_000))
MIN_POSITIONS = int(os.environ.get("BASETRACK_MIN_POSITIONS", 100_000))
FORMAT = 2
INHERITED = ("version", "coordinates", "genome_checksum")
ATTEMPTS = 20
# positions that a task sorts, at most, where no size of files is given
MOST_SORTED = 1 << 20
# labels beyond which a track is stored as arrays
ARRAY_FROM = 1000
ARRAY = "cells"


class StoreNotFoundError(FileNotFoundError):
    pass


class MissingSummaryError(LookupError):
    pass


class StaleSummaryError(MissingSummaryError):
    """The summaries there are were made of an earlier version of the track, or with other sample sets."""


class CatalogConflictError(RuntimeError):
    """Another commit changed what this one was made of."""


def positions_per_chunk(n_columns: int, item_size: int = 4, target_bytes: int = TARGET_BYTES, least: int = MIN_POSITIONS) -> int:
    if n_columns < 1 or item_size < 1:
        raise ValueError("a chunk has one column and one byte an item at least")
    return max(least, target_bytes // (n_columns * item_size))


@dataclass
class Entry:
    """What the catalog says of a track."""

    name: str
    labels: list[str]
    contigs: list[str]
    offsets: list[int]
    column_dim: str = "sample"
    groupings: dict[str, list] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    # the folder of the data and the stored column of each label
    data: str | None = None
    columns: list[str] | None = None
    # another one whenever the data are written
    version: str = ""

    @property
    def genome(self) -> Genome:
        return Genome(tuple(self.contigs), tuple(self.offsets))

    def grouping(self, dim: str = "sample_set") -> Grouping:
        """The stored grouping, or the one set ALL."""
        sets = self.groupings.get(dim, []) if dim != IDENTITY else []
        return Grouping(tuple(self.labels), tuple((n, frozenset(m)) for n, m in sets)).with_all()

    def all_groupings(self) -> dict[str, Grouping]:
        """Every stored grouping, and identity, the one set ALL, unless the columns themselves are of that name."""
        out = {dim: self.grouping(dim) for dim in self.groupings}
        return out if self.column_dim == IDENTITY else out | {IDENTITY: self.grouping(IDENTITY)}

    def made_of(self, source: Entry) -> bool:
        """Whether this summary has the numbers of a track as it is now."""
        own = self.attributes
        return own.get("source_track") == source.name and own.get("source_version") == source.version and own.get("grouping_hash") == source.grouping().digest()

    def stored(self) -> list[str]:
        return self.columns or [f"c{i}" for i in range(len(self.labels))]

    def cells(self) -> list[Column]:
        """Of stored rows: a column for each label."""
        if self.columns == [ARRAY]:
            return [F.get(ARRAY, F.lit(i)).alias(c) for i, c in enumerate(self.labels)]
        return [F.col(k).alias(c) for k, c in zip(self.stored(), self.labels)]


class Store:
    """A version of a store; ``entries`` are those of that version."""

    def __init__(self, spark: SparkSession, path: str, entries: dict[str, Entry], version: int = 0):
        self.spark, self.path, self.entries, self.version = spark, path.rstrip("/"), entries, version

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Store:
        """A store to write to; what is there already is kept."""
        out = cls(spark, path, {})
        return out.refresh()

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Store:
        out = cls(spark, path, {}).refresh(version)
        if not out.entries:
            raise StoreNotFoundError(path)
        return out

    def refresh(self, version: int | None = None) -> Store:
        """Reads the newest version, or an older one that is still there."""
        self.version, self.entries = self._published(version)
        return self

    def versions(self) -> list[int]:
        return sorted(self._catalogs())

    def _catalogs(self) -> dict[int, list[str]]:
        """The files of each version.  What was never finished has none."""
        try:
            files = self.spark.read.text(f"{self.path}/_catalog/*").inputFiles()
        except AnalysisException:
            return {}
        out: dict[int, list[str]] = {}
        for f in files:
            out.setdefault(int(f.rsplit("/", 2)[1]), []).append(f)
        return out

    def _published(self, version: int | None = None) -> tuple[int, dict[str, Entry]]:
        files = self._catalogs()
        if not files or version is not None and version not in files:
            return 0, {}
        newest = max(files) if version is None else version
        # two writers may have passed the check for the folder together; then the first file by name counts
        text = json.loads(self.spark.read.text(min(files[newest])).first()[0])
        return newest, {e["name"]: Entry(**e) for e in text["entries"]}

    def commit(self, *changes: Entry, of: Sequence[Entry] = ()) -> None:
        """Publishes ``changes`` together as the next version, unless one of the entries ``of`` which they were made has changed since."""
        for _ in range(ATTEMPTS):
            version, entries = self._published()
            for e in of:
                now = entries.get(e.name)
                if now is None or (now.version, now.groupings) != (e.version, e.groupings):
                    raise CatalogConflictError(f"{e.name} has been changed meanwhile")
            entries |= {e.name: e for e in changes}
            if len({(tuple(e.contigs), tuple(e.offsets)) for e in entries.values()}) > 1:
                raise ValueError("the tracks of a store have one genome")
            entries, writer = dict(sorted(entries.items())), uuid.uuid4().hex
            text = json.dumps({"version": version + 1, "writer": writer, "entries": [e.__dict__ for e in entries.values()]})
            row = self.spark.createDataFrame([(text,)], "value string")
            try:
                row.coalesce(1).write.mode("errorifexists").text(f"{self.path}/_catalog/{version + 1:012d}")
            except AnalysisException:  # taken
                continue
            if json.loads(self.spark.read.text(min(self._catalogs()[version + 1])).first()[0])["writer"] == writer:
                self.version, self.entries = version + 1, entries
                return
        raise CatalogConflictError(f"{self.path} is being changed by others")

    def base(self) -> Entry:
        """The first track by name that has samples, else the first."""
        return next((e for e in self.entries.values() if e.column_dim == "sample"), next(iter(self.entries.values())))

    def write(self, entry: Entry, rows: DataFrame, mode: str = "overwrite", chunk_size: int | None = None) -> None:
        """rows: pos, contig_idx, lpos and one column per label, named by label; chunk_size: positions of a file.

        Written again, a track is a new version of itself; summaries of the
        old one stay, but aren't used for the new one.
        """
        if len(set(entry.labels)) != len(entry.labels):
            raise ValueError("a label is repeated")
        if mode != "overwrite" and entry.name in self._published()[1]:
            raise FileExistsError(entry.name)
        size = min(MOST_SORTED, positions_per_chunk(max(1, len(entry.labels)))) if chunk_size is None else chunk_size
        if size < 1:
            raise ValueError("a chunk has one position at least")
        n = max(1, -(-entry.genome.size // size))
        checksum = hashlib.md5("|".join(map(str, [*entry.contigs, *entry.offsets])).encode()).hexdigest()
        version = uuid.uuid4().hex
        cells = [F.col(f"`{c}`") for c in entry.labels]
        as_array = len(cells) > ARRAY_FROM
        cells = [F.array(*cells).cast("array<int>").alias(ARRAY)] if as_array else [c.alias(f"c{i}") for i, c in enumerate(cells)]
        sorted_rows = rows.select("pos", "contig_idx", "lpos", *cells).repartitionByRange(n, "pos").sortWithinPartitions("pos")
        data = f"{entry.name}-{version}"
        sorted_rows.write.mode("errorifexists").parquet(f"{self.path}/{data}")
        attributes = {"version": FORMAT, "coordinates": "0-based half-open", "genome_checksum": checksum} | entry.attributes | {"written_ns": time.time_ns()}
        self.commit(replace(entry, attributes=attributes, data=data, columns=[ARRAY] if as_array else None, version=version))

    def stored_rows(self, name: str) -> DataFrame:
        """The table that a track is columns of, as it is stored."""
        return self.spark.read.parquet(f"{self.path}/{self.entries[name].data}")

    def read(self, name: str) -> DataFrame:
        """contig, contig_idx, len, lpos, pos and a column for each label."""
        e = self.entries[name]
        return self.stored_rows(name).select(*self.axis(), *e.cells())

    def axis(self) -> list[Column]:
        """contig, contig_idx, len, lpos and pos of stored rows."""
        lengths = list(self.base().genome.lengths().items())
        names = F.array(*[F.lit(c) for c, _ in lengths])
        sizes = F.array(*[F.lit(n).cast("long") for _, n in lengths])
        return [F.get(names, F.col("contig_idx")).alias("contig"), F.col("contig_idx"), F.get(sizes, F.col("contig_idx")).alias("len"), F.col("lpos"), F.col("pos")]

    def column(self, name: str, label: str) -> DataFrame:
        """pos and one column of a track; an unknown label is a KeyError."""
        if label not in self.entries[name].labels:
            raise KeyError(label)
        return self.read(name).select("pos", F.col(f"`{label}`"))

    def _grouped(self, e: Entry, grouping: Grouping, dim: str) -> Entry:
        if dim == IDENTITY:
            raise ValueError("identity is reserved")
        if dim == e.column_dim:
            raise ValueError(f"{dim} is what the columns of {e.name} are")
        if list(grouping.columns) != e.labels:
            raise ValueError("a grouping names its track's columns in the same order")
        return replace(e, groupings=e.groupings | {dim: [[n, sorted(m)] for n, m in grouping.with_all().sets]})

    def set_grouping(self, name: str, grouping: Grouping, dim: str = "sample_set") -> None:
        e = self.entries[name]
        self.commit(self._grouped(e, grouping, dim), of=[e])

    def preprocess(self, name: str, grouping: Grouping | None = None, cutoffs: Sequence[int] = (3,), sums: bool = True) -> list[str]:
        """Summary tracks of all sets and cutoffs, made by one scan without a shuffle and written as one table; each track is columns of it.

        The grouping, if given, and the summaries are published together.
        """
        before = self.entries[name]
        e = before if grouping is None else self._grouped(before, grouping, SAMPLE_SET)
        if grouping is None and len(e.groupings) > 1:
            raise ValueError(f"{name} has several groupings; name one")
        g = e.grouping()
        sets, cells, metrics, entries = g.members(), [], [], []
        kept = {k: e.attributes[k] for k in INHERITED if k in e.attributes}
        jobs = [("sum", None, f"{name}_sum")] * sums + [("missing", k, f"{name}_missing_cutoff={k}") for k in sorted(set(cutoffs))]
        version = uuid.uuid4().hex
        data = f"_summaries/{name}-{version}"
        for kind, k, summary in jobs:
            columns = [f"c{len(cells) + i}" for i in range(len(sets))]
            metrics.append(k)
            cells += [(T.total(c) if kind == "sum" else T.missing(c, k)).alias(x) for x, c in zip(columns, sets.values())] if e.columns != [ARRAY] else columns
            attributes = kept | {"source_track": name, "source_version": e.version, "kind": kind, "missing_cutoff": k, "grouping_hash": g.digest(), "written_ns": time.time_ns()}
            entries.append(Entry(summary, list(sets), e.contigs, e.offsets, SAMPLE_SET, {}, attributes, data, columns, version))
        axis = ("pos", "contig_idx", "lpos")
        rows = T.array_summaries(self.stored_rows(name).select(*axis, ARRAY), g, metrics) if e.columns == [ARRAY] else self.read(name).select(*axis, *cells)
        rows.write.parquet(f"{self.path}/{data}")
        self.commit(e, *entries, of=[before])
        return [entry.name for entry in entries]

    def summaries(self, source: str) -> dict[int | None, Entry]:
        """The summaries that have the numbers of a track as it is now: that of sums under None, the others by cutoff; of several the first by name."""
        out: dict[int | None, Entry] = {}
        for _, e in sorted(self.entries.items()):
            if e.made_of(self.entries[source]):
                out.setdefault(e.attributes["missing_cutoff"], e)
        return out

    def summary(self, source: str, kind: str, cutoff: int | None = None) -> str:
        """The first summary by name of this kind that was made of the track as it is; warns of others."""
        of_kind = [e for _, e in sorted(self.entries.items()) if e.attributes.get("source_track") == source and e.attributes.get("kind") == kind]
        fits = [e for e in of_kind if e.attributes["missing_cutoff"] == cutoff]
        fresh = [e.name for e in fits if e.made_of(self.entries[source])]
        if not fits:
            have = sorted({str(e.attributes["missing_cutoff"]) for e in of_kind})
            raise MissingSummaryError(f"{source} has no {kind} summary for cutoff {cutoff}; it has: {', '.join(have) or 'none'}")
        if not fresh:
            raise StaleSummaryError(f"{', '.join(e.name for e in fits)}: {source} or its sample sets have changed since; preprocess it again")
        if len(fits) > 1:
            warnings.warn(f"{source} has several {kind} summaries; {fresh[0]} is used", stacklevel=2)
        return fresh[0]

    def identity(self) -> str:
        """Of the path, when the base track was written, and its sets."""
        base = self.base()
        return hashlib.blake2b(f"v1|{self.path}|{base.attributes.get('written_ns')}|{base.grouping().digest()}".encode(), digest_size=16).hexdigest()

    def vacuum(self, older_than_s: float = 86_400) -> list[str]:
        """Deletes data and versions that the newest version doesn't use and that are old enough for no writer to be about to publish them; returns their paths.

        Who still has an older version open can't read it any more.
        """
        files = self.spark._jvm.org.apache.hadoop.fs
        root = files.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest, entries = self._published()
        used = {e.data for e in entries.values()} | {f"_catalog/{newest:012d}"}
        gone = []
        for folder in ("", "_summaries", "_catalog"):
            at = files.Path(root, folder) if folder else root
            for status in fs.listStatus(at) if fs.exists(at) else []:
                path = f"{folder}/{status.getPath().getName()}".lstrip("/")
                if path not in used | {"_summaries", "_catalog"} and status.getModificationTime() < (time.time() - older_than_s) * 1000:
                    fs.delete(status.getPath(), True)
                    gone.append(path)
        return gone
