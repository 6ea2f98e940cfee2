"""WARC archives of captures, and their index in global order by external merge.

Writing: captures with equal payloads of at least ``REVISIT_BYTES`` bytes are
one response, that with the smallest page_id, and revisits that refer to it.
Each record is a gzip member of its own, and members are packed into archives of
about ``ARCHIVE_BYTES``, or of one record that is longer.  Spark's own text
writer writes the archives, one a file, with its commit protocol and on any file
system that Spark reaches: its line separator is the last byte of the last
member, which is always zero.

Reading: archives are cut at record boundaries by gzip member and
Content-Length, never by searching for a separator, as payloads may hold
anything; one record at a time is inflated.  Digests and lengths come from the
payloads read back; a revisit's come from the response it names.  The index says
archive, offset and length of each record, so ``capture`` reads one alone.

Index: each task sorts its captures by (URL key, timestamp, page_id, archive,
offset) and writes them, a run, in pieces that are cut where the ranges of the
whole key end; the ranges come from a sample of keys whose size depends on their
number alone.  A range's pieces are then dealt to one task, which merges the
runs with a k-way loser tree (log k comparisons a row); rows aren't sorted
again.  The ranges in order are the global capture history.  The key is unique,
so a URL or host with a third of all captures is divided too.

Rows: a null html is an empty payload, a null url an empty URI; a page_id that
is repeated with one payload gives a row each time, and as they are one page
these are all responses or all revisits; rows without page_id are written with
the id ``NO_ID``, which no page may have, and come last.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, checkpointed, hot_left_join, new_folder, shuffle_partitions, written

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32_000_000
# bytes of a record in a gzip member; a longer record is of several, and the length of none has a fourth byte
MEMBER_BYTES = 8_000_000
# captures of a range of the index, about, and of a piece of a run, at most
RANGE_ROWS = 200_000
PIECE_ROWS = 10_000
# keys that are sampled for each range
SAMPLED = 50
NO_ID = (1 << 63) - 1
EPOCH = 1_600_000_000


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: host labels reversed, then the path, without scheme, user, fragment or a leading www."""
    rest = F.regexp_replace(F.lower(F.regexp_replace(url, "#.*$", "")), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?", "")
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    path = F.substr(rest, F.char_length(host) + 1)
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^.*@|:\d+$", ""), r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.when(path == "", "/").otherwise(path))


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, timestamp, first) of every row; first: the response's page_id if the payload is long enough."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    seconds = F.when(F.col("page_id") == NO_ID, F.lit(EPOCH)).otherwise(F.lit(EPOCH) + F.pmod("page_id", F.lit(1_000_000_000)))
    return rows.withColumn("timestamp", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def records(pages: DataFrame) -> DataFrame:
    """(value): the WARC record of every row of ``pages``."""
    rows = captures(pages)
    long = F.col("payload_bytes") >= REVISIT_BYTES
    # copies of a payload meet by digest
    groups = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = checkpointed(groups.where("copies > 1"))
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if 5 * n <= MOST_SENT:  # a digest is as long as four of the numbers that this is meant for
        rows = rows.join(F.broadcast(groups.drop("copies")), "digest", "left")
    else:
        rows = hot_left_join(rows, groups, "digest", "copies", total, "page_id", "url")
    revisit = long & F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "")
    head = lambda kind: F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:"),
        F.col("page_id").cast("string"),
        F.lit(">\r\nWARC-Date: "),
        "timestamp",
        F.lit("\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        "digest",
    )
    response = F.concat(head("response"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"), "payload", F.lit("\r\n\r\n"))
    again = F.concat(
        head("revisit"),
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
        F.col("first").cast("string"),
        F.lit(">\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    )
    return rows.select(F.when(revisit, again).otherwise(response).alias("value"))


def members(record: bytes) -> bytes:
    """A record as gzip members; the last byte is zero."""
    out = []
    for start in range(0, len(record), MEMBER_BYTES):
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(deflate.compress(record[start : start + MEMBER_BYTES]) + deflate.flush())
    return b"".join(out)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """WARC files (gzip members) of all rows of ``pages``, one for each row of this map."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = bytearray()
        row = lambda: pa.record_batch([pa.array([bytes(archive[:-1])], pa.binary())], names=["value"])
        for batch in batches:
            for record in batch.column(0):
                data = members(record.as_py())
                if archive and len(archive) + len(data) > archive_bytes:
                    yield row()
                    archive.clear()
                archive += data
        if archive:
            yield row()

    packed = records(pages).select(F.col("value").cast("binary")).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


field = re.compile(rb"^([^:\r\n]+): *([^\r\n]*)\r?$", re.M)


def inflated(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, out, start = zlib.decompressobj(31), [], at
        while not inflate.eof:
            part = view[at : at + 65_536]
            if not part:
                raise ValueError(f"an archive ends within the member at byte {start}")
            out.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield start, at - start, b"".join(out)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of each record of an archive."""
    offset = length = 0
    record = b""
    for start, n, content in inflated(data):
        offset, length, record = (offset, length + n, record + content) if record else (start, n, content)
        head = record.index(b"\r\n\r\n")
        headers = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in field.findall(record[:head])}
        stop = head + 4 + int(headers["content-length"])
        if len(record) < stop + 4:
            continue
        if record[stop:] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {offset} doesn't end where its length says")
        yield offset, length, headers, record[head + 4 : stop]
        record = b""
    if record:
        raise ValueError(f"an archive ends within the record at byte {offset}")


def capture(data: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that the index has at this place of an archive."""
    return next(parse(data[offset : offset + length]))[2:]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for offset, length, h, payload in parse(content.as_py()):
                page = int(h["warc-record-id"].rpartition(":")[2].rstrip(">"))
                refers = h.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
                response = h["warc-type"] == "response"
                digest = hashlib.sha256(payload).hexdigest() if response else h["warc-payload-digest"].rpartition(":")[2]
                rows.append((h["warc-target-uri"], h["warc-date"], page, h["warc-type"], int(refers) if refers else None, len(payload) if response else None, digest, path, offset, length))
            for start in range(0, len(rows), PIECE_ROWS):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[start : start + PIECE_ROWS]), READ_TYPES)], names=READ_NAMES)


READ = "url string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
READ_NAMES = [f.split()[0] for f in READ.split(", ")]
READ_TYPES = [pa.int64() if f.endswith("long") else pa.string() for f in READ.split(", ")]


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record of the archives in a folder; payload_bytes is null for revisits."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_index_rows, READ)


class LoserTree:
    """Merges k sorted iterators; each step replays one path of log k comparisons."""

    END = None

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, self.END) for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; an ended run goes last, ties go to the earlier run."""
        x, y = self.heads[a], self.heads[b]
        if x is self.END or y is self.END:
            return y is self.END and (x is not self.END or a < b)
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # the first to come here waits for the other side
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (head := self.heads[winner := self.losers[0]]) is not self.END:
            yield head
            self.heads[winner] = next(self.runs[winner], self.END)
            self._play(winner)


INDEX_SORTED = ["url_key", "timestamp", "page_id", "archive", "offset", "length", "record_type", "refers_to", "payload_bytes", "payload_digest"]
SORTED = "url_key string, timestamp string, page_id long, archive string, offset long, length long, record_type string, refers_to long, payload_bytes long, payload_digest string"
SORTED_TYPES = [pa.int64() if f.endswith("long") else pa.string() for f in SORTED.split(", ")]
# as many of these columns, from the first, are the key
KEY = INDEX_SORTED[:5]
PIECES = "range long, run long, piece long, rows binary"


class _Keyed:
    """Pairs of key and row that compare by key alone."""

    def __init__(self, pairs: Iterator[tuple]):
        self.pairs = pairs

    def __iter__(self) -> Iterator[tuple]:
        return (_Pair(p) for p in self.pairs)


class _Pair(tuple):
    __slots__ = ()

    def __lt__(self, other):
        return self[0] < other[0]

    def __eq__(self, other):
        return self[0] == other[0]

    __hash__ = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), SORTED_TYPES)], names=INDEX_SORTED)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _pieces(ends: list[tuple]):
    """Cuts a task's sorted rows, its run, where ranges end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place = TaskContext.get().partitionId(), 0

        def piece(within: int, rows: list[tuple]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            batch = _batch(rows)
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            values = [pa.array([v], pa.int64()) for v in (within, number, place)]
            return pa.record_batch([*values, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range", "run", "piece", "rows"])

        for batch in batches:
            for within, rows in groupby(_rows(batch), lambda r: bisect_right(ends, r[: len(KEY)])):
                rows = list(rows)
                for start in range(0, len(rows), PIECE_ROWS):
                    yield piece(within, rows[start : start + PIECE_ROWS])
                    place += 1

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each range; pieces come in order of (range, run, piece)."""

    def read(pieces: list[bytes]) -> Iterator[tuple]:
        for data in pieces:
            with pa.ipc.open_stream(data) as stream:
                for batch in stream:
                    yield from ((r[: len(KEY)], r) for r in _rows(batch))

    given = ((r, run, data.as_py()) for b in batches for r, run, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)))
    for _, of_range in groupby(given, lambda x: x[0]):
        runs = [[data for *_, data in of_run] for _, of_run in groupby(of_range, lambda x: x[1])]
        out: list[tuple] = []
        # keys alone are compared: nulls stand only in later columns
        for _, row in LoserTree([iter(_Keyed(read(pieces))) for pieces in runs]):
            out.append(row)
            if len(out) == PIECE_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def merged_index(index: DataFrame) -> DataFrame:
    """``index`` (columns of SORTED) in global order by KEY: partitions are ranges, in order."""
    spark = index.sparkSession
    n = index.count()
    ranges = max(shuffle_partitions(spark), math.ceil(n / RANGE_ROWS))
    sample = index.select(*KEY).sample(min(1.0, SAMPLED * ranges / max(n, 1)), seed=1)
    keys = sorted(map(tuple, sample.collect()))
    ends = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    runs = written(index.select(*INDEX_SORTED).sortWithinPartitions(*KEY).mapInArrow(_pieces(ends), PIECES), "runs")
    dealt = runs.repartitionByRange(ranges, "range").sortWithinPartitions("range", "run", "piece")
    return dealt.mapInArrow(_merge, SORTED)


def archived(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns their merged index (columns of SORTED).

    ``path`` is a new folder; by default one in the shared checkpoint folder.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, archive_bytes)
    read = written(read_archives(spark, path), "captures")
    # revisits take the length of the response they name; its id may have been given to several pages
    source = lambda i: F.concat_ws(" ", i, "payload_digest")
    revisits = read.where("refers_to is not null").groupBy(source("refers_to").alias("source")).agg(F.count(F.lit(1)).alias("revisits"))
    responses = read.where("refers_to is null").select(source("page_id").alias("source"), "payload_bytes")
    lengths = checkpointed(revisits.join(responses, "source").groupBy("source", "revisits").agg(F.max("payload_bytes").alias("source_bytes")))
    rows = read.withColumn("source", F.when(F.col("refers_to").isNotNull(), source("refers_to")))
    rows = hot_left_join(rows, lengths, "source", "revisits", read.count(), "archive", "offset").withColumn("payload_bytes", F.coalesce("payload_bytes", "source_bytes"))
    return merged_index(checkpointed(rows.select(url_key(F.col("url")).alias("url_key"), *INDEX_SORTED[1:])))


def query(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and the place in the history and the archives."""
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return archived(pages).select(own("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to"), "url_key", "timestamp", "archive", "offset", "length")
