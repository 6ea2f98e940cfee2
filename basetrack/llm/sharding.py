"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Documents of equal text are one indivisible group.  A partial partition is a
vector of ``shards`` sums; two are combined by adding the largest sum of the
one to the smallest of the other, and so on, and the two with the largest
spread are combined first, until one is left.

At scale groups are dealt by hash into parts of at most about ``block_size``,
and each part is differenced, in parallel, into an eighth as many bundles of
nearly equal bytes; these are the items of the next round, until one task takes
all that are left and differences them into the shards.  An eighth of a part's
worth of each round's items isn't bundled but goes straight into that last
differencing, so that it has items of every size, single groups included, and
levels out what the bundles leave.  So every group takes part in differencing,
at every size by the same method, and a group that is itself larger than a
shard's share (a third of all rows may be copies of one text) stays alone in its
bundle and still meets bundles that can make up for it.

The slot of a row in its shard is gapless: rows are numbered within (shard,
bucket of the hashed doc_id), and the counts of those cells give the offsets,
so no task sorts a whole shard.

The law that holds is ``bytes``: the sums of sizes are as near equal as whole
groups allow.

Rows: null texts have no bytes and group with empty ones; repeated rows are
rows of one group, each with its own slot; null doc_ids are placed like any
other; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hot_left_join, shuffle_partitions, text_or_empty

SHARDS = 40
BLOCK_SIZE = 10_000
FAN_IN = 8
OVERHEAD = 16


def difference_groups(weights: list[int], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Final sums and the shard of each weight, by differencing.  Ties go to what came first."""
    n = len(weights)
    # a single weight is a vector with one place that isn't zero, and made one only when it is combined
    sums: list[int | np.ndarray | None] = list(weights)
    heap = [(-w if shards > 1 else 0, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    kind = np.int16 if shards <= np.iinfo(np.int16).max else np.int32

    def ordered(i: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector in order, and for each of its places where that stands in the order; of a single weight only for its own."""
        v = sums[i]
        if i < n:
            out = np.zeros(shards, dtype=np.int64)
            at = 0 if sign < 0 else shards - 1
            out[at] = v
            return out, np.array([at], dtype=kind)
        order = np.argsort(sign * v, kind="stable")
        at = np.empty(shards, dtype=kind)
        at[order] = np.arange(shards, dtype=kind)
        return v[order], at

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (down, at_a), (up, at_b) = ordered(a, -1), ordered(b, 1)
        both = down + up
        children.append((a, at_a, b, at_b))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(both.max() - both.min()), len(sums)))
        sums.append(both)
    if not children:
        total = np.zeros(shards, dtype=np.int64)
        total[:n] = weights
        return total, np.zeros(n, dtype=np.int64)
    places: list[np.ndarray | None] = [None] * len(sums)
    places[-1] = np.arange(shards, dtype=kind)
    for i in range(len(sums) - 1, n - 1, -1):
        a, at_a, b, at_b = children[i - n]
        places[a], places[b] = places[i][at_a], places[i][at_b]
        places[i] = None
    return sums[-1], np.concatenate(places[:n]).astype(np.int64)


def _placed(places: int):
    """Differences the items (part, item, bytes) of a part; place: where each goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        _, at = difference_groups(pdf["bytes"].tolist(), places)
        return pdf.assign(place=at.astype(np.int64))[["part", "item", "bytes", "place"]]

    return run


def assign(groups: DataFrame, shards: int = SHARDS, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(digest, shard) of ``groups`` (digest, bytes), one row for each digest."""
    few = max(2, block_size // FAN_IN)
    rounds, single, items = [], [], checkpointed(groups.select(F.col("digest").alias("item"), "bytes"))
    while (n := items.count()) > block_size:
        stays = F.pmod(F.xxhash64("item", F.lit(len(rounds))), F.lit(n)) < few
        single.append(items.where(stays))
        parts = -(-n // block_size)
        dealt = items.where(~stays).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
        placed = checkpointed(dealt.groupBy("part").applyInPandas(_placed(few), "part long, item string, bytes long, place long"))
        placed = placed.withColumn("bundle", F.concat_ws("/", F.lit(len(rounds)), "part", "place"))
        rounds.append(placed.select("item", "bundle"))
        items = checkpointed(placed.groupBy(F.col("bundle").alias("item")).agg(F.sum("bytes").alias("bytes")))
    for more in single:
        items = items.unionByName(more)
    last = items.withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInPandas(_placed(shards), "part long, item string, bytes long, place long")
    found = checkpointed(last.select("item", F.col("place").cast("int").alias("shard")))
    for bundles in reversed(rounds):
        found = found.unionByName(bundles.join(found.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard"))
    # names of bundles are in it too, and no digest is like one
    return found.select(F.col("item").alias("digest"), "shard").join(groups.select("digest"), "digest")


def sharded(docs: DataFrame, shards: int = SHARDS, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    shard_of = groups.select("digest", "rows").join(assign(groups, shards, block_size), "digest")
    put = checkpointed(hot_left_join(rows, shard_of, "digest", "rows", rows.count(), "doc_id").select("doc_id", "size", "text_crc32", "shard"))
    buckets = shuffle_partitions(docs.sparkSession)
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    put = put.withColumn("bucket", cell)
    counts = put.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = put.withColumn("number", within)
    return numbered.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
