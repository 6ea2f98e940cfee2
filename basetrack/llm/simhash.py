"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits have a point between
them that is one step from the one and at most two steps from the other, so
both meet on it if each sends out the variants within half the radius.  Three
facts keep the number of variants small and lose no link:

* for two or fewer differing bits, one step from each side is enough;
* for three, the two ends have different parity, so only the fingerprints with
  an even number of set bits send out variants two steps away;
* of three differing bits two lie in the same 32-bit half, so those pairs of
  bits are enough (by Mantel's theorem no smaller set of pairs is).

An even fingerprint sends 1 + 64 + 992 variants and an odd one 1 + 64.
Identical fingerprints are merged first, so a bucket holds at most the ball of
a variant (2,081 fingerprints) however many copies a text has.  Within a
bucket all that are one step away are within two bits of each other and within
three of those that are two steps away, so a star around the smallest of the
former connects exactly what the bucket connects: no pairs are enumerated.
Every link is verified by counting bits, and links are deduplicated.

``near_dedup`` is for texts that share 80 % of their five-word shingles, whose
fingerprints differ in about 15 % of their bits: no ball around 64 bits holds
them.  It makes a wide fingerprint of 16 bands of 32 bits and hashes the balls
of each band, at radius 2, by the same meeting in the middle; what a band
brings together is verified by the exact Jaccard similarity of the whole sets
of shingle hashes, long ones in pieces, before it is a link; all 512 bits only
sort out what is far away.  Of the smallest ones of its buckets a text is first
compared with the one that it meets most often, then, unless that has joined
them, with the next few (``centers``).  Where buckets still hold several components (``strangers``) the texts
outside of the largest of them are compared with all others there, in chunks of texts:
a task indexes the hashes of a chunk and counts what each outsider shares
with all of it at once, so no pair of texts is a row.  That finds every link that is left, so how
many centers are tried before decides what it costs and not what is linked.  A band meets with probability
0.12, 0.20, 0.34 and 0.59 at similarities of 0.8, 0.85, 0.9 and 0.95, one of 16
with 0.87, 0.97, 0.999 and 1.  Beside them each text has 24 keys of six
min-hashes that meet their equals: one of them with 0.9993, 0.99999 and more,
so of two texts at 0.8 that no other connects about one pair in 10^4 is
missed (calculated).  Bands of 32 bits fill up beyond some 10^8
distinct texts, where strangers would become the centers of buckets; bits=40
and bands=20 serve 10^10 of them (0.87 at 0.85, 0.99 at 0.9).

Rows: null texts count as empty; texts without words have fingerprint zero and
are linked like any other; repeated rows each give a row; a null doc_id is kept
and takes no part in the choice of the smallest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from .common import checkpointed, hot_left_join, sent_if_few, shuffle_partitions, unused, written
from .components import connected_components

SEED = 42
RADIUS = 3
# words of a text that are hashed at a time, so a very long text needs little memory
BLOCK_WORDS = 200_000
# near_dedup: words of a shingle, similarity, and the bands of a wide fingerprint
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
BITS = 32
# standard deviations beyond the expected distance that the prefilter of the exact comparison lets pass
DEVIATIONS = 4
# hashes of a set in a row, about
PIECE = 1 << 16
# hashes of a chunk of texts that are compared at once, about, and texts of one whose fingerprints are
CHUNK = 1 << 18
CHUNK_NODES = 1 << 12
# smallest nodes of its buckets that a node is compared with before whole places are
CENTERS = 4
# keys of min-hashes beside the bands, and min-hashes of a key
HASH_KEYS = 24
HASH_ROWS = 6


def simhash(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text.

    ASCII letters are lower-cased, words are runs of other than white space,
    each shingle of ``shingle`` words counts as often as it occurs, and a bit
    is set if it is set in over half of the hashes.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK_WORDS):
        stop = min(n, start + BLOCK_WORDS)
        part = [words[start + k : stop + k] for k in range(shingle)]
        grams = map(join, zip(*part)) if len(words) >= shingle else [join(words)]
        hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[tuple[int, list[int], list[int]]]:
    """(parity, masks that change the upper half or nothing, masks that change the lower half or nothing), as signed longs."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def half(start: int, pairs: bool) -> list[int]:
        bits = range(start, start + 32)
        one = [1 << i for i in bits]
        two = [(1 << i) | (1 << j) for i in bits for j in bits if i < j] if pairs else []
        return [signed(x) for x in [0, *one, *two]]

    return [(0, half(32, True), half(0, True)), (1, half(32, False), half(0, False))]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): distinct fingerprints within three bits, enough of them to connect all that are.

    ``distinct`` has a column fp without repetition.  A variant changes one of
    the halves at most, so variants are dealt by their upper half: those that
    change the lower half need no row of their own in the shuffle but are made
    behind it, from the one row that carries the unchanged fingerprint.
    """
    spark = distinct.sparkSession
    masks = spark.createDataFrame(_masks(), "parity int, upper array<long>, lower array<long>")
    # few bytes become many rows, so the fingerprints are dealt over all tasks
    rows = distinct.repartition(shuffle_partitions(spark)).select("fp", (F.bit_count("fp") % 2).cast("int").alias("parity"))
    sent = rows.join(F.broadcast(masks), "parity").select("fp", F.explode("upper").alias("mask"))
    sent = sent.select("fp", F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("mask")), 32).alias("upper"), F.col("fp").bitwiseXOR(F.col("mask")).alias("sent"))
    dealt = sent.repartition("upper")
    parity = (F.bit_count("fp") % 2).cast("int").alias("parity")
    whole = F.col("fp") == F.col("sent")
    lower = dealt.select("fp", "upper", "sent", parity).join(F.broadcast(masks.select("parity", "lower")), "parity")
    zero = F.array(F.lit(0).cast("long"))
    met = lower.select("fp", "upper", "sent", F.explode(F.when(whole, F.col("lower")).otherwise(zero)).alias("mask"))
    met = met.select("fp", "upper", F.col("sent").bitwiseXOR(F.col("mask")).alias("variant"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= 1
    star = F.min(F.when(near, F.col("fp"))).over(Window.partitionBy("upper", "variant"))
    met = met.select("fp", star.alias("center")).where(F.col("center").isNotNull() & (F.col("fp") != F.col("center")))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= RADIUS
    return met.where(close).select(F.col("fp").alias("a"), F.col("center").alias("b")).distinct()


def components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id that links of at most three differing
    bits reach, the row's own included.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    classes = _named(distinct, "fp", connected_components(checkpointed(links(distinct.select("fp")))))
    return hot_left_join(prints, classes, "fp", "rows", prints.count(), "doc_id").select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, rows, component_id) of ``nodes`` (key, first, rows): the smallest ``first`` of a node's component in ``found``."""
    named = nodes.join(found.select(F.col("node").alias(key), "component"), key, "left")
    named = checkpointed(named.select(key, "first", "rows", F.coalesce("component", key).alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    return hot_left_join(named, smallest, "component", "nodes", named.count(), key).select(key, "rows", "component_id")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, in order; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = map(join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [join(words)]
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64))


def wide_bits(hashes: np.ndarray, bands: int = BANDS, bits: int = BITS) -> list[int]:
    """``bands`` fingerprints of ``bits`` bits over a set of hashes; all are zero if it is empty."""
    seeds = np.arange(1, -(-bands * bits // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * len(seeds), dtype=np.int64)
    for start in range(0, len(hashes), 4080):
        x = hashes[start : start + 4080, None] + seeds  # a finalizer that mixes 64 bits, once for each word of the fingerprint
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        rows = np.unpackbits(x.view(np.uint8), axis=1)
        for part in range(0, len(rows), 255):  # so many ones fit a byte
            ones += rows[part : part + 255].sum(axis=0, dtype=np.uint8)
    set_bits = (2 * ones > len(hashes))[: bands * bits].reshape(bands, bits)
    return (set_bits @ (1 << np.arange(bits, dtype=np.int64))).tolist()


def wide_simhash(text: str | None, shingle: int = SHINGLE, bands: int = BANDS, bits: int = BITS) -> list[int]:
    """``bands`` fingerprints of ``bits`` bits over the distinct shingles of a whole text; without words all are zero."""
    return wide_bits(shingle_hashes(text, shingle), bands, bits)


def min_hash_keys(hashes: np.ndarray, keys: int = HASH_KEYS, rows: int = HASH_ROWS) -> list[int]:
    """``keys`` negative longs that each name ``rows`` min-hashes of a set; none if it is empty."""
    if not len(hashes) or not keys:
        return []
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, keys * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(odd), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[start : start + 1024] * odd[:, None]).min(axis=1), out=least)
    return [(xxhash.xxh64_intdigest(part.tobytes(), k) >> 1) - (1 << 63) for k, part in enumerate(least.reshape(keys, rows))]


def level_of(n: float) -> int:
    """A set of n hashes is compared in 2 ** level pieces, by the upper bits of the hashes."""
    return max(0, math.ceil(math.log2(n / PIECE))) if n else 0


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_text, text) of every row that has a doc_id."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_text"), F.col("text").cast("string"))
    return rows.where(F.col("doc_id").isNotNull())


def wide_fingerprints(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, bits: int = BITS, keys: int = HASH_KEYS) -> DataFrame:
    """(doc_id, row_text, name, n, level, bands, keys) of every row of ``docs`` that has a doc_id; name is that of the set of n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), shingle) for t in batch.column(2)]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            columns = [
                pa.array(names, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([level_of(len(s)) for s in sets], pa.int32()),
                pa.array([wide_bits(s, bands, bits) for s in sets], pa.list_(pa.int64())),
                pa.array([min_hash_keys(s, keys) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["doc_id", "row_text", "name", "n", "level", "bands", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id long, row_text long, name long, n long, level int, bands array<long>, keys array<long>")


def most_differing(similarity: float, n_bits: int, deviations: float = 1) -> int:
    """The bits in which wide fingerprints of texts of that Jaccard similarity differ: what is expected and so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n_bits * share + deviations * math.sqrt(n_bits * share * (1 - share)))


def bits_apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def meetings(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(key, node, center) of the nodes that share a value of a band, (slot, center, star) of the values that meet in a ball.

    ``nodes`` has columns node and bands, and may have keys, which only meet their equals; center is the smallest node with a
    value, star the smallest center in a ball.  The balls are made of distinct
    values only, so a bucket holds at most 1 + ``bits`` values, however many
    texts share one.  What is alone in a bucket is left out.
    """
    key = F.shiftleft(F.col("band").cast("long"), bits).bitwiseOR(F.col("value")).alias("key")
    exploded = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", key)
    if "keys" in nodes.columns:
        exploded = exploded.unionByName(nodes.select("node", F.explode("keys").alias("key")))
    values = checkpointed(exploded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")))
    equal = checkpointed(exploded.join(values.where("center != last").select("key", "center"), "key"))
    # as in links, but a row in the shuffle is two longs: the variant with a mark on those that weren't changed, and the center
    half = bits // 2
    flips = lambda start, stop: F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range(start, stop))]])
    sent = values.where("key >= 0").select("key", "center", F.explode(flips(half, bits)).alias("mask"))
    spot = F.shiftleft(F.col("key").bitwiseXOR(F.col("mask")), 1).bitwiseOR((F.col("mask") == 0).cast("long"))
    dealt = sent.select(spot.alias("spot"), "center").repartition(shuffle_partitions(nodes.sparkSession), F.shiftright("spot", half + 1))
    zero = F.array(F.lit(0).cast("long"))
    whole = F.col("spot").bitwiseAND(F.lit(1).cast("long")) == 1
    met = dealt.select(F.shiftright("spot", half + 1).alias("upper"), F.shiftright("spot", 1).alias("variant"), "center", F.explode(F.when(whole, flips(0, half)).otherwise(zero)).alias("mask"))
    met = met.select("upper", F.col("variant").bitwiseXOR(F.col("mask")).bitwiseAND(F.lit((1 << half) - 1)).alias("lower"), "center")
    ball = Window.partitionBy("upper", "lower")
    met = met.select(F.shiftright("upper", bits - half).alias("slot"), "center", F.min("center").over(ball).alias("star"), F.max("center").over(ball).alias("last"))
    return equal, checkpointed(met.where("star != last").select("slot", "center", "star").distinct())


def stars(equal: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b, times), a < b: each node of a bucket with the smallest one there, and in how many buckets it is that."""
    both = equal.select("node", "center").unionByName(met.select(F.col("center").alias("node"), F.col("star").alias("center"))).where("node != center")
    return both.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def centers(pairs: DataFrame, most: int = CENTERS) -> DataFrame:
    """(a, b, place) of ``pairs`` (as from ``stars``): of each b those it meets most often, from place 1.

    A node of a large family has a center in nearly each ball of each band, some
    500 in all; those that resemble it are the ones that it meets in many.
    """
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))
    return pairs.select("a", "b", place.alias("place")).where(F.col("place") <= most)


def candidates(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b), a < b: nodes that a band brings together, enough of them to connect all that are within two bits of a band."""
    return stars(*meetings(nodes, bits)).select("a", "b")


def strangers(nodes: DataFrame, equal: DataFrame, met: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """(place, node, n, bands, keys, component, outside): the nodes of buckets that ``found`` (node, component) has left with several components.

    A star joins a bucket only as far as its center is similar to the rest.
    All balls around one star are taken together, and the largest component
    there names the place; who is outside of it is to be compared with all
    that are at the place.  Elsewhere nothing is left to find, so a group of
    copies makes no row here however many it has.
    """
    # a value is named by its band, or by its key of min-hashes, and its smallest node
    slot = F.when(F.col("key") >= 0, F.shiftright("key", bits)).otherwise(F.col("key")).alias("slot")
    held = equal.select(slot, "center", "node")
    single = met.select("slot", "center").distinct().join(held.select("slot", "center").distinct(), ["slot", "center"], "left_anti")
    members = held.unionByName(single.withColumn("node", F.col("center"))).join(found, "node", "left")
    members = checkpointed(members.select("slot", "center", F.coalesce("component", "node").alias("component"), "node"))
    shares = members.groupBy("slot", "center", "component").agg(F.count(F.lit(1)).alias("nodes"))
    around = met.unionByName(held.select("slot", "center", F.col("center").alias("star")).distinct()).distinct()
    parts = checkpointed(around.join(shares, ["slot", "center"]))
    mixed = parts.groupBy("slot", "star", "component").agg(F.sum("nodes").alias("nodes")).groupBy("slot", "star")
    mixed = mixed.agg(F.max(F.struct("nodes", "component")).component.alias("place"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    there = parts.join(mixed, ["slot", "star"]).select("place", "slot", "center", "component").distinct()
    rows = there.join(members, ["slot", "center", "component"]).select("place", "node", "component").distinct().join(nodes.select("node", "n", "bands", "keys"), "node")
    return rows.withColumn("outside", F.col("component") != F.col("place"))


def shared_counts(hashes: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """An index of sets of hashes: of another set it tells how many hashes it shares with each."""
    every, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    def counts(own: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
        size = last - first
        at = np.arange(size.sum()) + np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size)
        return np.bincount(owner[at], minlength=len(hashes))

    return counts


def _chunked(rows: DataFrame, weight: Column, most: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(asking, kept): the outsiders of ``rows`` and all of ``rows``, by place, in chunks of about ``most``, so that each of the one meets each of the other in a group of (place, part, chunk)."""
    chunks = lambda which: F.ceil(F.greatest(F.sum(which), F.lit(1)) / most).cast("long")
    sizes = rows.groupBy("place").agg(chunks(weight).alias("chunks"), chunks(F.when(F.col("outside"), weight)).alias("parts"))
    rows = rows.join(sent_if_few(sizes), "place")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = rows.select("place", "node", "component", *columns, spot("chunks").alias("chunk"), every("parts").alias("part"))
    asking = rows.where("outside").select("place", "node", "component", *columns, spot("parts").alias("part"), every("chunks").alias("chunk"))
    return asking, kept


def _together(asking: DataFrame, kept: DataFrame) -> PandasCogroupedOps:
    kept = kept.select(*[F.col(c).alias(f"kept_{c}") for c in kept.columns])
    key = ["place", "part", "chunk"]
    return asking.groupBy(*key).cogroup(kept.groupBy(*[f"kept_{c}" for c in key]))


def resembling(rows: DataFrame, similarity: float, n_bits: int) -> DataFrame:
    """Those of ``rows`` (as from ``strangers``) that have someone at their place whose size and wide fingerprint may be of a text of that similarity."""
    most = most_differing(similarity, n_bits, DEVIATIONS)

    def marked(asking: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(0, np.int64)
        if len(asking) and len(kept):
            bands, n, component = np.stack(kept["kept_bands"]), kept["kept_n"].to_numpy(), kept["kept_component"].to_numpy()
            there, nodes = np.zeros(len(kept), bool), []
            for node, own, size, of_bands in zip(*(asking[c] for c in ("node", "component", "n", "bands"))):
                near = (component != own) & (np.minimum(n, size) >= similarity * np.maximum(n, size) - 1e-9)
                near[near] = np.bitwise_count(bands[near] ^ of_bands).sum(axis=1) <= most
                there |= near
                nodes += [node] * bool(near.any())
            out = np.unique(np.r_[kept["kept_node"].to_numpy()[there], np.array(nodes, np.int64)])
        return pd.DataFrame({"place": np.full(len(out), asking["place"].iloc[0] if len(asking) else 0), "node": out})

    asking, kept = _chunked(rows, F.lit(1), CHUNK_NODES, "n", "bands")
    found = _together(asking, kept).applyInPandas(marked, "place long, node long").distinct()
    return rows.join(found, ["place", "node"], "left_semi")


def links_outside(rows: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, n_bits: int) -> DataFrame:
    """(a, b): of each outsider of ``rows`` (as from ``strangers``) a node of that Jaccard similarity in every other component of its place that has one, written.

    As with stars, only those that some band or key brings together count, so
    what is linked doesn't depend on who else is at the place.  Whose size and
    fingerprint resemble nobody's there is left out first, so few sets are
    shuffled.  A place is dealt into chunks of about CHUNK hashes and its
    outsiders too, and a task compares one of these with one of those.
    """
    rows = checkpointed(resembling(checkpointed(rows), similarity, n_bits))
    sets = checkpointed(_sets(rows.select("node").distinct(), nodes, docs, shingle))
    asking, kept = (x.join(sets, "node") for x in _chunked(rows, F.col("n"), CHUNK, "bands", "keys"))

    def compared(asking: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(asking) and len(kept):
            counts, n = shared_counts([h.view(np.uint64) for h in kept["kept_hashes"]]), kept["kept_hashes"].map(len).to_numpy()
            node, component, bands = kept["kept_node"].to_numpy(), kept["kept_component"].to_numpy(), np.stack(kept["kept_bands"])
            for a, own, h, of_bands, of_keys in zip(*(asking[c] for c in ("node", "component", "hashes", "bands", "keys"))):
                shared = counts(h.view(np.uint64))
                hit = np.flatnonzero((shared >= similarity * (n + len(h) - shared) - 1e-9) & (component != own))
                met = (np.bitwise_count(bands[hit] ^ of_bands) <= 2).any(axis=1) | np.array([bool(np.isin(of_keys, kept["kept_keys"].iloc[i]).any()) for i in hit], bool)
                _, first = np.unique(component[hit[met]], return_index=True)
                out += [(min(a, b), max(a, b)) for b in node[hit[met][first]].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return written(_together(asking, kept).applyInPandas(compared, "a long, b long").distinct(), "links-outside")


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of ``asked`` (node): the whole set of a text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.record_batch([pa.array([node], pa.int64()), pa.array([shingle_hashes(text.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))], names=["node", "hashes"])

    return _texts(asked, nodes, docs).mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _texts(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of ``asked`` (node), once for each row that has the node's text."""
    named = nodes.select("node", F.col("first").alias("doc_id"), "row_text").join(asked, "node", "left_semi")
    return _rows(docs).join(sent_if_few(named), ["doc_id", "row_text"]).select("node", "text")


def shingle_sets(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, level, piece, hashes) of ``texts`` (node, text): at every level that a text of that similarity may ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle_hashes(text.as_py(), shingle)
                for level in range(level_of(len(hashes)), level_of(len(hashes) / similarity) + 1):
                    cuts = np.searchsorted(hashes, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)) if level else []
                    for piece, part in enumerate(np.split(hashes, cuts)):
                        values = [pa.array([x], t) for x, t in ((node, pa.int64()), (level, pa.int32()), (piece, pa.int32()))]
                        yield pa.record_batch([*values, pa.array([part.view(np.int64)], pa.list_(pa.int64()))], names=["node", "level", "piece", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, level int, piece int, hashes array<long>")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, n_bits: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets of shingles have that Jaccard similarity, written.

    The wide fingerprints only spare comparisons; what decides is the exact
    similarity of the whole sets.
    """
    ends = [nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "level", "bands")]) for x in "ab"]
    near = pairs.join(ends[0], "a").join(ends[1], "b").where(F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9)
    near = near.where(bits_apart("a_bands", "b_bands") <= most_differing(similarity, n_bits, DEVIATIONS))
    near = checkpointed(near.select("a", "b", "a_n", "b_n", F.greatest("a_level", "b_level").alias("level")))
    asked = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = checkpointed(shingle_sets(_texts(asked, nodes, docs), shingle, similarity).dropDuplicates(["node", "level", "piece"]))
    left = near.join(sets.select(F.col("node").alias("a"), "level", "piece", F.col("hashes").alias("a_hashes")), ["a", "level"])
    both = left.join(sets.select(F.col("node").alias("b"), "level", "piece", F.col("hashes").alias("b_hashes")), ["b", "level", "piece"])
    shared = both.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_hashes", "b_hashes")).alias("shared"))
    shared = shared.groupBy("a", "b", "a_n", "b_n").agg(F.sum("shared").alias("shared"))
    return checkpointed(shared.where(F.col("shared") >= similarity * (F.col("a_n") + F.col("b_n") - F.col("shared")) - 1e-9).select("a", "b"))


def joined_by(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that ``found`` (node, component) has not joined."""
    ends = [found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab"]
    rows = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return rows.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")


def _classes(docs: DataFrame, shingle: int, similarity: float, bands: int, bits: int, keys: int) -> DataFrame:
    """(doc_id, row_text, component_id) of every row with a doc_id."""
    prints = written(wide_fingerprints(docs, shingle, bands, bits, keys), "wide-fingerprints")
    kept = [F.first(c).alias(c) for c in ("n", "level", "bands", "keys")]
    nodes = prints.groupBy("name").agg(F.min(F.struct("doc_id", "row_text")).alias("row"), F.count(F.lit(1)).alias("rows"), *kept)
    # numbers that are smaller than hashes, and stay as they are written
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "name", "rows", F.col("row.doc_id").alias("first"), F.col("row.row_text"), "n", "level", "bands", "keys"), "nodes")
    # a set of fewer can't have that similarity to any but its equal
    linkable = nodes.where(F.col("n") * (1 - similarity) >= similarity - 1e-9)
    equal, met = meetings(linkable, bits)
    pairs = checkpointed(centers(stars(equal, met)))
    check = lambda some: similar(some, linkable, docs, shingle, similarity, bands * bits)
    # one link may join a node to all others of its group, so each is first tried with its first center alone
    linked = check(pairs.where("place = 1").select("a", "b"))
    found = connected_components(linked)
    for rest in (lambda: check(joined_by(found, pairs.where("place > 1"))), lambda: links_outside(strangers(linkable, equal, met, found, bits), linkable, docs, shingle, similarity, bands * bits)):
        more = rest()
        if not more.isEmpty():
            linked = linked.unionByName(more)
            found = connected_components(linked)
    return hot_left_join(prints.select("doc_id", "row_text", "name"), _named(nodes.select("node", "first", "rows"), "node", found).join(nodes.select("node", "name"), "node").drop("node"), "name", "rows", prints.count(), "doc_id").drop("name")


def near_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, bits: int = BITS, keys: int = HASH_KEYS) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: the smallest doc_id that links of that Jaccard similarity reach."""
    return _classes(docs, shingle, similarity, bands, bits, keys).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, bits: int = BITS, keys: int = HASH_KEYS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that with the smallest doc_id.

    All columns stay.  Repeated rows of the kept doc_id stay as they are; rows
    without a doc_id stay, as nothing names them.
    """
    classes = _classes(docs, shingle, similarity, bands, bits, keys).where(F.col("doc_id") != F.col("component_id"))
    lost_id, lost_text = unused(docs, "lost_id"), unused(docs, "lost_text")
    lost = sent_if_few(classes.select(F.col("doc_id").alias(lost_id), F.col("row_text").alias(lost_text)).distinct())
    same = (docs["doc_id"] == lost[lost_id]) & (F.xxhash64(docs["text"]) == lost[lost_text])
    return docs.join(lost, same, "left_anti")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
