"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a root over the trees.

A leaf is the SHA-256 of the row's fields.  Leaves of one language ascend by
doc_id (nulls first, equal ones by leaf); every FAN_OUT consecutive nodes become
one, until one is left, the language's subroot; subroots in order of language
(null first) become the root in the same way.  A proof of a leaf is, level by
level, the digests left and right of it in its run.

At scale a tree is cut into aligned blocks of FAN_OUT ** BLOCK_LEVELS nodes, so
a language that holds most rows is many blocks.  The blocks' roots are the nodes
of the next, smaller tree, and so on; the proofs of its nodes are then handed
down.  A task walks a block by fractal traversal: of each layer of STACKED
levels it keeps the existing subtree, from which paths are read, and grows the
desired one, which comes next, a leaf at a time, so beyond the block's leaves it
holds two subtrees a layer.  The path of the block in the upper trees is
appended to each path.

Only digests are shuffled: texts are read once, by the scan that makes leaves.
Rows are numbered within ranges of (language, doc_id) that are written once,
whose counts give the offsets, so no task sorts a language.

Rows: a null field is ``-`` in its leaf; a null doc_id is a leaf like any other
and is never tampered with; repeated rows are leaves of their own; empty and
very long texts are like any other; a single row is its own subroot and root,
with an empty proof; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sent_if_few, written

FAN_OUT = 8
BLOCK_LEVELS = 4
STACKED = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Siblings = list[tuple[str, str]]


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(size: int) -> int:
    """How often ``size`` nodes are joined until one is left."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN_OUT), n + 1
    return n


def top(leaves: Sequence[str], start: int, end: int, levels: int) -> str:
    """The node ``levels`` above the aligned leaves from start to end; a run is held on each level."""
    if not levels:
        return leaves[start]
    step = FAN_OUT ** (levels - 1)
    return joined([top(leaves, a, min(a + step, end), levels - 1) for a in range(start, end, step)])


class Subtree:
    """All nodes of an aligned piece of a tree, grown a leaf at a time: a full run becomes its parent at once."""

    def __init__(self, levels: int):
        self.rows: list[list[str]] = [[] for _ in range(levels + 1)]

    def grow(self, digest: str) -> None:
        for row in self.rows:
            row.append(digest)
            if len(row) % FAN_OUT or row is self.rows[-1]:
                return
            digest = joined(row[-FAN_OUT:])

    def close(self) -> Subtree:
        """What the end has left are shorter runs."""
        for low, high in zip(self.rows, self.rows[1:]):
            if len(high) * FAN_OUT < len(low):
                high.append(joined(low[len(high) * FAN_OUT :]))
        return self

    def siblings(self, i: int) -> Siblings:
        out = []
        for row in self.rows[:-1]:
            start = i - i % FAN_OUT
            out.append(("".join(row[start:i]), "".join(row[i + 1 : start + FAN_OUT])))
            i //= FAN_OUT
        return out


def traversed(leaves: Sequence[str], levels: int) -> Iterator[Siblings]:
    """The path of each leaf of a block, in order, by fractal traversal."""
    n = len(leaves)
    heights = [min(STACKED, levels - at) for at in range(0, levels, STACKED)]
    below = [FAN_OUT ** (STACKED * j) for j in range(len(heights))]  # leaves under a leaf of the layer's subtrees
    width = [FAN_OUT**h * b for h, b in zip(heights, below)]

    def grown(tree: Subtree, j: int, at: int) -> None:
        tree.grow(top(leaves, at, min(at + below[j], n), STACKED * j))

    existing, desired = [], [Subtree(h) for h in heights]
    for j, h in enumerate(heights):
        first = Subtree(h)
        for at in range(0, min(width[j], n), below[j]):
            grown(first, j, at)
        existing.append(first.close())
    for t in range(n):
        path: Siblings = []
        for j, h in enumerate(heights):
            if t and t % width[j] == 0:
                existing[j], desired[j] = desired[j].close(), Subtree(h)
            if t % below[j] == 0 and t + width[j] < n:
                grown(desired[j], j, t + width[j])
            path += existing[j].siblings(t % width[j] // below[j])
        yield path


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (part, ...) with their place in their part, in ``order``, and the part's size."""
    # rows that are equal in all of this are interchangeable; what tells them apart lets ranges split them
    keys = ["part", *order, "_row"]
    ranges = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a range's number in the upper bits, the place in it in the lower
    ranges = written(ranges.drop("_row").withColumn("_id", F.monotonically_increasing_id()), "merkle-ranges").withColumn("_range", F.shiftright("_id", 33))
    counts = ranges.groupBy("part", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("part")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("part", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    return ranges.join(sent_if_few(places), ["part", "_range"]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("index"), "size")


def block_of(height: int) -> Column:
    return F.floor(F.col("index") / FAN_OUT**height).cast("long").alias("block")


def block_roots(nodes: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """The nodes ``height`` levels above ``nodes`` (part, index, size, digest), or at the top of their part."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        size = int(block["size"].iloc[0])
        digest = top(block["digest"].tolist(), 0, len(block), min(height, levels_of(size)))
        return pd.DataFrame({"part": [key[0]], "index": [key[1]], "size": [-(-size // FAN_OUT**height)], "digest": [digest]})

    return nodes.select("part", "index", "size", "digest", block_of(height)).groupBy("part", "block").applyInPandas(run, "part string, index long, size long, digest string")


def handed_down(nodes: DataFrame, upper: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """``nodes`` with lefts and rights up to the top of their part, and the top; ``upper`` has these of the blocks."""
    keep = [c for c in nodes.columns if c not in ("index", "size")]
    schema = ", ".join(f"{c} {dict(nodes.dtypes)[c]}" for c in keep) + ", index long, lefts array<string>, rights array<string>, top string"

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("index")
        lefts, rights = list(above["lefts"].iloc[0]), list(above["rights"].iloc[0])
        paths = list(traversed(block["digest"].tolist(), min(height, levels_of(int(block["size"].iloc[0])))))
        out = block[[*keep, "index"]]
        return out.assign(lefts=[[a for a, _ in p] + lefts for p in paths], rights=[[b for _, b in p] + rights for p in paths], top=above["top"].iloc[0])

    blocks = nodes.select("*", block_of(height)).groupBy("part", "block")
    return blocks.cogroup(upper.groupBy("part", "index")).applyInPandas(run, schema)


def proved(nodes: DataFrame, height: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (part, index, size, digest and what else is to be kept) with lefts, rights and top; and the top of each part.

    A job for every ``height`` levels of the highest tree, each over so many
    fewer nodes than the one before.
    """
    tower = [nodes]
    while True:
        tower.append(written(block_roots(tower[-1], height), "merkle-nodes"))
        if tower[-1].agg(F.max("size")).first()[0] in (None, 1):
            break
    none = F.array().cast("array<string>")
    tops = tower.pop()
    upper = tops.select("part", "index", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("top"))
    for level in reversed(tower):
        upper = handed_down(level, upper, height)
    return upper, tops.select("part", "digest")


def leaf_of(**other: Column) -> Column:
    """The digest of a row's fields, some of them in another form."""
    parts = []
    for c in FIELDS:
        value = other.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, height: int = BLOCK_LEVELS, **keep: Column) -> DataFrame:
    """doc_id, lang, leaf, lefts, rights, subroot, root and the columns ``keep``, of every row of ``docs``."""
    part = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = written(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), part.alias("part"), leaf_of().alias("digest"), *[c.alias(n) for n, c in keep.items()]), "merkle-leaves")
    trees, subroots = proved(numbered(leaves, "doc_id", "digest"), height)
    upper, _ = proved(numbered(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "digest"), "name"), height)
    upper = upper.select(F.col("name").alias("part"), F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights"), F.col("top").alias("root"))
    rows = trees.join(sent_if_few(upper), "part")
    return rows.select("doc_id", "lang", F.col("digest").alias("leaf"), F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights"), F.col("top").alias("subroot"), "root", *keep)


def proof_digest(lefts: Column, rights: Column) -> Column:
    """Of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof give."""
    pairs = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.aggregate(pairs, leaf, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def query(docs: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and what a row that was tampered with (its text lower-cased where 3 divides the crc32 of doc_id) folds to."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, height, now=F.when(tampered, leaf_of(text=lower)))
    lefts, rights = F.col("lefts"), F.col("rights")
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(lefts, rights).alias("proof_sha256"), folded(F.coalesce("now", "leaf"), lefts, rights).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
