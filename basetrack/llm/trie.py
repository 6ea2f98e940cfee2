"""Prefix trie of conversations, with what a cache of common prefixes would save.

Conversations are rebuilt (the first turns of the one whose conv_id ends in 00
come before a conversation's own) and every distinct sequence of first turns is
a node.  A node is named by the exclusive or of 128-bit hashes of (turn, its
depth), which is computed along a conversation like a running sum.

Turns are sorted by (conv_id, turn) into ranges that may split a conversation,
so one that holds a third of all rows is many tasks.  A range begins with what
the ranges before it say of the conversation and hundred that it begins in: a
row for each range, through the driver.

The trie is then cut in three.  Nodes with more than ``most`` members are the
heavy upper levels, counted by Spark with partial aggregation.  Below them each
light prefix is a shard of at most that many conversations; shards are packed
into tasks, where numpy builds a level-order trie (a LOUDS bitvector and label
arrays), reads parents from the bitvector and adds up subtrees in reverse
breadth-first order.  Where only one conversation goes on, its turns are a tail
and no node of a shard: they are known from the conversation alone.  The
shards' totals are merged into the heavy levels separately: each heavy node
adds its own and its light children's totals to all of its ancestors, along the
path of its smallest member.

Rows: a null conv_id is left out; null turns come first; equal turns come in the
order of their hashes and all count, repeated rows too; null role or text is
empty; for a negative conv_id the hundred is that of the next lower multiple;
a conversation without turns of its own after rebuilding is a member of the root
alone; very long texts are hashed, not shuffled; an empty table has no node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sent_if_few, written

HUNDRED = 100
MOST_HEAD = 5
# members of a shard, and nodes of a task
MOST = 10_000
TASK_NODES = 50_000
# conv_ids of one piece of a list that is hashed
PIECE = 1000
KEY = ["depth", "hi", "lo"]
NOTHING = hashlib.sha256(b"").hexdigest()


def head_length(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its hundred."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_HEAD + 1) if conv_id % HUNDRED else 0


def mixed(labels: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Two lanes for each turn (two lanes) at its depth."""
    out = np.empty_like(labels)
    for lane, odd in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
        x = labels[:, lane] + depths.astype(np.uint64) * np.uint64(odd)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out[:, lane] = x ^ x >> np.uint64(31)
    return out


def lanes(labels: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(labels), np.uint64).reshape(-1, 2)


def runs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of equal ids."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
    return starts, np.r_[starts[1:], len(ids)].astype(int)


class State(NamedTuple):
    """What a range begins with: a conversation and its turns so far; a hundred and the first turns of its first conversation."""

    conv_id: int | None = None
    turns: int = 0
    hundred: int | None = None
    labels: bytes = b""
    sizes: tuple[int, ...] = ()


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, label, n) in order, in ranges that stay as they are; n: code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), label.alias("label"), F.length(text).cast("long").alias("n")).where("conv_id IS NOT NULL")
    keys = ["conv_id", "turn", "label", "_row"]  # equal rows are interchangeable, and ranges may split them
    ranges = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return checkpointed(ranges.select("conv_id", "label", "n"))


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for a range: what it adds to the state that the next one begins with."""
    first = last = hundred = None
    turns, labels, sizes = 0, [], []
    for rows in batches:
        ids = rows["conv_id"].to_numpy()
        for a, b in zip(*runs_of(ids)):
            c = int(ids[a])
            first = c if first is None else first
            if c != last:
                last, turns = c, 0
            if c // HUNDRED != hundred:
                hundred, labels, sizes = c // HUNDRED, [], []
            turns += int(b - a)
            if c % HUNDRED == 0:
                b = min(b, a + MOST_HEAD - len(labels))
                labels += rows["label"].iloc[a:b].tolist()
                sizes += rows["n"].iloc[a:b].tolist()
    if first is not None:
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "turns": [turns], "labels": [b"".join(labels)], "sizes": [sizes]})


def states(turns: DataFrame) -> dict[int, State]:
    """What each range begins with."""
    out, now = {}, State()
    rows = turns.mapInPandas(_contents, "part int, first long, last long, turns long, labels binary, sizes array<long>").collect()
    for r in sorted(rows, key=lambda r: r["part"]):
        out[r["part"]] = now
        goes_on = r["first"] == r["last"] == now.conv_id
        same = now.hundred is not None and r["first"] // HUNDRED == r["last"] // HUNDRED == now.hundred
        labels = (now.labels if same else b"") + bytes(r["labels"])
        sizes = (now.sizes if same else ()) + tuple(r["sizes"])
        now = State(r["last"], r["turns"] + goes_on * now.turns, r["last"] // HUNDRED, labels[: 16 * MOST_HEAD], sizes[:MOST_HEAD])
    return out


ROWS = "conv_id long, depth long, hi long, lo long, phi long, plo long, n long, part int"


def _rows(conv_id, depth, names, parents, n, part) -> pd.DataFrame:
    names, parents = names.view(np.int64), parents.view(np.int64)
    return pd.DataFrame({"conv_id": conv_id, "depth": depth, "hi": names[:, 0], "lo": names[:, 1], "phi": parents[:, 0], "plo": parents[:, 1], "n": n, "part": part})


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, phi, plo, n): a row for each prefix of each rebuilt conversation, from depth 0; hi and lo name it, phi and plo the one before."""
    turns = sorted_turns(conversations)
    shared = turns.sparkSession.sparkContext.broadcast(states(turns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        state, last, opened = shared.value.get(part, State()), None, False
        conv, seen, hundred = state.conv_id, state.turns, state.hundred
        heads, sizes = lanes(pd.Series([state.labels])), list(state.sizes)
        name = np.zeros(2, np.uint64)  # of the last prefix; in a conversation that began in an earlier range, what this range adds to it
        for rows in batches:
            ids = rows["conv_id"].to_numpy()
            if not len(ids):
                continue
            labels, n = lanes(rows["label"]), rows["n"].to_numpy()
            starts, ends = runs_of(ids)
            skip, shift, before, names, part_of, out = [], [], [], [], [], []
            for a, b in zip(starts, ends):
                c = int(ids[a])
                if c // HUNDRED != hundred:
                    hundred, heads, sizes = c // HUNDRED, np.zeros((0, 2), np.uint64), []
                begins = c != conv
                if last is None:
                    opened = not begins
                elif c != last:
                    opened = False
                conv, last = c, c
                if begins:
                    seen = 0
                h = head_length(c)
                k = min(h, len(heads))
                if begins:
                    own = np.zeros((k + 1, 2), np.uint64)
                    own[1:] = np.bitwise_xor.accumulate(mixed(heads[:k], np.arange(1, k + 1)), axis=0)
                    out.append(_rows(c, np.arange(k + 1), own, own[np.maximum(np.arange(k + 1) - 1, 0)], [0, *sizes[:k]], -1))
                    name = own[-1]
                if c % HUNDRED == 0 and len(heads) < MOST_HEAD:
                    more = slice(a, min(b, a + MOST_HEAD - len(heads)))
                    heads, sizes = np.concatenate((heads, labels[more])), sizes + n[more].tolist()
                skip.append(h - seen)
                shift.append(k - h + seen + 1)
                names.append(name)
                part_of.append(part if opened else -1)
                seen += int(b - a)
            count = ends - starts
            place = np.arange(len(ids)) - np.repeat(starts, count)
            keep = place >= np.repeat(skip, count)
            depth = (place + np.repeat(shift, count))[keep]
            run_of = np.repeat(np.arange(len(starts)), count)[keep]
            if len(depth):
                terms = mixed(labels[keep], depth)
                total = np.bitwise_xor.accumulate(terms, axis=0)
                first, _ = runs_of(run_of)
                base = np.zeros((len(starts), 2), np.uint64)
                base[run_of[first]] = total[first] ^ terms[first]
                total ^= (base ^ np.array(names))[run_of]
                out.append(_rows(ids[keep], depth, total, total ^ terms, n[keep], np.array(part_of)[run_of]))
                name = total[-1] if run_of[-1] == len(starts) - 1 else name
            if out:
                yield pd.concat(out)
        if last is not None:
            yield _rows([last], [-1], name[None], name[None], [part], part if opened else -1)

    rows = written(turns.mapInPandas(run, ROWS), "trie-rows")
    # the exclusive or that a conversation brings into each range, a row for a range
    carried, name = [], (0, 0)
    for r in sorted(rows.where("depth = -1").collect(), key=lambda r: r["n"]):
        carried.append((r["n"], *name))
        name = (r["hi"] ^ name[0], r["lo"] ^ name[1]) if r["part"] >= 0 else (r["hi"], r["lo"])
    table = rows.sparkSession.createDataFrame(carried, "part int, chi long, clo long")
    rows = rows.where("depth >= 0").join(F.broadcast(table), "part", "left")
    fixed = [F.col(c).bitwiseXOR(F.coalesce(f"c{c[-2:]}", F.lit(0))).alias(c) for c in ("hi", "lo", "phi", "plo")]
    return rows.select("conv_id", "depth", *fixed, "n")


class Louds:
    """A forest in level order: for each node as many ones as it has children, then a zero; before them those of a node above all roots.

    ``labels`` are the positions of the given nodes in level order.
    """

    def __init__(self, level: np.ndarray, name: np.ndarray, parent: np.ndarray):
        """Of nodes with their level, their own and their parent's name (structured, so that they compare)."""
        self.labels, counts, self.levels = np.zeros(0, int), [], [0]
        above = np.zeros(0, int)
        for d in range(int(level.max()) + 1 if len(level) else 0):
            here = np.flatnonzero(level == d)
            if d:
                order = np.argsort(name[above], kind="stable")
                rank = order[np.searchsorted(name[above], parent[here], sorter=order)]
                by = np.argsort(rank, kind="stable")
                here, rank = here[by], rank[by]
                counts.append(np.bincount(rank, minlength=len(above)))
            self.labels = np.concatenate((self.labels, here))
            self.levels.append(len(self.labels))
            above = here
        children = np.concatenate([*counts, np.zeros(len(above), int)]).astype(int)
        roots = self.levels[1] if len(self.levels) > 1 else 0
        bits = np.ones(roots + 1 + len(children) + int(children.sum()), np.uint8)
        bits[np.cumsum(np.r_[roots, children] + 1) - 1] = 0
        self.n, self.bits = len(bits), np.packbits(bits)

    def ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits, count=self.n))

    def parents(self) -> np.ndarray:
        """Of each node, in level order; -1 of roots.  The i-th one is node i, and the zeros before it count the nodes before its parent."""
        ones = self.ones()
        return ones - np.arange(len(ones)) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order, from the last level to the first."""
        out, parents = values.copy(), self.parents()
        for a, b in reversed(list(zip(self.levels[1:], self.levels[2:]))):
            np.add.at(out, parents[a:b], out[a:b])
        return out


def _keys(hi: pd.Series, lo: pd.Series) -> np.ndarray:
    out = np.empty(len(hi), [("hi", np.int64), ("lo", np.int64)])
    out["hi"], out["lo"] = hi, lo
    return out


NODES = "depth long, hi long, lo long, phi long, plo long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean, single_end boolean"


def _shards(nodes: pd.DataFrame) -> pd.DataFrame:
    """The nodes of some shards with their parents and totals; a shard's top has its parent elsewhere."""
    trie = Louds(nodes["level"].to_numpy(), _keys(nodes["hi"], nodes["lo"]), _keys(nodes["phi"], nodes["plo"]))
    nodes = nodes.iloc[trie.labels].reset_index(drop=True)
    parents, tail = trie.parents(), nodes["tail"].to_numpy()
    inside = parents >= 0
    children = np.bincount(parents[inside], minlength=len(nodes)) + tail
    leaf = (children - tail == 0).astype(np.int64)
    saved = ((nodes["n_convs"] - 1) * nodes["n"]).to_numpy()
    conv = nodes["conv_id"].to_numpy()
    return nodes[[*KEY, "phi", "plo", "conv_id"]].assign(
        parent_conv_id=pd.Series(conv[parents], dtype="Int64").where(inside), n_convs=nodes["n_convs"], n_children=children, n_leaves=trie.rolled_up(leaf), saved_tokens=trie.rolled_up(saved), top=~inside, single_end=(nodes["n_convs"] == 1) & ~tail.astype(bool),
    )


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted (key, conv_id): pieces of the list of each key."""
    for rows in batches:
        keys = rows.assign(place=np.arange(len(rows)) // PIECE)
        out = keys.groupby([*KEY, "place"], sort=False)["conv_id"].agg([("first", "min"), ("ids", lambda x: ",".join(map(str, x)))]).reset_index()
        yield out[[*KEY, "first", "ids"]]


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pieces in order: the hash of each key's list; a piece is held at a time."""
    key, state, out = None, None, []
    for rows in batches:
        for depth, hi, lo, ids in zip(*(rows[c] for c in (*KEY, "ids"))):
            if (depth, hi, lo) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, hi, lo), hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if out:
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
            out = []
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def ends_of(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): who ends at a node, in ascending order.  A list that is long is cut by ranges and hashed piece by piece."""
    by = [*KEY, "conv_id"]
    pieces = last.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(_pieces, "depth long, hi long, lo long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(_hashed, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each node: its name (depth, hi, lo), its parent's (phi, plo), and what ``query`` returns of it.

    The turns of a node are the first ``depth`` rebuilt ones of its conv_id.
    """
    rows = rebuilt(conversations)
    nodes = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("phi").alias("phi"), F.min("plo").alias("plo"), F.max("n").alias("n")), "trie-nodes")
    is_heavy = (F.col("n_convs") > most) | (F.col("depth") == 0)
    heavy = nodes.where(is_heavy)
    names = sent_if_few(heavy.select(*KEY, F.lit(True).alias("heavy")))
    here = F.struct(*KEY)
    # of each conversation: where it ends, the first light prefix, and from where it is alone
    convs = rows.join(names, KEY, "left").groupBy("conv_id").agg(F.max(here).alias("last"), F.min(F.when(F.col("heavy").isNull(), here)).alias("shard"))
    alone = nodes.where("n_convs = 1 AND depth > 0").groupBy("conv_id").agg(F.min("depth").alias("alone"))
    convs = written(convs.join(alone, "conv_id", "left"), "trie-convs")

    light = nodes.where(~is_heavy).join(convs, "conv_id")
    in_tail = (F.col("n_convs") == 1) & (F.col("depth") > F.col("alone"))
    end = F.col("depth") == F.col("last.depth")
    tails = light.where(in_tail).select(
        *KEY, "phi", "plo", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.lit(False).alias("top"), end.alias("single_end"),
    )
    tail = ((F.col("n_convs") == 1) & (F.col("depth") < F.col("last.depth"))).cast("long")
    sharded = light.where(~F.coalesce(in_tail, F.lit(False)))
    tasks = F.lit(max(1, nodes.count() // TASK_NODES))
    sharded = sharded.select(*KEY, "phi", "plo", "conv_id", "n_convs", "n", tail.alias("tail"), (F.col("depth") - F.col("shard.depth")).alias("level"), F.pmod(F.xxhash64("shard.hi", "shard.lo"), tasks).alias("task"))
    shards = written(sharded.groupBy("task").applyInPandas(_shards, NODES), "trie-shards")

    # the heavy levels: what their children bring, then the sums over all that lie below
    up = [(F.col("depth") - 1).alias("depth"), F.col("phi").alias("hi"), F.col("plo").alias("lo")]
    count = F.count(F.lit(1))
    below = shards.where("top").groupBy(*up).agg(count.alias("light"), F.sum("n_leaves").alias("light_leaves"), F.sum("saved_tokens").alias("light_saved"))
    inner = heavy.where("depth > 0").groupBy(*up).agg(count.alias("inner"))
    none = lambda c: F.coalesce(c, F.lit(0))
    heavy = heavy.join(below, KEY, "left").join(inner, KEY, "left").withColumn("n_children", none("light") + none("inner"))
    own_leaves = none("light_leaves") + (F.col("n_children") == 0).cast("long")
    heavy = written(heavy.select(*nodes.columns, "n_children", own_leaves.alias("own_leaves"), (none("light_saved") + (F.col("n_convs") - 1) * F.col("n")).alias("own_saved")), "trie-heavy")
    reach = sent_if_few(heavy.select("conv_id", F.col("depth").alias("_to"), "own_leaves", "own_saved"))
    totals = rows.join(reach, (rows["conv_id"] == reach["conv_id"]) & (rows["depth"] <= reach["_to"])).groupBy(*KEY).agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    owner = sent_if_few(heavy.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent")))
    at_parent = ["depth", "phi", "plo"]
    upper = heavy.join(totals, KEY).withColumns({"parent_conv_id": F.lit(None).cast("long"), "top": F.col("depth") > 0, "single_end": F.lit(False)})
    every = tails.unionByName(shards).unionByName(upper.select(*tails.columns))
    every = every.join(owner, at_parent, "left").withColumn("parent_conv_id", F.when(F.col("top"), F.col("parent")).otherwise(F.col("parent_conv_id"))).drop("parent")

    ends = ends_of(convs.where("alone IS NULL").select("last.*", "conv_id"))
    own = F.when(F.col("single_end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.coalesce("ends_sha256", F.lit(NOTHING)))
    return every.join(ends, KEY, "left").withColumn("ends_sha256", own).drop("top", "single_end")


def query(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    return prefix_trie(conversations, most).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
