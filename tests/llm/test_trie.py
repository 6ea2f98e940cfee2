"""The prefix trie against lists of turns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from basetrack.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, part int, depth int, n string"


def brute(rows):
    own = collections.defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    order = lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest())
    own = {c: [t[1:] for t in sorted(turns, key=order)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple(map(str, t)))


def odd_rows():
    """Null and tied turns, null roles and texts, repeated rows, negative ids, hundreds without a first one, a long conversation and its copy, a text of 100,000 words."""
    rng, rows = random.Random(1), []
    for c in [*range(0, 130), *range(300, 420), -5, -100, -1, 1_000_000]:
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "yé", "zz", None, ""])) for t in range(rng.choice([0, 1, 2, 3, 6, 9]))]
    rows += [(c, t, "u", "common") for c in range(500, 560) for t in range(c % 3)]
    rows += [(77, t, "u", f"t{t}") for t in range(3000)] + [(c, t, "u", f"t{t}") for c in (1100, 1200) for t in range(1500)]
    rows += [(None, 1, "u", "q")] * 3 + [(2000, 0, "u", "word " * 100_000)] + [(2001, 1, "u", "same")] * 50
    return [(*r, 1, 2, "n") for r in rows]


# the last one leaves several ranges inside one conversation
@pytest.mark.parametrize("most, partitions", [(10_000, "4"), (20, "3"), (1, "40")])
def test_odd_rows(spark, most, partitions):
    odd = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        assert ordered(trie.query(odd, most).collect()) == brute(odd.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert ordered(trie.query(rows).collect()) == brute(rows.collect())
    assert trie.query(rows.limit(0)).collect() == []


@pytest.mark.parametrize("turns", [[], [0], [0, 1, 2]])
def test_one_conversation(spark, turns):
    """Alone in the table, also without any turn of its own left: the first one of 2 goes."""
    rows = [(2, t, "u", f"t{t}", 1, 2, "n") for t in (0, *turns)]
    one = spark.createDataFrame(rows, SCHEMA)
    assert trie.head_length(2) == 1 and ordered(trie.query(one).collect()) == brute(one.collect())
    two = spark.createDataFrame([*rows, (100, 0, "u", "t0", 1, 2, "n")], SCHEMA)
    assert ordered(trie.query(two, 1).collect()) == brute(two.collect())


def test_louds():
    name = np.array([(i, 0) for i in range(6)], [("hi", np.int64), ("lo", np.int64)])
    parent = np.array([(9, 9), (0, 0), (0, 0), (1, 0), (9, 9), (3, 0)], name.dtype)
    louds = trie.Louds(np.array([0, 1, 1, 2, 0, 3]), name, parent)
    assert louds.labels.tolist() == [0, 4, 1, 2, 3, 5] and louds.parents().tolist() == [-1, -1, 0, 0, 2, 4]
    assert np.unpackbits(louds.bits, count=louds.n).tolist() == [1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 0]
    assert louds.rolled_up(np.ones(6, int)).tolist() == [5, 1, 3, 1, 2, 1]
