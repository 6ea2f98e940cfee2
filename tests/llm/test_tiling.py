"""Tiling of repetitive and long texts, and blocks of the benchmark."""

import itertools
import random
import time

import numpy as np

from basetrack.llm import tiling


def slow_matches(a, b, k):
    out = []
    for p, q in itertools.product(range(len(a)), range(len(b))):
        if p and q and a[p - 1] == b[q - 1]:
            continue
        n = 0
        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
            n += 1
        if n >= k:
            out.append((n, p, q))
    return sorted(out)


def test_matches_brute(monkeypatch):
    rng = random.Random(3)
    for pairs in (1 << 20, 7, 1):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        for _ in range(100):
            a, b = ([rng.randint(low, 3) for _ in range(rng.randint(1, 30))] for low in (0, 1))
            k = min(rng.randint(1, 4), len(b))
            assert sorted(tiling.matches(np.array(a), np.array(b), k)) == slow_matches(a, b, k)


def test_repetitive_text():
    start = time.time()
    found = tiling.tiles(np.ones(100_000, dtype=np.int64), np.ones(200, dtype=np.int64), 5)
    assert found[0][0] == 200 and len(found) == 1
    assert time.time() - start < 30


def test_blocks_and_texts_of_one_id(spark):
    """The number of blocks doesn't change the rows; of a doc_id only the text that holds an item goes."""
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "en", "in", "on", "un", "ar", "er", "ir", "or", "ur")]
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 40)))) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=30)) + " " + items[i][1] + " " + " ".join(rng.choices(words, k=30))) for i in range(0, 60, 2)]
    docs += [(0, "a second text of the first document"), (0, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, tiling.leaks(docs, bench, block_bytes=n).collect())) for n in (1_000_000, 800))
    assert one == many and {(i, i) for i in range(0, 60, 2)} <= {r[:2] for r in one}
    kept = {tuple(r) for r in tiling.decontaminate(docs, bench).collect()}
    assert kept == {(0, "a second text of the first document"), (0, None)}
