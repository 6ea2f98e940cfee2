"""The manifest against whole trees built one after the other."""

import hashlib
import zlib

import pytest

from basetrack.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, `index` int, digest string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    out = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = None if row[c] is None else str(row[c])
        if v and lower and c == "text":
            v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return joined(out)


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by_lang[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in by_lang[x]]) for x in langs}
    upper = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            d, siblings = leaf(r, tampered), []
            for levels, at in ((trees[lang], i), (upper, k)):
                for level in levels[:-1]:
                    start = at // 8 * 8
                    left, right = level[start:at], level[at + 1 : start + 8]
                    siblings += left + right
                    d = joined([*left, d, *right])
                    at //= 8
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], upper[-1][0], joined(siblings), d, d == upper[-1][0]))
    return sorted(out, key=lambda t: tuple(map(str, t)))


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda t: tuple(map(str, t)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(merkle.query(docs)) == brute(docs.collect())


@pytest.mark.parametrize("height", [1, 2, 3])
def test_odd_rows_in_blocks_of_any_height(spark, height):
    """Nulls, ties, repeated rows, a language with one row, a long text, clashing names; runs of one node."""
    langs = ["en", "en", "en", "de", None]
    rows = [(i % 290 if i % 7 else None, None if i % 11 == 0 else f"Té{i}X", langs[i % 5], "s" if i % 3 else None, i, "p", 3, "d") for i in range(700)]
    rows += [(5, "a", "en", "s", 1, "p", 3, "d")] * 40 + [(6, "", "zz", "s", 0, "p", 3, "d"), (7, "Word " * 200_000, "en", "s", None, "p", 3, "d")]
    odd = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(merkle.query(odd, height)) == brute(odd.collect())


def test_no_row_and_one(spark):
    one = spark.createDataFrame([(6, "AB", None, "s", 2, "p", 3, "d")], SCHEMA)
    assert merkle.query(one.limit(0)).collect() == []
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["lefts"] == row["rights"] == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 520, 4096])
def test_fractal_traversal(n):
    leaves = [f"{i:064x}" for i in range(n)]
    levels = tree(leaves)
    for i, path in enumerate(merkle.traversed(leaves, len(levels) - 1)):
        at = i
        for (left, right), level in zip(path, levels):
            start = at // 8 * 8
            assert left == "".join(level[start:at]) and right == "".join(level[at + 1 : start + 8])
            at //= 8
        assert len(path) == len(levels) - 1
