"""Language identification: code lengths against a coder that counts one byte after the other, and held-out accuracy."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basetrack.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, coded string, score double, place long"


def counted(texts):
    out = collections.defaultdict(collections.Counter)
    for t in texts:
        b = bytes(langid.ORDER) + t.encode()
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                out[b[i - k : i]][b[i]] += 1
    return out


def cost(contexts, text):
    b, bits = bytes(langid.ORDER) + text.encode(), 0.0
    for i in range(langid.ORDER, len(b)):
        gone = set()
        for k in range(langid.ORDER, -1, -1):
            if b[i - k : i] not in contexts:
                continue
            left = {x: n for x, n in contexts[b[i - k : i]].items() if x not in gone}
            total = sum(left.values()) + len(left)
            if b[i] in left:
                bits += math.log2(total / left[b[i]])
                break
            if left:
                bits += math.log2(total / len(left))
            gone |= set(left)
        else:
            bits += math.log2(256 - len(gone))
    return bits


def test_code_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.sample(docs, 3000, 100_000).collect()
    trees = langid.train(docs, 3000, 100_000)
    assert set(trees) == {r["lang"] for r in rows} and max(sum(r["size"] for r in rows if r["lang"] == x) for x in trees) <= 3000
    contexts = {x: counted([r["text"] for r in rows if r["lang"] == x]) for x in trees}
    got = {r["doc_id"]: r for r in langid.predicted(docs, trees).collect()}
    coders = [langid.Coder(t) for t in trees.values()]
    for r in docs.select("doc_id", langid.letters().alias("text")).limit(20).collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        expected = [cost(contexts[x], r["text"]) for x in trees]
        assert np.allclose(langid.code_lengths(coders, data, np.array([len(data)]))[0], expected)
        total = {x: e + trees[x].bits for x, e in zip(trees, expected)}
        best = min(total, key=total.get)
        assert got[r["doc_id"]]["lang_pred"] == best
        assert math.isclose(got[r["doc_id"]]["score"], 1 / sum(2 ** min(0, total[best] - v) for v in total.values()))


def test_probabilities_sum_to_one(spark):
    """Of all bytes after any context: nothing is lost by escapes."""
    data = np.frombuffer(b"abracadabra abacus", np.uint8)
    codes, _ = langid.grams(data, np.array([len(data)]))
    names, counts = np.unique(codes, return_counts=True)
    coder = langid.Coder(langid.Tree.of(names, counts, 0.0))
    for context in (b"abra", b"xxab", b"zzzz", b"\0\0\0\0"):
        after = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert abs(np.exp2(-coder.bits(after)).sum() - 1) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pieces_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees = langid.train(docs, 20_000, 100_000)
    coders = [langid.Coder(t) for t in trees.values()]
    data = [r[0].encode() for r in docs.select(langid.letters()).limit(30).collect()]
    joint, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(t) for t in data])
    whole = langid.code_lengths(coders, joint, ends)
    monkeypatch.setattr(langid, "PIECE", 777)
    assert np.allclose(langid.code_lengths(coders, joint, ends), whole)


def odd(spark):
    en, fr = "The cat sat on the mat with the other cats. ", "Les chats sont assis sur le tapis avec les autres. "
    values = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)]
    values += [(100, None, "en"), (101, "", "en"), (102, " 123 ### \n", "fr"), (None, en, "xx"), (103, en * 4000, None), (104, fr * 4000, "qq"), (4, fr * 3, "fr"), (4, fr * 3, "fr"), (105, "THE CATS", None), (106, "你好", None)]
    return spark.createDataFrame([(i, t, x, "s", 1, "c", 0.5, 7) for i, t, x in values], SCHEMA)


def test_odd_rows(spark):
    """Nulls, texts without letters, repeated rows, a long text, an unlearned language, clashing names; an empty table; nothing learned."""
    docs = odd(spark)
    got = collections.defaultdict(list)
    for r in langid.query(docs).collect():
        got[r["doc_id"]].append((r["held_out"], r["lang_pred"], r["score"]))
    assert sum(map(len, got.values())) == docs.count() and len(got[4]) == 3
    for i in (100, 101, 102):
        assert got[i][0][1:] == ("und", 0.0)
    assert got[103][0][1] == "en" and got[105][0][1] == "en" and got[None][0][:2] == (False, "en")
    assert all(x[1] == ("en" if i % 2 else "fr") for i in range(40) for x in got[i])
    assert "xx" not in {x[1] for v in got.values() for x in v}
    assert langid.query(docs.limit(0)).collect() == []
    none = langid.query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "same words in both", x) for i in range(40) for x in ("b", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.query(docs).collect()} == {"a"}
