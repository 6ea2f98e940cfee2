"""Toxicity against a slow scorer of its own, and on held-out labels."""

import collections
import math
import re
import zlib

from basetrack.llm import toxicity


def slow_score(model, text):
    """Every window from every half-window start, word by word, from the weights alone."""
    words = re.findall(r"\w+", (text or "").lower())
    of_word = []
    for w in words:
        marked, grams = f"<{w}>", set()
        for n in (3, 4, 5, 6, len(marked)):
            for i in range(len(marked) - n + 1):
                grams.add(marked[i : i + n])
        of_word.append(sum(model.weights.get(g, 0.0) for g in grams) / len(grams))
    size = min(toxicity.WINDOW, len(words))
    best = max((sum(of_word[i : i + size]) / size for i in range(len(words) - size + 1)), default=0.0) if size else 0.0
    z = best + model.bias
    return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def rows(spark, sf):
    folder = f"/root/testdata/{sf}"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_scores_are_those_of_a_slow_scorer(spark):
    docs, labels = rows(spark, "sf0.01")
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (-4, "idiot trash " + "plain words " * 50_000)], "doc_id long, text string")
    texts |= {r["doc_id"]: r["text"] for r in extra.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.select("doc_id", "text").unionByName(extra), model).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert math.isclose(got[i], slow_score(model, text), abs_tol=1e-9), i


def test_held_out_recall(spark):
    """Nine of ten toxic rows that training never saw, and no more than one clean one in a hundred."""
    docs, labels = rows(spark, "sf0.1")
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    found = collections.Counter()
    for r in labels.where("toxic IS NOT NULL").collect():
        p = got.get(r["doc_id"])
        if p is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1:
            assert p["held_out"]
            found[r["toxic"], p["predicted"]] += 1
    assert found[1, 1] >= 0.9 * (found[1, 0] + found[1, 1]) and found[0, 1] < 0.01 * (found[0, 0] + found[0, 1])


def test_every_telling_word_counts():
    """Words that always stand beside stronger ones are learned all the same."""
    words = ["aaaaka", "bbbbko", "ccccku", "ddddki"]
    clean = [f"plain word{i % 17} text{i % 23} more{i % 7}" for i in range(200)]
    toxic = [f"{t} {' '.join(words)} {t}" for t in clean[:60]]
    model = toxicity.fit(clean + toxic, [0] * 200 + [1] * 60)
    assert min(model.word(w) for w in words) > 3 > max(model.word(w) for w in "plain word3 text9 more2".split())
