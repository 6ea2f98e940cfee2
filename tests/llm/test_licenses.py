"""Where license notices are found and where not."""

import itertools
import random
import textwrap

import pytest

from basetrack.llm import licenses
from tests.llm.test_operators import brute_license

NOTICES = {label: text for label, text in licenses.TEMPLATES}


def scan(spark, texts):
    got = licenses.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    wrapped = ["\n".join(" * " + line for line in textwrap.wrap(mit, n)) for n in (20, 40, 72)]
    plain = "some plain words " * 100
    scattered = ["we discussed all the options and human rights, the place was reserved", " other words here ".join(mit.split())]
    texts = [*wrapped, plain + mit + plain, *scattered, mit[: len(mit) // 2], "", None]
    assert scan(spark, texts) == ["mit"] * 4 + [""] * 5


def test_every_template_is_found_in_any_place(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randint(0, 300)) + "\n" + text.upper() + " x" * rng.randint(0, 90) for _, text in licenses.TEMPLATES]
    for (label, _), found in zip(licenses.TEMPLATES, scan(spark, texts)):
        assert label in found.split(",")


def test_against_all_windows(spark):
    rng = random.Random(2)
    words = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_in(t)})
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            own = licenses.words_in(rng.choice(licenses.TEMPLATES)[1])
            kept = [w for w in own if rng.random() < 0.92]
            for _ in range(rng.randint(0, 5)):
                kept.insert(rng.randint(0, len(kept)), rng.choice([*words, "zz", "yy"]))
            parts += kept + rng.choices(words, k=rng.randint(0, 40))
        texts.append(" ".join(parts))
    assert scan(spark, texts) == [brute_license(t)[5] for t in texts]
    assert len(set(scan(spark, texts))) > 5


def test_positional_filter_and_clashing_columns(spark, monkeypatch):
    templates = [("a", "one two three four"), ("b", "five six seven eight nine ten"), ("c", "one six")]
    texts = [" ".join(p) for p in itertools.permutations("one two three four five".split(), 4)] + ["six one"] * 3 + ["five six seven eight nine ten " * 40]
    table = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, block int, need int, words string, label string")
    got = {(r["row_id"], r["label"]) for r in licenses.found(table, templates).collect()}
    expected = set()
    for (label, t), (i, text) in itertools.product(templates, enumerate(texts)):
        own, all_words = set(licenses.template_words(t)), text.split()
        if any(len(own.intersection(all_words[k : k + licenses.window(t)])) >= licenses.need(t) for k in range(len(all_words))):
            expected.add((i, label))
    assert got == expected and {label for _, label in got} == {"a", "b", "c"}
    monkeypatch.setattr(licenses, "MOST_WORDS", 5)
    with pytest.raises(ValueError, match="too many"):
        licenses.found(table, templates)


def test_near_templates_are_told_apart(spark):
    notices = dict.fromkeys(t for _, t in licenses.TEMPLATES)
    label = {t: x for x, t in licenses.TEMPLATES}
    texts = [f"before it {t} after it" for t in notices]
    base = {t: {x for phrase, x in licenses.PHRASES if phrase in " ".join(licenses.words_in(t))} for t in notices}
    assert scan(spark, texts) == [",".join(sorted({label[t]} | base[t])) for t in notices]
    assert scan(spark, ["Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY ND 4.0."]) == ["cc-by", "cc-by-nc", "cc-by-sa", ""]


def test_a_long_text(spark):
    """200,000 words with two notices far apart."""
    plain = "some plain words of a long text " * 15_000
    text = plain + licenses.TEMPLATES[1][1] + " " + plain + "Licensed under CC BY 4.0."
    (row,) = licenses.query(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["labels"] == "cc-by,mit" and row["n_words"] == 2 * 15_000 * 7 + 20 + 6
