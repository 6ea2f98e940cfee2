"""Quality rules with risk-controlled thresholds.

Counts of each text are taken inside its row by array functions: nothing is
exploded, so a text of any length stays one row.  Repeated word windows are
found by sorting their 64-bit hashes; only texts that have some sort places
along with them.

Each rule rejects a text whose feature is above a cutoff.  Cutoffs come from
fixed grids and are tightened in a fixed order: all rules by one place from lax
to strict, one rule after the other, then by the next place.  After each step
the rules *together* are tested on labelled holdouts: documents labelled good
(``quality`` 1) that pass the base rule, per stratum (``lang``).  With k of n of
them rejected, the exact binomial tail P(X <= k), X of n trials at ``RISK``, is
the p-value of "these cutoffs reject more than RISK of the good documents".
The steps are a fixed sequence of hypotheses, so each may be tested at the whole
level and testing ends at the first that fails; over strata the level is
``DELTA`` divided by their number (Bonferroni).  So with probability 1 - DELTA
no stratum falsely rejects more than RISK of its good documents.  A stratum with
too few labels (about ln(strata / DELTA) / RISK) certifies nothing and rejects
nothing beyond the base rule.

Features are computed once and written to the shared checkpoint folder as a
small row for each document; calibration is one pass with combined partial
counts, a row for each stratum.

Rows: null texts count as having no words and fail the base rule; a null lang
is a stratum of its own, apart from that of the empty string; documents with contradicting labels are not used;
repeated rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

RISK = 0.02
DELTA = 0.05
SPACE = r"[\x20\x09-\x0D]+"

# The rules in the order in which they are tightened: feature, and the grid of cutoffs from strict to lax, equally many each.
RULES = {
    "symbols": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeats": [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18],
    "long_words": [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 16.0, 24.0],
    "short_words": [-4.5, -4.0, -3.75, -3.5, -3.25, -3.0, -2.75, -2.5, -2.0, -1.5],
}


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_or_empty().cast("string").alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    bytes_of_symbols = F.octet_length("text") - F.octet_length(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    rows = rows.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        bytes_of_symbols.cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    return _with_repeats(rows)


def _with_repeats(rows: DataFrame, width: int = 5) -> DataFrame:
    """Adds n_repeat_words from the word hashes, and drops them."""
    n = F.size("hashes")
    window = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(width)]))
    rows = rows.withColumn("windows", F.when(n >= width, window).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    rows = rows.withColumn("sorted", F.sort_array("windows"))
    # array neighbours are compared by zipping, which ends with a null
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    any_twice = F.exists(F.zip_with("sorted", rest("sorted"), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
    rows = rows.withColumn("twice", any_twice).drop("sorted")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.col("twice"), placed)).drop("windows")
    after = F.transform(F.zip_with("placed", rest("placed"), lambda a, b: a["h"] == b["h"]), lambda x: F.coalesce(x, F.lit(False)))
    rows = rows.withColumn("after", after)
    before = F.concat(F.array(F.lit(False)), F.slice("after", 1, F.greatest(F.size("after") - 1, F.lit(0))))
    rows = rows.withColumn("either", F.zip_with("after", before, lambda a, b: a | b)).drop("after")
    both = F.zip_with("placed", "either", lambda p, e: F.when(e, p["i"]))
    rows = rows.withColumn("places", F.sort_array(F.array_compact(both))).drop("placed", "either")
    steps = F.zip_with("places", rest("places"), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places", "twice")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for n trials of probability p, exactly summed; 1 where k is the mean or more, as no test can pass there."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        F.struct((n * F.log1p(F.lit(-p))).alias("log"), F.exp(n * F.log1p(F.lit(-p))).alias("sum")),
        lambda s, i: _next_term(s, i, n, k, p),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(terms["sum"])


def _next_term(s: Column, i: Column, n: Column, k: Column, p: float) -> Column:
    log = s["log"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
    return F.struct(log.alias("log"), F.when(i <= k, s["sum"] + F.exp(log)).otherwise(s["sum"]).alias("sum"))


STEPS = sum(map(len, RULES.values()))


def step() -> Column:
    """The step that first rejects a text, from 0; STEPS or more if none does."""
    found = features()
    lax = [F.lit(len(RULES)) * sum((found[name] <= c).cast("int") for c in grid) + i for i, (name, grid) in enumerate(RULES.items())]
    return F.least(*lax)


def certified(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, steps): how many steps each stratum that has labels may take.

    ``counted`` has doc_id, stratum and the counts.
    """
    agreed = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    good = agreed.where("quality = most and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    holdout = counted.where(~base_failed()).select("doc_id", "stratum", step().alias("step")).join(good, "doc_id")
    rejected = [F.sum((F.col("step") <= i).cast("long")).alias(f"_{i}") for i in range(STEPS)]
    strata = checkpointed(holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *rejected))
    level = delta / max(1, strata.count())
    passes = F.array(*[binomial_tail(F.col("n_good"), F.col(f"_{i}"), risk) <= level for i in range(STEPS)], F.lit(False))
    return strata.select("stratum", "n_good", (F.array_position(passes, False) - 1).cast("int").alias("steps"))


def cutoffs(known: DataFrame) -> DataFrame:
    """(stratum, n_good, steps, the cutoff of each rule or null) of what ``certified`` gives."""
    chosen = [F.get(F.array(*map(F.lit, reversed(grid))), F.floor((F.col("steps") - 1 - i) / len(RULES)).cast("int")).alias(f"cutoff_{name}") for i, (name, grid) in enumerate(RULES.items())]
    return known.select("stratum", "n_good", "steps", *chosen)


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts, base_failed and kept of every row of ``docs``."""
    stratum = F.coalesce(F.concat(F.lit("is "), F.col("lang").cast("string")), F.lit("null"))
    counted = checkpointed(counts(docs.select("doc_id", "text", stratum.alias("stratum")), "stratum"))
    rows = counted.join(certified(counted, labels, risk, delta), "stratum", "left")
    kept = ~base_failed() & (step() >= F.coalesce("steps", F.lit(0)))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", kept)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
