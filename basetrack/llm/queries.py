"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, html_text, langid, licenses, merkle, quality, sharding, simhash, spans, tiling, toxicity, trie, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_simhash": lambda s, d: simhash.query(table(s, d, "documents")),
        "op2_decontamination": lambda s, d: tiling.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_substring_dedup": lambda s, d: spans.query(table(s, d, "documents")),
        "op4_license_scan": lambda s, d: licenses.query(table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
        "op6_quality_rules": lambda s, d: quality.query(table(s, d, "documents"), table(s, d, "labels")),
        "op7_warc": lambda s, d: warc.query(table(s, d, "pages")),
        "op8_bpe": lambda s, d: bpe.query(table(s, d, "documents"), tokenizer_path()),
        "op9_sharding": lambda s, d: sharding.query(table(s, d, "documents")),
        "op10_html": lambda s, d: html_text.query(table(s, d, "pages")),
        "op11_langid": lambda s, d: langid.query(table(s, d, "documents")),
        "op12_prefix_trie": lambda s, d: trie.query(table(s, d, "conversations")),
        "op13_merkle": lambda s, d: merkle.query(table(s, d, "documents")),
        "pipeline": pipeline,
    }


def license_sql() -> str:
    """Every window of consecutive words against every template, without blocks, index or filters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda x: f"regexp_extract_all(translate({x}, '{upper}', '{lower}'), '{word}')"
    places, found = [], []
    for phrase, label in licenses.PHRASES:
        at = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"list_filter(range(len(ws)), lambda i: {at}) AS at_{label}")
        found.append(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END")
    of = [(label, licenses.template_words(text), licenses.need(text), licenses.window(text)) for label, text in licenses.TEMPLATES]
    templates = ", ".join(f"('{label}', [{', '.join(map(repr, words))}], {need}, {window})" for label, words, need, window in of)
    everywhere = " || ".join(f"at_{label}" for _, label in licenses.PHRASES)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, {words("text")} AS ws FROM t),
p AS (SELECT doc_id, len(ws) AS n_words, {", ".join(places)} FROM w),
h AS (SELECT doc_id, label, list_max(list_transform(list_filter(range(len(ws)), lambda i: list_contains(own, ws[i + 1])), lambda i: len(list_intersect(ws[i + 1 : i + size], own)))) AS most, len(own) AS n, need
  FROM w, (VALUES {templates}) AS v(label, own, need, size) WHERE len(list_intersect(ws, own)) >= need),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(most / n) AS c FROM h WHERE most >= need GROUP BY doc_id),
r AS (SELECT doc_id, n_words, {everywhere} AS places, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score FROM r LEFT JOIN g USING (doc_id)"""


def quality_sql() -> str:
    """Counts by unnesting all windows, bounds by summing the binomial distribution."""
    word = r"[^\x20\x09-\x0D]+"
    risk, rules = quality.RISK, quality.RULES
    feature = {
        "symbols": "n_symbols / greatest(word_chars, 1)",
        "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
        "repeats": "n_repeat_words / greatest(n_words, 1)",
        "long_words": "word_chars / greatest(n_words, 1)",
        "short_words": "-word_chars / greatest(n_words, 1)",
    }
    lax = lambda i, r: f"{i} + {len(rules)} * len(list_filter([{', '.join(map(str, rules[r]))}]::DOUBLE[], lambda x: CAST({feature[r]} AS DOUBLE) <= x))"
    step = f"least({', '.join(lax(i, r) for i, r in enumerate(rules))})"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}::DOUBLE) + (n - i) * ln(1 - {risk}::DOUBLE))))"
    return f"""WITH t AS (SELECT doc_id, coalesce('is ' || lang, 'null') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, text, regexp_extract_all(text, '{word}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
win AS (SELECT doc_id, i, ws[i + 1 : i + 5] AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 0))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
d AS (SELECT doc_id, stratum, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
c AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {step} AS step FROM d),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
s AS (SELECT stratum, nth, count(*) AS n, count(*) FILTER (step <= nth) AS k FROM c JOIN good USING (doc_id), (SELECT unnest(range({quality.STEPS})) AS nth) WHERE NOT base_failed GROUP BY ALL),
failed AS (SELECT stratum, min(nth) FILTER (k >= n * {risk} OR {tail} > {quality.DELTA} / (SELECT count(DISTINCT stratum) FROM s)) AS steps FROM s GROUP BY stratum)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND step >= coalesce(CASE WHEN f.stratum IS NULL THEN 0 ELSE coalesce(steps, {quality.STEPS}) END, 0) AS kept FROM c LEFT JOIN failed AS f USING (stratum)"""


def crc32_sql(number: str) -> str:
    """Of an integer's decimal text, a bit at a time."""
    bits = f"flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "(xor(c, x) >> 1)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor({step}, 3988292384) ELSE {step} END))"


def trie_sql() -> str:
    """Every prefix as a list of turns, every subtree by joining all prefixes of each node."""
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, unhex(md5(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text))) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - (conv_id % 100 + 100) % 100 AS base, {crc32_sql("conv_id")} % 6 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(o.own[1:h], []), h.own[h + 1:]) AS turns FROM h LEFT JOIN o ON o.conv_id = base),
m AS (SELECT conv_id, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM b)),
n AS (SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(path[-1].t), 0) AS own FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:d] AS path, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN s USING (path) LEFT JOIN n AS p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]"""


def merkle_sql() -> str:
    """Whole trees level by level; all siblings of each leaf by a join."""
    fields = lambda **other: " || ".join(f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-')" for x in (other.get(c, f"CAST({c} AS VARCHAR)") for c in merkle.FIELDS))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up = lambda name, of: f"{name} AS ({of} UNION ALL SELECT level + 1, part, i // 8, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY level, part, i // 8)"
    side = lambda sign: f"coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i {sign} x.i >> 3 * level), '')"
    path = lambda leaves, tree: f"SELECT x.part, x.i, level, {side('<')} AS a, {side('>')} AS b FROM {leaves} AS x JOIN {tree} AS t ON t.part = x.part AND n > 1 AND t.i >> 3 = x.i >> 3 * level + 3 GROUP BY ALL"
    return f"""WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '') AS part, sha256({fields()}) AS leaf,
  CASE WHEN {crc32_sql("doc_id")} % 3 = 0 THEN sha256({fields(text=lower)}) END AS now FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM f),
{up("t", "SELECT 0 AS level, part, i, leaf AS d, count(*) OVER (PARTITION BY part) AS n FROM l")},
s AS (SELECT '' AS part, part AS name, d, row_number() OVER (ORDER BY part) - 1 AS i FROM t WHERE n = 1),
{up("r", "SELECT 0 AS level, part, i, d, count(*) OVER () AS n FROM s")},
own AS ({path("l", "t")}), above AS ({path("s", "r")}),
p AS (SELECT part, i, list({{'a': a, 'b': b}} ORDER BY level) AS path FROM own GROUP BY ALL),
q AS (SELECT i, list({{'a': a, 'b': b}} ORDER BY level) AS path FROM above GROUP BY ALL),
e AS (SELECT l.*, s.d AS subroot, (SELECT d FROM r WHERE n = 1) AS root, coalesce(p.path, []) || coalesce(q.path, []) AS path
  FROM l JOIN s ON s.name = l.part LEFT JOIN p ON p.part = l.part AND p.i = l.i LEFT JOIN q ON q.i = s.i),
z AS (SELECT *, list_reduce(list_prepend({{'a': coalesce(now, leaf), 'b': ''}}, path), lambda c, x: {{'a': sha256(x.a || c.a || x.b), 'b': ''}}).a AS folded_root FROM e)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z"""


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_sql(), "op6_quality_rules": quality_sql(), "op12_prefix_trie": trie_sql(), "op13_merkle": merkle_sql()}
