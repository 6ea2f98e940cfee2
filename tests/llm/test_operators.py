"""Each operator against a brute-force version, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basetrack.llm import bpe, html_text, licenses, quality, sharding, simhash, spans, tiling, toxicity, warc
from basetrack.llm.components import connected_components
from basetrack.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, label string, row_id int, words string, `size` int, block int"
LONG = "The quick fox jumps over the lazy dog. It was not amused at all by this. " * 400


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    same = "one two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one. "
    values = [(1, same), (1, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "MIT License. Released under the MIT License."), (None, "no id here"), (None, None), (8, "one")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "s", len(t or ""), 0.5, "x", "y", 1, "z", 2, 3) for i, t in values], ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 1), (3, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1

def brute_simhash(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[ \t-\r]+", words) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    near = {i: [j for j in ids if (fps[i] ^ fps[j]).bit_count() <= 3] for i in ids}
    out = {}
    for i in ids:
        if i not in out:
            todo, out[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if j not in out:
                        out[j] = i
                        todo.append(j)
    return out


def test_simhash(docs, texts):
    got = {r["doc_id"]: r for r in simhash.query(docs).collect()}
    fps = {i: brute_simhash(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_simhash_links_all_near_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for n in (1, 2, 3, 3, 4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = connected_components(simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))).collect()
    joint = collections.defaultdict(set)
    for r in found:
        joint[r["component"]].add(r["node"] % (1 << 64))
    expected = collections.defaultdict(set)
    for i, c in brute_components({f: f for f in fps}).items():
        expected[c].add(i)
    assert {frozenset(v) for v in joint.values()} == {frozenset(v) for v in expected.values() if len(v) > 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def brute_wide(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    grams = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())
    counts, m64 = [0] * 512, (1 << 64) - 1
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for word in range(8):
            x = (h + (word + 1) * 0x9E3779B97F4A7C15) & m64
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m64
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m64
            x ^= x >> 31
            for k, byte in enumerate(x.to_bytes(8, "little")):
                for j in range(8):
                    counts[64 * word + 8 * k + j] += byte >> (7 - j) & 1
    bits = [2 * c > len(grams) for c in counts]
    return [sum(1 << b for b in range(32) if bits[32 * i + b]) for i in range(16)]


def test_wide_simhash(texts):
    for text in [*list(texts.values())[:25], None, "", "One two", "a b c d e " * 2000]:
        assert simhash.wide_simhash(text) == brute_wide(text)
    assert simhash.most_differing(0.8, 512) == 85


def test_candidates_connect_all_within_two_bits_of_a_band(spark):
    rng, rows = random.Random(3), []
    for i in range(150):
        old = rows[rng.randrange(len(rows))][1] if i % 3 else [rng.getrandbits(32) for _ in range(3)]
        rows.append((i, [v ^ sum(1 << b for b in rng.sample(range(32), rng.randint(0, 3))) for v in old]))
    got = {tuple(r) for r in simhash.candidates(spark.createDataFrame(rows, "node long, bands array<long>")).collect()}
    true = {(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if any((p ^ q).bit_count() <= 2 for p, q in zip(x, y))}

    def classes(links):
        label = list(range(len(rows)))
        for _ in rows:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert got <= true and classes(got) == classes(true)


def test_near_dedup_finds_edited_copies_and_keeps_the_rest(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, copies = [], set()
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(150, 400))]
        rows.append((i, " ".join(text)))
        for c in range(3):  # one edit in 100 words leaves about 90 % of the shingles
            edited = list(text)
            for k in rng.sample(range(len(text)), len(text) // 100):
                edited[k] = "edited"
            rows.append((1000 + 3 * i + c, " ".join(edited)))
            copies.add(1000 + 3 * i + c)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.near_dedup(table).collect()}
    assert kept == set(range(60))
    prints = {i: brute_wide(t) for i, t in rows}
    near = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(prints[i], prints[j])) <= 85
    for r in simhash.near_classes(table).collect():
        assert r["doc_id"] == r["component_id"] or any(near(r["doc_id"], j) for j in prints if j != r["doc_id"])


def brute_jaccard(x, y):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def test_near_dedup_keeps_a_family_below_the_threshold(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage = " ".join(word() for _ in range(170))
    rows = [(i, f"{passage} {' '.join(word() for _ in range(30))}") for i in range(60)]
    assert max(brute_jaccard(x, y) for (_, x), (_, y) in itertools.combinations(rows, 2)) < 0.8
    rows += [(100, rows[7][1] + " tail"), (7, "another text of the same id")]
    long = [word() for _ in range(150_000)]  # compared in pieces
    rows += [(200, " ".join(long)), (201, " ".join(long[10_000:])), (202, " ".join(long[:100_000] + [word() for _ in range(50_000)]))]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(60), 7, 200, 202])


def test_near_dedup_finds_copies_within_a_family(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage = " ".join(word() for _ in range(160))
    rows = [(i, f"{passage} {' '.join(word() for _ in range(40))}") for i in range(200)]
    rows += [(1000 + i, f"{rows[i][1]} {word()} {word()}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    # one band and no keys, so that a pair has one chance to meet
    value, text, label = {i: simhash.wide_simhash(t, 5, 1)[0] for i, t in rows}, dict(rows), {i: i for i, _ in rows}
    true = [(i, j) for i, j in itertools.combinations(text, 2) if (value[i] ^ value[j]).bit_count() <= 2 and brute_jaccard(text[i], text[j]) >= 0.8]
    for i, j in true:
        label = {k: min(label[i], label[j]) if x in (label[i], label[j]) else x for k, x in label.items()}
    assert len(true) > 50 and dict(rows_of(simhash.near_classes(table, bands=1, keys=0))) == label


def test_near_dedup_tries_few_centers_of_a_large_family(spark, monkeypatch):
    """Texts of one family meet in nearly each band; before whole places are compared each is paired with few of those centers, the one met most often first."""
    rng, pairs = np.random.default_rng(9), []
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if rng.random() > 0.06 else f"x{k}y{i}" for i, w in enumerate(base)) for k in range(60)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, texts[7] + " end", texts[8] + " end"])], "doc_id long, text string")
    joined_by = simhash.joined_by
    monkeypatch.setattr(simhash, "joined_by", lambda found, some: pairs.append(some) or joined_by(found, some))
    got = dict(simhash.near_classes(docs).collect())
    assert got[60] == got[7] and got[61] == got[8]
    per_node = [r["count"] for r in pairs[0].groupBy("b").count().collect()]
    assert per_node and max(per_node) <= 3


def test_near_dedup_finds_isolated_pairs_at_the_threshold(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows = []
    for i in range(150):
        text = [word() for _ in range(rng.choice([13, 60, 200]))]
        more = [word() for _ in range((len(text) - 4) // 4)]  # so many shingles more leave 0.8 or a little more
        rows += [(i, " ".join(text)), (1000 + i, " ".join(text + more))]
        assert 0.8 <= brute_jaccard(rows[-2][1], rows[-1][1]) < 0.83
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(150))


# 2

def test_tiling_brute():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 25))] for _ in range(2))
        k = min(3, len(b))
        taken_a, taken_b, expected = set(), set(), 0
        while True:  # greedy tiling as it is defined
            best = None
            for p, q in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in taken_a and q + n not in taken_b:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, p, q)
            if best is None:
                break
            taken_a.update(range(best[1], best[1] + best[0]))
            taken_b.update(range(best[2], best[2] + best[0]))
            expected += best[0]
        found = tiling.tiles(np.array(a), np.array(b), 3)
        assert sum(n for n, _, _ in found) == expected
        for n, p, q in found:
            assert a[p : p + n] == b[q : q + n]


def test_leaks(spark, docs):
    item = "alpha beta gamma delta epsilon zeta. eta theta iota kappa lambda mu"
    first, second = item.split(". ")
    some = [(1, f"before {second.upper()} between {first} after"), (2, first), (3, "alpha beta gamma"), (4, None), (5, ""), (None, item)]
    bench = spark.createDataFrame([(7, item), (7, item), (8, "short one"), (9, None), (10, "")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["n_tiles"]) for r in tiling.leaks(spark.createDataFrame(some, "doc_id long, text string"), bench, block_bytes=60).collect())
    assert got == [(0, 7, 1), (1, 7, 2)]
    kept = tiling.decontaminate(spark.createDataFrame(some, "doc_id long, text string"), bench)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 5]


# 3

def test_spans_brute(docs, texts):
    first = {}
    for i in sorted(texts):
        for h, h2, start, _ in spans.spans(texts[i], spans.MIN_WORDS):
            first.setdefault((h, h2), (i, start))
    for i, t in texts.items():
        assert "".join(spans.sentences(t)) == t
    expected = {}
    for i, t in texts.items():
        runs = [(s, n) for h, h2, s, n in spans.spans(t, spans.MIN_WORDS) if first[h, h2] != (i, s)]
        gone = {k for s, n in runs for k in range(s, s + n)}
        expected[i] = "".join(x for k, x in enumerate(spans.sentences(t)) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in spans.query(docs).collect()} == expected
    assert {r["doc_id"]: r["text"] for r in spans.substring_dedup(docs).collect()} == expected


def test_passage_goes_wherever_it_stands(spark):
    passage = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(60))
    rows = [(1, f"Some start here. {passage} And an end."), (2, f"other words before {passage} other words behind"), (3, "Clean text of its own.")]
    got = {r["doc_id"]: r["text"] for r in spans.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and len(got[2].split()) < 30


def test_passage_goes_to_its_last_sentence(spark):
    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n)) + ". "
    passage = "".join(say(f"s{k}x", n) for k, n in enumerate([12, 12, 12, 12, 4]))
    han = "".join(chr(0x4E00 + 7 * i) + ("\u3002" if i % 9 == 8 else "") for i in range(54))
    token = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(20))
    rows = [(1, passage + say("a", 15)), (2, say("b", 15) + passage + say("c", 15)), (3, han), (4, "\u6587\u3002" + han + "\u6587"), (5, token), (6, "zz" + token)]
    got = {r["doc_id"]: r["text"] for r in spans.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == say("b", 15) + say("c", 15) and got[4] == "\u6587\u3002\u6587" and len(got[6]) < 400
    assert all(got[i] == dict(rows)[i] for i in (1, 3, 5))
    for text in (han, token, "a" * 500, " b " * 99):
        assert "".join(spans.sentences(text)) == text


# 4

def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [(i, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    more = set()
    for label, t in licenses.TEMPLATES:
        w = set(licenses.template_words(t))
        if any(len(w.intersection(words[i : i + licenses.window(t)])) >= licenses.need(t) for i in range(len(words))):
            more.add(label)
    starts = [p for p, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


def test_licenses(spark, docs, odd):
    extra = spark.createDataFrame([(-1, "x MIT  license, mit-License mit license\nThe General Public License"), (-2, "Licensed under CC BY-NC 4.0."), (-3, "mİt license mKt licenseé")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(extra), odd):
        given = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in licenses.query(df).collect():
            if r["doc_id"] is not None:
                assert tuple(r)[1:7] == brute_license(given[r["doc_id"]])
                assert 0 <= r["score"] <= 1


# 5

def test_toxicity_generalises():
    rng = random.Random(1)
    plain = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["zykwurm" + e for e in ("", "s", "er", "ing", "ed", "ish", "ly")]
    make = lambda toxic, words: " ".join(rng.choice(words) if toxic and k % 9 == 4 else rng.choice(plain) for k in range(40))
    train = [(make(t, bad), t) for t in [1, 0, 0] * 60]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    unseen = ["zykwurmish", "zykwurmness", "xzykwurm"]
    toxic, clean = ([model.score(make(y, unseen), {}) for _ in range(40)] for y in (1, 0))
    ordered = np.mean([t > c for t in toxic for c in clean])
    assert np.mean(toxic) >= toxicity.THRESHOLD > max(clean) and ordered >= 0.97
    assert toxicity.fit(["a b"], [0]).score("a b", {}) == 0.0


def test_toxicity_knows_a_word_that_few_rows_have():
    rng = random.Random(2)
    plain = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    make = lambda bad: " ".join(bad if bad and k % 9 == 4 else rng.choice(plain) for k in range(40))
    bad = [*["zykwurm"] * 55, *["qohxavy"] * 5]
    model = toxicity.fit([make(b) for b in [*bad, *[""] * 120]], [1] * 60 + [0] * 120)
    toxic, clean = ([model.score(make(b), {}) for _ in range(40)] for b in ("qohxavy", ""))
    assert min(toxic) >= toxicity.THRESHOLD > max(clean)
    assert {"<z", "zykw", "zykwur"} & toxicity.grams_of("zykwurm") == {"zykw", "zykwur"}


def test_toxicity_separates():
    rng = random.Random(1)
    plain = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    bad = ["zykwurm" + e for e in ("", "s", "er", "ing", "ed", "ish", "ly")]
    make = lambda toxic, words: " ".join(rng.choice(words) if toxic and k % 9 == 4 else rng.choice(plain) for k in range(40))
    train = [(make(t, bad), t) for t in [1, 0, 0] * 60]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    toxic, clean = ([model.score(make(y, ["zykwurmish", "zykwurmness", "xzykwurm"]), {}) for _ in range(40)] for y in (1, 0))
    assert np.mean(toxic) >= 0.7 and min(toxic) > max(clean) and max(clean) < 0.3


def test_toxicity_query(spark):
    rows = toxicity.query(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


# 6

def brute_counts(t):
    w = [x for x in re.split("[ \t-\r]+", t or "") if x]
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search("[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, odd, labels):
    for df in (docs, odd):
        given = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in quality.query(df, labels).collect():
            if r["doc_id"] is not None:
                expected = brute_counts(given[r["doc_id"]])
                assert tuple(r)[1:6] == expected
                assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
                assert not (r["base_failed"] and r["kept"])


def test_binomial_bounds(spark):
    cases = [(1000, 0, 0.01), (1000, 3, 0.01), (2500, 12, 0.01), (50, 0, 0.01), (100, 5, 0.04)]
    for n, k, p in cases:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.createDataFrame([(n, k)], "n long, k long").select(quality.binomial_tail(F.col("n"), F.col("k"), p)).first()[0]
        assert got == pytest.approx(1.0 if k >= n * p else exact, rel=1e-9)


def test_cutoffs_reject_junk_alone(spark):
    clean = [(i, f"{' '.join(f'w{i}x{j}' for j in range(30))}", "en") for i in range(4000)]
    junk = [(i, " ".join(f"w{i}x{j}###%%%&&&" for j in range(30)), "en") for i in range(4000, 4050)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i < 4000)) for i in range(4050)], "doc_id long, quality int")
    got = quality.query(df, lab).collect()
    assert all(r["kept"] == (r["doc_id"] < 4000) for r in got)


# 7

def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 8))) for _ in range(k)]
        got = [p[1] for p in warc.LoserTree([iter([warc._Pair((v, (v, i))) for v in r]) for i, r in enumerate(runs)])]
        assert got == sorted((v, i) for i, r in enumerate(runs) for v in r)


def test_warc(spark):
    page = "<html>" + "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3\r\n</html>"
    rows = [(3, "http://www.b.org/x#f", page), (1, "http://b.org/x", page), (2, "http://a.org", page + "!"), (4, None, None), (5, "http://a.org", "tiny"), (6, "http://a.org", "tiny"), (None, "u r\nl", "x"), (1, "http://b.org/x", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.query(df).collect()
    key = [(r["url_key"], r["timestamp"], r["page_id"] or 1 << 62) for r in got]
    assert key == sorted(key) and len(got) == len(rows)
    for r in got:
        payload = {i: h for i, _, h in rows}[r["page_id"]] or ""
        assert r["payload_bytes"] == len(payload.encode()) and r["payload_digest"] == hashlib.sha256(payload.encode()).hexdigest()
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit") == [(3, 1)]


# 8

def test_bpe_tree():
    path, rng = tokenizer_path(), random.Random(4)
    pieces = ["a", "  ", "\n", "é", "<|endoftext|>", "<|endof", "text|>", "'s", "12", "日本", "!", "🙂", " b", "\t", "zz" * 30]
    for k in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 300)))
        assert bpe.encode_by_tree(text, path, rng.choice([1, 3, 17, 64])) == bpe.encode(text, path)
    assert bpe.encode_by_tree("a" * 5000, path, 100) == bpe.encode("a" * 5000, path)


def test_bpe(spark, docs, odd):
    path = tokenizer_path()
    for df, leaf in ((docs, 500), (odd, bpe.LEAF), (odd, 1000)):
        given = collections.Counter(((r["doc_id"], r["text"] or "") for r in df.collect()))
        expected = []
        for (i, t), n in given.items():
            ids = bpe.encode(t, path)
            decoded = bpe.tokenizer(path).decode(ids, skip_special_tokens=False)
            expected += [(i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] * n
        got = rows_of(bpe.encoded(df, path, leaf, with_ids=False))
        assert sorted(got, key=str) == sorted(expected, key=str)


# 9

def test_differencing():
    rng = random.Random(6)
    for _ in range(30):
        weights = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        sums, at = sharding.difference_groups(weights, 4)
        again = [sum(w for w, a in zip(weights, at) if a == s) for s in range(4)]
        assert again == sums.tolist()
        if len(weights) > 30:
            assert max(again) - min(again) <= 20


def test_sharding(docs, odd):
    for df, block in ((docs, 10_000), (docs, 20), (odd, 10_000)):
        rows = sharding.sharded(df, 8, block).collect()
        assert len(rows) == df.count()
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        groups = collections.defaultdict(set)
        for r in rows:
            groups[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(v) == 1 for v in groups.values())
    sums = collections.Counter()
    for r in sharding.sharded(docs, 4).collect():
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values())


# 10

def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href="/a">menu</a></ul></nav>
    <div id="cookie-notice">We use cookies</div><div class="layout"><div class="sidebar"><p>side text <a href=x>l</a></p></div>
    <div class="post-content-12"><h1>T &lt;1&gt;</h1><p>Hello&nbsp;<b>wor</b>ld   a<br>b<p>second, text long enough to be a paragraph.<ul><li>one<li>two</ul>
    <div class="ad-box">Buy</div><form>f<input></form><script>var a="</p>"</script><!-- no --><div class="comments"><p>First!</p></div></div></div><footer>f</footer></body></html>"""
    path = html_text.best(page)[0]
    assert html_text.text_at(page, path) == "T <1>\nHello world a b\nsecond, text long enough to be a paragraph.\none\ntwo"
    assert html_text.text_at(None, None) == "" and html_text.text_at("a &amp; b <", None) == "a & b <"


def test_hosts_decide(spark):
    text = "<p>" + "long words of an article, " * 12 + "</p>"
    usual = f'<html><body><div class="main-text">{text}</div><div class="extra"><p>short words</p></div></body></html>'
    unusual = f'<html><body><div class="main-text"><p>tiny article</p></div><div class="extra">{text}</div></body></html>'
    rows = [(i, "http://h.org/" + str(i), usual) for i in range(5)] + [(9, "http://h.org/9", unusual), (10, "http://i.org/", unusual), (11, None, None)]
    got = {r["page_id"]: r for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9]["text"] == "tiny article" and got[10]["text"].startswith("long words") and got[11]["text"] == "" and got[11]["n_chars"] == 0


# all

def test_odd_rows(spark, odd, labels):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert len(rows_of(simhash.query(odd))) == 11
    assert simhash.near_dedup(odd).columns == odd.columns
    # the id of a kept document stays, as do rows without an id
    assert sorted(r["doc_id"] or 0 for r in simhash.near_dedup(odd).collect()) == [0, 0, 1, 1, 3, 6, 7, 8]
    kept = {(r["doc_id"], r["text"]) for r in spans.substring_dedup(odd).collect()}
    assert (2, "") in kept and len(spans.substring_dedup(odd).collect()) == 11
    assert sorted(r["doc_id"] or 0 for r in tiling.decontaminate(odd, bench).collect()) == [0, 0, 3, 4, 5, 6, 7, 8]
    assert toxicity.drop_toxic(odd, labels).count() == 11
    assert len(rows_of(toxicity.query(odd, labels))) == 11
    assert spans.substring_dedup(odd).columns == odd.columns


@pytest.mark.parametrize("name", [n for n in queries() if n != "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).collect() == []


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    frame = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, frame, SF)
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert frame.schema.fieldNames() == docs.schema.fieldNames()
        assert 0 < frame.count() <= before.count()
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["ids_sha256"] for r in frame.collect()}


# very long texts, clashing columns, and hot keys

def test_bpe_parts_are_those_of_the_whole_text():
    path, rng = tokenizer_path(), random.Random(7)
    letters = [*" \n\t\r ab'st019é\x1c\x1f\x85\xa0 　 中!<|🙂​", "<|endoftext|>", "  ", "\n\n", " the", "'ll", "x" * 80]
    known = {}
    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(8)]
        got = bpe.encoded_texts(texts, path, known)
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [bpe.encode(t, path) for t in texts]
        assert all(len(p) <= bpe.KNOWN_CHARS for p in known)
    assert bpe.encoded_texts([], path, {}) == [] and bpe._digests([], path)[0] == []


def test_spans_of_a_hot_passage_over_many_ranges(spark):
    passage = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(45)) + ". "
    rows = [(i, f"{passage}Own{i} words{i} end{i}. ") for i in range(400)] + [(0, f"{passage}Own0 words0 end0. ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = collections.Counter(tuple(r) for r in spans.substring_dedup(table).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == collections.Counter([(i, t if i == 0 else f"Own{i} words{i} end{i}. ") for i, t in rows])


def test_substring_dedup_keeps_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" + ("." if i % 10 == 9 else "") for i in range(400_000))
    rows = [(1, long, 5, 6, 7, 8, "x"), (2, "Own words of this one. " + long, 5, 6, 7, 8, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row_id int, row_text int, runs int, _runs int, H string")
    got = {r["doc_id"]: r for r in spans.substring_dedup(table).collect()}
    assert got[1].asDict() == dict(zip(table.columns, rows[0])) and got[2].asDict() == dict(zip(table.columns, rows[1])) | {"text": "Own words of this one. "}
