"""WARC archives and shards against independent versions."""

import collections
import glob
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from basetrack.llm import sharding, warc

SF = "/root/testdata/sf0.001"


def test_revisits_of_a_whole_table(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    again = pages.select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")
    third = pages.where("page_id % 3 = 0").select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    hot = spark.range(2_000_000, 2_000_400).select(F.col("id").alias("page_id"), F.lit("http://hot.org/").alias("url"), F.lit("<p>" + "hot " * 100).alias("html"))
    table = pages.unionByName(again).unionByName(third).unionByName(hot)
    given = {r["page_id"]: r["html"] or "" for r in table.collect()}
    first = {}
    for i in sorted(given):
        first.setdefault(given[i], i)
    path = str(tmp_path / "archives")
    index = warc.archived(table.select("*", F.lit(1).alias("value"), F.lit(2).alias("first"), F.lit(3).alias("digest")).repartition(5), path, 20_000).collect()
    assert len(index) == len(given) and len(glob.glob(f"{path}/part-*")) > 5
    key = [tuple(r[c] for c in warc.KEY) for r in index]
    assert key == sorted(key) and len(set(key)) == len(key)
    for r in index:
        html = given[r["page_id"]]
        long = len(html.encode()) >= 100
        refers = first[html] if long and first[html] != r["page_id"] else None
        assert (r["record_type"], r["refers_to"]) == ("response" if refers is None else "revisit", refers)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
    # an archive is plain gzip, and a capture can be read by its place
    for r in random.Random(1).sample(index, 40):
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            data = f.read()
        headers, payload = warc.capture(data, r["offset"], r["length"])
        assert headers["warc-record-id"] == f"<urn:page:{r['page_id']}>"
        assert payload.decode() == (given[r["page_id"]] if r["refers_to"] is None else "")
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(x["archive"] == r["archive"] for x in index)


def test_long_records_are_of_several_members(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    data = warc.members(b"x" * 2500)
    assert data[-1] == 0 and [len(x) for *_, x in warc.inflated(data)] == [1000, 1000, 500]
    rng = random.Random(2)
    html = {1: "".join(rng.choices("abc<>/\r\n é", k=3_000_000)), 2: None, 3: "\r\n\r\n", 4: ""}
    table = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in html.items()], "page_id long, url string, html string")
    monkeypatch.undo()
    got = {r["page_id"]: r for r in warc.query(table).collect()}
    for i, h in html.items():
        assert got[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() and got[i]["payload_bytes"] == len((h or "").encode())


def test_runs_are_sorted_before_they_are_merged(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    monkeypatch.setattr(warc, "PIECE_ROWS", 7)
    rng = random.Random(3)
    rows = [(f"org,k{rng.randint(0, 30)})/", str(rng.randint(0, 9)), i, f"a{rng.randint(0, 3)}", i, 1, "response", None, 5, "x") for i in range(3000)]
    rows += [("org,hot)/", "5", 7, "a", 10_000 + i, 1, "response", None, 5, "x") for i in range(1500)]
    rng.shuffle(rows)
    merged = warc.merged_index(spark.createDataFrame(rows, warc.SORTED).repartition(6))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # behind the shuffle pieces alone are put in order, by run
    assert plan.count("Sort [") == 1 and "Sort [range" in plan
    got = list(map(tuple, merged.collect()))
    assert got == sorted(rows, key=lambda r: r[:5])


def brute_differencing(weights, k):
    """Sums of the shards, by lists of single partitions."""
    parts = [[w] + [0] * (k - 1) for w in weights]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = parts.pop(), parts.pop()
        parts.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True))])
    return sorted(parts[0])


def test_differencing_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        k = rng.choice([2, 3, 5, 8])
        weights = sorted((rng.randrange(10**12) for _ in range(rng.randint(1, 25))), reverse=True)  # no two spreads are equal
        sums, at = sharding.difference_groups(weights, k)
        assert sorted(sums.tolist()) == brute_differencing(weights, k)
        assert [sum(w for w, a in zip(weights, at) if a == s) for s in range(k)] == sums.tolist()


def test_rounds_of_differencing(spark):
    rng = random.Random(5)
    rows = [(i, "t" * rng.randint(1, 400) + str(i)) for i in range(3000)]
    rows += [(10_000 + i, "copy " * 20) for i in range(1500)] + [(None, None), (None, ""), (7, "x"), (7, "x")]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, rows int, shard int, digest int")
    one = sharding.sharded(table, 4).collect()
    many = sharding.sharded(table, 4, 64).collect()
    for got in (one, many):
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len(t or "") + 16) for i, t in rows)
        sums = collections.Counter()
        for r in got:
            sums[r["shard"]] += r["size"]
        total = sum(sums.values())
        hot = 1500 * 116
        assert hot > 0.15 * total and max(sums.values()) - min(sums.values()) <= 0.002 * total
        for s in sums:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        places = collections.defaultdict(set)
        for r in got:
            places[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(v) == 1 for v in places.values())
