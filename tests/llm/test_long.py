"""Very long texts and the empty pipeline, for operators whose other tests have neither."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from basetrack.llm import quality, sharding, simhash
from tests.llm.test_operators import brute_counts, brute_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long():
    """450,000 words: more than two of the blocks in which they are hashed."""
    rng = random.Random(1)
    return " ".join(rng.choices(["Word", "wörd", "x" * 30, "a\nb", "The"], k=450_000))


def test_simhash_in_blocks(spark, long):
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.query(docs).collect()}
    assert {i: got[i]["fingerprint"] for i in (1, 2, 3)} == {i: f"{brute_simhash(t):016x}" for i, t in ((1, long), (2, long + " end"), (3, "short"))}
    assert got[4]["component_id"] == 1


def test_quality_of_a_long_text(spark, long):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, long, "en")], "doc_id long, text string, lang string")
    (row,) = quality.query(docs, labels).collect()
    assert tuple(row)[1:6] == brute_counts(long)


def test_a_long_text_in_its_shard(spark, long):
    rows = [(1, long)] + [(i, "t" * i) for i in range(2, 200)]
    got = {r["doc_id"]: r for r in sharding.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["size"] == len(long.encode()) + 16 and got[1]["text_crc32"] == zlib.crc32(long.encode())
    assert [i for i, r in got.items() if r["shard"] == got[1]["shard"]] == [1]


def test_an_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_pipeline_of_documents_without_text(spark, tmp_path):
    """Null and empty texts pass every stage; those with a doc_id are near duplicates of each other."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(4).withColumn("text", F.when(F.col("doc_id") % 2 == 0, ""))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["n_tokens"] == 0 for r in got)
