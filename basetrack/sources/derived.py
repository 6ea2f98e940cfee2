"""A coverage track derived from orders and lineitem: contigs are priorities, samples are line numbers.

It is imported once a session into a store in the shared folder, sorted by
position, and read from there, so selections are pushed into the scan.
Positions are numbered within ranges of (contig, order) whose counts give the
offsets: no task sorts a contig.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.selection import Genome, Grouping
from .store import Entry, Store

SAMPLES = tuple(f"s{k}" for k in range(1, 8))
GROUPING = Grouping.of(SAMPLES, [("s1", "pop1"), ("s2", "pop1"), ("s3", "pop1"), ("s4", "pop2"), ("s5", "pop2"), ("s6", "pop3"), ("s7", "pop3")])
CUTOFFS = (3, 12)
_stores: dict[tuple[str, str], Store] = {}


def folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; only a session of this machine alone may do without that setting."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="basetrack-store-")
    return f"{shared.rstrip('/')}/derived-{uuid.uuid4().hex}"


def numbered(orders: DataFrame, path: str) -> tuple[DataFrame, Genome]:
    """(o_orderkey, contig, contig_idx, lpos, pos) of ``orders`` (o_orderkey, contig), and the genome; ``path`` is a new folder."""
    ranges = orders.repartitionByRange("contig", "o_orderkey").sortWithinPartitions("contig", "o_orderkey")
    # written, so that the numbers stay: a range's number in the upper bits, the place in it in the lower
    ranges.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    axis = orders.sparkSession.read.parquet(path).withColumn("range", F.shiftright("id", 33))
    counts = axis.groupBy("contig", "range").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("contig").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # a row for each contig, and a row for each range and contig in it
    genome = Genome.of((r[0], r[1]) for r in counts.groupBy("contig").agg(F.sum("n")).orderBy("contig").collect())
    contigs = [(c, i, genome.offsets[i]) for i, c in enumerate(genome.contigs)]
    table = orders.sparkSession.createDataFrame(contigs, "contig string, contig_idx int, start long")
    places = starts.join(F.broadcast(table), "contig").select("contig", "range", "first", "before", "contig_idx", "start")
    rows = axis.join(F.broadcast(places), ["contig", "range"])
    lpos = F.col("id") - F.col("first") + F.col("before")
    return rows.select("o_orderkey", "contig", "contig_idx", lpos.alias("lpos"), (F.col("start") + lpos).alias("pos")), genome


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The store with the track ``depth`` and its summaries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        path = folder(spark)
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("contig"))
        axis, g = numbered(orders, f"{path}-axis")
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        cell = lambda k: F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity")).otherwise(0)).cast("int").alias(f"s{k}")
        cells = lines.groupBy("l_orderkey").agg(*[cell(k) for k in range(1, 8)])
        rows = axis.join(cells, axis["o_orderkey"] == cells["l_orderkey"], "left")
        out = Store.create(spark, path)
        entry = Entry("depth", list(SAMPLES), list(g.contigs), list(g.offsets))
        out.write(entry, rows.select("contig_idx", "lpos", "pos", *[F.coalesce(s, F.lit(0)).alias(s) for s in SAMPLES]))
        out.preprocess("depth", GROUPING, CUTOFFS)
        _stores[key] = out
    return _stores[key]


def genome(spark: SparkSession, sf_dir: str) -> Genome:
    return store(spark, sf_dir).entries["depth"].genome


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).read("depth")
