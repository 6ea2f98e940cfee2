"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that separate words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors reach.

    Only where that setting is unset and the session runs on this machine
    alone, as in tests, is a temporary folder taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="basetrack-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there stays."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new Parquet folder of the shared folder and read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


MOST_SENT = 1_000_000


def sent_if_few(small: DataFrame) -> DataFrame:
    """``small``, a table of a few numbers a row, written, and marked for broadcast if it has at most MOST_SENT rows.

    Beyond that the join it is for is left to the optimizer, which shuffles.
    """
    small = checkpointed(small)
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


SALTS = 1024
HOT_SHARE = 1000


def hot_left_join(rows: DataFrame, small: DataFrame, key: str, weight: str, total: int, *spread: str) -> DataFrame:
    """``rows`` left joined with ``small``, which has one row for each key and, in ``weight``, how many of ``total`` rows have it.

    A key is hot if more than one row in HOT_SHARE has it, so fewer than
    HOT_SHARE keys are, and these are broadcast.  Their rows are then dealt by
    the columns ``spread`` as well and the others by key, so no task has more
    than one row in HOT_SHARE for a single key, in one pass over ``rows``.  A
    null key has no match and is dealt like a hot one.
    """
    values = [c for c in small.columns if c not in (key, weight)]
    hot, salt = unused(rows, "hot"), unused(rows, "salt")
    warm = small.where(F.col(weight) * F.lit(HOT_SHARE) > F.lit(total)).select(key, F.struct(*values).alias(hot))
    marked = rows.join(F.broadcast(warm), key, "left")
    dealt = F.when(F.col(hot).isNull() & F.col(key).isNotNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    cold = small.select(key, F.lit(-1).alias(salt), *values)
    out = marked.withColumn(salt, dealt).join(cold.withColumnsRenamed({v: f"{v}_cold" for v in values}), [key, salt], "left")
    both = [F.when(F.col(hot).isNull(), F.col(f"{v}_cold")).otherwise(F.col(hot)[v]).alias(v) for v in values]
    return out.select(*rows.columns, *both)
