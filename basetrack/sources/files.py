"""Readers of coverage files and of sample-set tables, and writers of BED, FASTA, YAML and TSV."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import masks
from ..operators.pca import Result
from ..plans.selection import Genome, Grouping

PROFILE_VERSION = 1
FIELDS = ("lower_coverage", "upper_coverage", "missing_cutoff", "max_missing_samples")


ENDING = r"(\.per-base)?\.(bed|bedgraph|bg)(\.gz)?$"


def sample_name(path: str) -> str:
    """The file's, or the folder's, name without .per-base and its ending."""
    return re.sub(ENDING, "", path.rstrip("/").rpartition("/")[2], flags=re.I)


def _sample(file_path: Column) -> Column:
    """As sample_name, of a scan's paths, which are written as in a URL; a file in a folder of a sample is that sample's."""
    path = F.url_decode(F.regexp_replace(file_path, r"\+", "%2B"))
    return F.regexp_extract(path, "(?i)([^/]*?)" + ENDING.replace("$", "") + "(/[^/]*)?$", 1)


# positions of a bin, and cells of a bin that a task fills at a time
BIN = 1 << 16
CELLS = 1 << 22
# cells of all bins of a task, about; runs are no more than these
TASK_CELLS = 1 << 23


def bedgraph(spark: SparkSession, *paths: str) -> DataFrame:
    """(contig, start, end, value) of bedGraph or per-base BED files."""
    return spark.read.csv(list(paths), sep="\t", comment="#", schema="contig string, start long, end long, value int")


def import_tracks(spark: SparkSession, paths: Sequence[str], genome: Genome, bin_size: int | None = None) -> DataFrame:
    """A wide track (contig_idx, lpos, pos, a column for each file) of runs of values; what no run covers is 0, where runs overlap they add up.

    All files are one scan.  Runs are cut at the borders of bins and dealt by
    bin, so as many rows are shuffled as there are runs; a task sweeps over a
    bin's run ends of all files at once and writes its positions in order.  A
    run beyond the end of its contig is an error; contigs that the genome
    doesn't have are left out.
    """
    names = [sample_name(p) for p in paths]
    if len(set(names)) != len(names):
        raise ValueError("two files have the same sample name")
    size = bin_size or max(256, min(BIN, CELLS // max(1, len(names))))
    contigs = [(c, i, genome.offsets[i], n) for i, (c, n) in enumerate(genome.lengths().items())]
    table = spark.createDataFrame(contigs, "contig string, contig_idx int, offset long, n long")
    bins = table.where("n > 0").select("contig_idx", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size))).alias("start"), "n")
    rows = bins.select("contig_idx", F.floor(F.col("start") / size).alias("bin"), "start", F.least(F.col("start") + size, "n").alias("end"), F.lit(-1).alias("file"), F.col("offset").alias("value"))
    if paths:
        file = F.array_position(F.array(*map(F.lit, names)), _sample(F.col("_metadata.file_path"))).cast("int") - 1
        runs = bedgraph(spark, *paths).select("*", file.alias("file")).where("end > start").join(F.broadcast(table), "contig")  # a row for each contig
        beyond = F.raise_error(F.concat(F.lit("a run ends beyond its contig: "), F.concat_ws(" ", "contig", "start", "end")))
        runs = runs.withColumn("end", F.when((F.col("end") <= F.col("n")) & (F.col("start") >= 0), F.col("end")).otherwise(beyond.cast("long")))
        cut = runs.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("bin"))
        rows = rows.unionByName(cut.select("contig_idx", "bin", F.greatest("start", F.col("bin") * size).alias("start"), F.least("end", (F.col("bin") + 1) * size).alias("end"), "file", F.coalesce("value", F.lit(0)).cast("long").alias("value")))

    def swept(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        head = part[part["file"] < 0].iloc[0]
        runs, start, n = part[part["file"] >= 0], int(head["start"]), int(head["end"] - head["start"])
        steps = np.zeros((n + 1, len(names)), np.int64)
        np.add.at(steps, (runs["start"].to_numpy() - start, runs["file"].to_numpy()), runs["value"].to_numpy())
        np.add.at(steps, (runs["end"].to_numpy() - start, runs["file"].to_numpy()), -runs["value"].to_numpy())
        lpos = np.arange(start, start + n)
        cells = pd.DataFrame(steps.cumsum(axis=0)[:n].astype(np.int32), columns=names)
        cells.insert(0, "pos", lpos + int(head["value"]))
        cells.insert(0, "lpos", lpos)
        cells.insert(0, "contig_idx", key[0])
        return cells

    fields = [T.StructField("contig_idx", T.IntegerType()), T.StructField("lpos", T.LongType()), T.StructField("pos", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in names]]
    # so many tasks that what one sorts doesn't grow with the genome; a number that is given isn't made smaller for small rows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-genome.size * len(names) // TASK_CELLS))
    return rows.repartition(tasks, "contig_idx", "bin").groupBy("contig_idx", "bin").applyInPandas(swept, T.StructType(fields))


def sample_sets(spark: SparkSession, path: str, columns: Sequence[str]) -> Grouping:
    """A table of white-space separated sample and set, without a header; it is as small as the samples are few."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    return Grouping.of(columns, [tuple(r) for r in rows.collect()])


def grouping_of(df: DataFrame, columns: Sequence[str], column: str = "sample", group: str = "sample_set") -> Grouping:
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is asked for")
    if lost := [c for c in (column, group) if c not in df.columns]:
        raise ValueError(f"the table has no column {', '.join(lost)}")
    return Grouping.of(columns, [tuple(r) for r in df.select(column, group).distinct().collect()])


def profile_to_yaml(profile: dict[str, dict[str, int]], dataset_id: str) -> str:
    sets = {n: {f: int(p[f]) for f in FIELDS} for n, p in profile.items()}
    return yaml.safe_dump({"schema_version": PROFILE_VERSION, "dataset_id": dataset_id, "sample_sets": sets}, sort_keys=False)


def profile_from_yaml(text: str) -> tuple[dict[str, dict[str, int]], str]:
    data = yaml.safe_load(text)
    if data.get("schema_version") != PROFILE_VERSION:
        raise ValueError(f"a profile of version {PROFILE_VERSION} is asked for")
    for name, p in data["sample_sets"].items():
        if set(p) != set(FIELDS):
            raise TypeError(f"the set {name} needs exactly: {', '.join(FIELDS)}")
    return data["sample_sets"], data["dataset_id"]


def profile_of_state(limits: dict[str, tuple[int, int]], max_missing: dict[str, int], grouping: Grouping, cutoff: int) -> dict[str, dict[str, int]]:
    """From the (lower, upper) and the missing samples that someone has set for each sample set; a set without them is a KeyError."""
    return {
        n: {"lower_coverage": int(limits[n][0]), "upper_coverage": int(limits[n][1]), "missing_cutoff": int(cutoff), "max_missing_samples": int(max_missing[n])}
        for n in grouping.members()
    }


def default_profile(limits: DataFrame, grouping: Grouping, cutoff: int) -> dict[str, dict[str, int]]:
    """From thresholds (a row for each set); half of a set's samples may be missing."""
    found = {r["sample_set"]: (r["lower"], r["upper"]) for r in limits.collect()}
    return profile_of_state(found, {n: len(c) // 2 for n, c in grouping.members().items()}, grouping, cutoff)


def bed(mask: DataFrame) -> DataFrame:
    """(value): lines of the runs of a mask, in genome order; a mask may be of positions or of runs."""
    runs = mask if "start" in mask.columns else masks.stored_runs(mask, {"": F.col("accessible")})
    return runs.orderBy("contig_idx", "start").select(F.concat_ws("\t", "contig", "start", "end").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One file of ``lines`` (value) in their order; the driver holds a partition at a time."""
    with open(path, "w") as f:
        for row in lines.toLocalIterator():
            f.write(row["value"] + "\n")


def write_bed(mask: DataFrame, path: str) -> None:
    """Tab-separated runs in genome order, as files in order in a folder."""
    bed(mask).write.text(path)


# what is written beside a mask; its name keeps it from being read as data
MASK_ATTRIBUTES = "_attributes"


def write_mask(mask: DataFrame, path: str, profile: dict[str, dict[str, int]], dataset_id: str, cutoffs: Sequence[int] | None = None) -> None:
    """A new mask, of positions or of runs, with what it was made of: the thresholds, and the cutoffs that took the place of theirs."""
    mask.write.mode("errorifexists").parquet(path)
    given = {"schema_version": PROFILE_VERSION, "thresholds": {"schema_version": PROFILE_VERSION, "dataset_id": dataset_id, "sample_sets": profile}}
    if cutoffs is not None:
        given["missing_cutoffs"] = sorted(set(cutoffs))
    row = mask.sparkSession.createDataFrame([(json.dumps(given),)], "value string")
    row.coalesce(1).write.text(f"{path}/{MASK_ATTRIBUTES}")


def mask_attributes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{MASK_ATTRIBUTES}/*.txt").first()[0])


def fasta(mask: DataFrame, genome: Genome, width: int = 70) -> DataFrame:
    """(value): FASTA lines in order; every contig has a header, one without positions an empty line."""
    heads = mask.sparkSession.createDataFrame([(i, -1, f">{c}") for i, c in enumerate(genome.contigs)], "contig_idx int, line long, value string")
    none = [(i, 0, "") for i, n in enumerate(genome.lengths().values()) if not n]
    bits = masks.lines_of_runs(mask, genome, width) if "start" in mask.columns else masks.lines(mask, width)
    rows = heads.unionByName(bits.select("contig_idx", "line", F.col("bits").alias("value")))
    if none:
        rows = rows.unionByName(mask.sparkSession.createDataFrame(none, "contig_idx int, line long, value string"))
    return rows.orderBy("contig_idx", "line").select("value")


def pca_tables(result: Result, k: int, grouping: Grouping | None = None) -> tuple[str, str]:
    """Scores and variances as TSV with eight significant digits."""
    k = min(k, len(result.columns))
    sets = ["sample_sets"] if grouping else []
    scores = ["\t".join(["sample", *sets, *[f"PC{i + 1}" for i in range(k)]])]
    for i, c in enumerate(result.columns):
        own = [",".join(grouping.of_column(c))] if grouping else []
        scores.append("\t".join([c, *own, *[f"{x:.8g}" for x in result.scores[i, :k]]]))
    variances = ["component\teigenvalue\texplained_variance_ratio"]
    variances += [f"PC{i + 1}\t{v:.8g}\t{r:.8g}" for i, (v, r) in enumerate(zip(result.eigenvalues[:k], result.ratios[:k]))]
    return "\n".join(scores) + "\n", "\n".join(variances) + "\n"
