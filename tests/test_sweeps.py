"""Runs by a carried scan, imports by bins, moments merged in a tree, intervals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basetrack.__main__ import main
from basetrack.operators import masks, pca
from basetrack.plans import rewrite
from basetrack.plans.bundle import Pages
from basetrack.plans.selection import Coordinates, Genome, Grouping, Intervals
from basetrack.sources import derived, files
from basetrack.sources.store import Entry, Store

SF = "/root/testdata/sf0.001"


def runs_of(rows, k):
    out, start, before = set(), None, None
    for r in [*sorted(rows), None]:
        if start is not None and (r is None or r[:2] != (before[0], before[1] + 1) or not r[2 + k]):
            out.add((before[0], start, before[1] + 1))
            start = None
        if r is not None and r[2 + k] and start is None:
            start = r[1]
        before = r
    return out


@pytest.mark.parametrize("partitions, batch", [(1, "3"), (7, "5"), (7, "10000")])
def test_carried_runs(spark, partitions, batch):
    rng = random.Random(partitions)
    rows = [(c, p, rng.random() < 0.8, rng.random() < 0.2) for c in (0, 1, 5) for p in range(60) if rng.random() < 0.97]
    rows += [(7, p, True, False) for p in range(200)] + [(8, 0, True, True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        table = spark.createDataFrame(rows, "contig_idx int, lpos long, f boolean, g boolean").withColumn("contig", F.concat(F.lit("c"), "contig_idx"))
        flags = {"f": F.col("f"), "g": F.col("g"), "null": F.lit(None).cast("boolean")}
        for df in (table.repartitionByRange(partitions, "contig_idx", "lpos").sortWithinPartitions("contig_idx", "lpos"), table.repartition(partitions)):
            got = masks.stored_runs(df, flags).collect()
            for k, name in enumerate("fg"):
                assert {(r["contig_idx"], r["start"], r["end"]) for r in got if r["name"] == name} == runs_of(rows, k)
            assert {r["name"] for r in got} == {"f", "g"} and all(r["contig"] == f"c{r['contig_idx']}" for r in got)
        assert masks.stored_runs(table.limit(0), flags).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_position_is_shuffled(spark):
    """One scan, and one exchange that takes runs: fewer rows than positions."""
    track = derived.store(spark, SF).read("depth")
    got = masks.stored_runs(track, {"x": F.col("s1") > 3})
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and text.index("Exchange") < text.index("MapInArrow") < text.index("FileScan")


def test_whole_runs_are_packed_before_they_are_sorted(spark, monkeypatch):
    """A task sorts a row for each batch and flag, and not one for each run."""
    rows = spark.range(0, 40_000, 1, 2).select(F.lit(0).alias("contig_idx"), F.lit("c").alias("contig"), F.col("id").alias("lpos"))
    pieces, found = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda *args: pieces.append(found(*args)) or pieces[-1])
    got = masks.stored_runs(rows, {"even": F.col("lpos") % 2 == 0, "third": F.col("lpos") % 3 == 0})
    assert {(r["name"], r["start"], r["end"]) for r in got.collect()} == {(n, p, p + 1) for n, k in (("even", 2), ("third", 3)) for p in range(0, 40_000, k)}
    assert 0 < pieces[0].count() < 100


@pytest.mark.parametrize("size", [7, 64, None])
def test_import_in_bins(spark, tmp_path, size):
    genome = Genome.of([("c1", 100), ("c2", 0), ("c3", 333)])
    rng, expected = random.Random(2), {}
    folder = tmp_path / "x.bedgraph"
    folder.mkdir()
    for name, path in (("x", folder / "part-0"), ("x", folder / "part-1"), ("y", tmp_path / "y.bed")):
        lines = []
        for _ in range(25):
            c, n = rng.choice([("c1", 100), ("c3", 333)])
            a = rng.randrange(n)
            b, v = rng.randint(a, n), rng.randint(0, 9)
            lines.append(f"{c}\t{a}\t{b}\t{v}")
            for p in range(a, b):
                expected[c, p, name] = expected.get((c, p, name), 0) + v
        path.write_text("\n".join([*lines, "other\t0\t5\t1"]) + "\n")
    got = files.import_tracks(spark, [str(folder), str(tmp_path / "y.bed")], genome, size)
    rows = got.collect()
    assert got.columns == ["contig_idx", "lpos", "pos", "x", "y"] and len(rows) == 433
    for r in rows:
        c = genome.contigs[r["contig_idx"]]
        assert r["pos"] == genome.offsets[r["contig_idx"]] + r["lpos"] and (r["x"], r["y"]) == tuple(expected.get((c, r["lpos"], n), 0) for n in "xy")
    (tmp_path / "z.bed").write_text("c1\t90\t101\t1\n")
    with pytest.raises(Exception, match="beyond its contig"):
        files.import_tracks(spark, [str(tmp_path / "z.bed")], genome, size).collect()


def test_tasks_sort_a_bounded_number_of_positions(spark, tmp_path, monkeypatch):
    """A track of few samples is sorted in more tasks than its bytes alone would make."""
    from basetrack.sources import store

    monkeypatch.setattr(store, "MOST_SORTED", 1000, raising=False)
    monkeypatch.setattr(files, "TASK_CELLS", 500, raising=False)
    genome = Genome.of([("c1", 10_000)])
    (tmp_path / "a.bed").write_text("".join(f"c1\t{p}\t{p + 1}\t{p % 7 + 1}\n" for p in range(10_000)))
    got = files.import_tracks(spark, [str(tmp_path / "a.bed")], genome, 100)
    assert got.rdd.getNumPartitions() == 20
    out = Store.create(spark, str(tmp_path / "store"))
    out.write(Entry("t", ["a"], list(genome.contigs), list(genome.offsets)), got)
    assert len(out.read("t").inputFiles()) == 10
    assert [tuple(r) for r in out.read("t").select("pos", "a").orderBy("pos").collect()] == [(p, p % 7 + 1) for p in range(10_000)]


def test_runs_and_not_positions_are_shuffled_on_import(spark, tmp_path):
    genome = Genome.of([("c1", 1_000_000)])
    (tmp_path / "a.bed").write_text("c1\t0\t1000000\t4\n")
    got = files.import_tracks(spark, [str(tmp_path / "a.bed")], genome)
    assert got.where("a = 4").count() == 1_000_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.index("Exchange") < plan.index("Scan csv")


def test_moments_of_many_samples(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(50, 9, (300, 500)) + rng.normal(0, 20, (300, 1))
    names = [f"n {i}.x" for i in range(500)]
    means = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"`{n}` double" for n in names)).repartition(21)
    got = pca.moments(means, names)
    assert got.n == 300 and np.allclose(got.mean, data.mean(axis=0)) and np.allclose(got.covariance, np.cov(data.T))
    assert pca.moments(means.limit(0), names) is None


def test_moments_stay_exact_far_from_zero():
    rows = np.random.default_rng(1).normal(0, 1, (1000, 3)) + 1e8
    whole, parts = pca.Moments.of(rows), pca.Moments.of(rows[:1]) + pca.Moments.of(rows[1:400]) + pca.Moments.of(rows[400:])
    assert np.allclose(whole.covariance, parts.covariance, rtol=1e-6) and np.allclose(np.diag(parts.covariance), 1, atol=0.2)


def test_analysis_of_many_samples_is_that_of_few(spark, monkeypatch):
    track = derived.store(spark, SF).read("depth")
    few = pca.analyse(track, derived.SAMPLES, 10)
    monkeypatch.setattr(pca, "FEW", 2)
    many = pca.analyse(track, derived.SAMPLES, 10)
    assert few.n_windows == many.n_windows and np.allclose(few.eigenvalues, many.eigenvalues) and np.allclose(few.components, many.components)
    with pytest.raises(ValueError, match="there are 0"):
        pca.analyse(track, derived.SAMPLES, 10**6)


def test_interval_sets():
    rng = random.Random(5)
    as_set = lambda x: {p for a, b in x.spans for p in range(a, b)}
    for _ in range(200):
        x, y = (Intervals.of((a, a + rng.randint(-1, 6)) for a in rng.sample(range(40), rng.randint(0, 6))) for _ in range(2))
        for got, expected in ((x | y, as_set(x) | as_set(y)), (x & y, as_set(x) & as_set(y)), (x - y, as_set(x) - as_set(y))):
            assert as_set(got) == expected and got.n_positions == len(expected)
            assert all(b < c for (_, b), (c, _) in zip(got.spans, got.spans[1:])) and all(a < b for a, b in got.spans)
    assert Intervals.of([(5, 7), (0, 3), (3, 5)]).spans == ((0, 7),)


def test_contigs_within_intervals(spark):
    g = Genome.of([("a", 10), ("b", 5), ("c", 0), ("d", 7)])
    assert Intervals.of([(0, 22)]).contigs_within(g) == ["a", "b", "c", "d"] and Intervals.of([]).contigs_within(g) == []
    assert Intervals.of([(1, 15), (16, 22)]).contigs_within(g) == ["b", "c"]
    track = derived.store(spark, SF).read("depth")
    g = derived.genome(spark, SF)
    o = g.offsets
    rows = pca.window_starts(pca.in_whole_contigs(track, g, Intervals.of([(o[0], o[2] - 1), (o[2], o[4])])), 10).collect()
    assert {r["contig_idx"] for r in rows} == {0, 2, 3}
    text = pca.in_whole_contigs(track, g, Intervals.of([(o[2], o[4])]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(pos), GreaterThanOrEqual(pos," in text


def test_profile_of_state():
    grouping = derived.GROUPING
    limits = {n: (i, 10 * i) for i, n in enumerate(grouping.members())}
    got = files.profile_of_state(limits, {n: 2 for n in limits}, grouping, 5)
    assert got["pop1"] == {"lower_coverage": 1, "upper_coverage": 10, "missing_cutoff": 5, "max_missing_samples": 2} and list(got) == list(limits)
    with pytest.raises(KeyError):
        files.profile_of_state({}, {}, grouping, 5)


def test_many_samples_are_arrays(spark, tmp_path):
    """2,000 samples: sets summed and counted as by numpy, without an expression for each sample; single columns as from a wide track."""
    n, names = 120, [f"n{i}" for i in range(2000)]
    data = np.random.default_rng(4).integers(0, 60, (n, 2000))
    rows = [(i, 0, i, *map(int, r)) for i, r in enumerate(data)]
    table = spark.createDataFrame(rows, "pos long, contig_idx int, lpos long, " + ", ".join(f"{c} int" for c in names))
    store = Store.create(spark, str(tmp_path / "s"))
    store.write(Entry("depth", names, ["c"], [0, n]), table)
    assert store.stored_rows("depth").columns == ["pos", "contig_idx", "lpos", "cells"]
    sets = Grouping.of(names, [(c, "odd") for c in names[1::2]] + [(c, "few") for c in names[:3]])
    store.preprocess("depth", sets, [3, 9])
    for name, cells in (("depth_sum", data), ("depth_missing_cutoff=3", data <= 3), ("depth_missing_cutoff=9", data <= 9)):
        got = store.read(name).orderBy("pos").select("ALL", "few", "odd").collect()
        expected = np.stack([cells.sum(axis=1), cells[:, :3].sum(axis=1), cells[:, 1::2].sum(axis=1)], axis=1)
        assert np.array_equal(np.array(got), expected)
    assert [r[1] for r in store.column("depth", "n7").orderBy("pos").collect()] == data[:, 7].tolist()
    pages = Pages(store, "depth")
    got = pages.coverage({"two": Coordinates(None, ("n5", "n6")), "odd": Coordinates().with_sample_sets(["odd"])})
    assert got["two"] == dict(zip(*(x.tolist() for x in np.unique(data[:, 5] + data[:, 6], return_counts=True)))) and sum(got["odd"].values()) == n


def test_masks_of_runs(spark, tmp_path, capsys):
    """What a mask of runs says is what one of positions says; unions and complements of runs; files from both."""
    g = derived.genome(spark, SF)
    store = derived.store(spark, SF)
    profile = {n: {"lower_coverage": 20, "upper_coverage": 200, "missing_cutoff": 3, "max_missing_samples": 1} for n in ("ALL", "pop1")}
    runs, rows = rewrite.mask_runs(store, "depth", profile, [3, 12]), masks.layers(store.read("depth"), derived.GROUPING, profile, [3, 12])
    found = runs.collect()
    for layer in masks.LAYERS:
        for name in profile:
            for k in (3, 12):
                own = {(r["contig_idx"], p) for r in found if r["layer"] == layer and r["sample_set"] == name and r["missing_cutoff"] in (None, k) for p in range(r["start"], r["end"])}
                assert own == {(r[0], r[1]) for r in rows.where(F.col(layer) & (F.col("sample_set") == name) & (F.col("missing_cutoff") == k)).select("contig_idx", "lpos").collect()}
    files.write_mask(runs, str(tmp_path / "runs"), profile, "", [3, 12])
    files.write_mask(rows, str(tmp_path / "rows"), profile, "", [3, 12])
    (tmp_path / "genome").write_text("".join(f"{c}\t{n}\n" for c, n in g.lengths().items()))
    for layer, k in (("accessible", "12"), ("excluded_missing", "3"), ("excluded_coverage", None)):
        for form in ("BED", "FASTA"):
            texts = []
            for kind in ("runs", "rows"):
                out = str(tmp_path / f"{kind}-{layer}.{form}")
                assert main(["export", str(tmp_path / kind), out, "-O", form, "--layer", layer, "--genome", str(tmp_path / "genome"), *(["--cutoff", k] if k else [])]) == 0
                texts.append(open(out).read())
            assert texts[0] == texts[1] and len(texts[0]) > 20
    with pytest.raises(SystemExit, match="unknown cutoff"):
        main(["export", str(tmp_path / "runs"), str(tmp_path / "x"), "--cutoff", "4"])


def test_unions_and_complements_of_runs(spark):
    rng = random.Random(6)
    g = Genome.of([("a", 50), ("b", 0), ("c", 9)])
    rows = [(i, "abc"[i], k, a, min(a + rng.randint(0, 8), n)) for i, n in ((0, 50), (2, 9)) for k in ("x", "y") for a in rng.sample(range(n), 6) if (i, k) != (2, "y")]
    table = spark.createDataFrame(rows, "contig_idx int, contig string, k string, start long, end long")
    at = lambda found: {(r["contig_idx"], r["k"], p) for r in found for p in range(r["start"], r["end"])}
    joint = masks.union(table, "k").collect()
    assert at(joint) == {(i, k, p) for i, _, k, a, b in rows for p in range(a, b)} and sum(r["end"] - r["start"] for r in joint) == len(at(joint))
    rest = masks.complement(masks.union(table, "k"), g, "k", ["x", "y", "z"]).collect()
    assert at(rest) == {(i, k, p) for i, n in ((0, 50), (2, 9)) for k in "xyz" for p in range(n)} - at(joint)


@pytest.mark.parametrize("piece", [1, 4, 7, 50])
def test_unions_and_complements_by_pieces(spark, piece):
    """No window takes a whole contig, and runs over the borders of pieces are whole."""
    rng = random.Random(piece)
    g = Genome.of([("a", 50), ("b", 0), ("c", 8), ("d", 0)])
    rows = [(i, "abc"[i], k, a, min(a + rng.randint(0, 12), n)) for i, n in ((0, 50), (2, 8)) for k in ("x", "y") for a in rng.sample(range(n), 5)] + [(2, "c", "w", 0, 8)]
    table = spark.createDataFrame(rows, "contig_idx int, contig string, k string, start long, end long")
    covered = {(i, k, p) for i, _, k, a, b in rows for p in range(a, b)}
    runs = lambda points: {(i, k, start, end) for j, i in enumerate((0, 2)) for k in "wxyz" for _, start, end in runs_of([(0, p, (i, k, p) in points) for p in range((50, 8)[j])], 0)}
    joint = masks.union(table, "k", piece=piece)
    got = sorted((r["contig_idx"], r["k"], r["start"], r["end"]) for r in joint.collect())
    assert got == sorted(runs(covered))
    rest = {(i, k, p) for i, n in ((0, 50), (2, 8)) for k in "wxyz" for p in range(n)} - covered
    got = sorted((r["contig_idx"], r["k"], r["start"], r["end"]) for r in masks.complement(joint, g, "k", list("wxyz"), piece=piece).collect())
    assert got == sorted(runs(rest))
