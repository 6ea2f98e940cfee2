"""The engine on a track written by hand, with golden numbers."""

import pytest

from basetrack.__main__ import main
from basetrack.operators import histogram, masks, pca
from basetrack.operators import track as T
from basetrack.plans.selection import Coordinates, Genome, Grouping, columns_of
from basetrack.sources import files
from basetrack.sources.store import Entry, MissingSummaryError, Store, StoreNotFoundError, positions_per_chunk

# Coverage of seven samples over chr1 (10), chr2 (8) and chr10 (6).
CELLS = """
0 5 5 5 5 4 4 4 4 4 0 7 7 7 7 7 7 7 0 12 11 11 11 12
0 28 28 28 28 28 28 27 27 27 0 17 17 17 17 17 17 17 0 17 17 17 17 17
0 33 33 34 33 34 33 34 34 34 0 13 13 13 13 13 12 12 0 21 21 21 22 22
0 29 30 30 30 30 30 31 31 31 0 25 25 25 25 25 25 25 0 26 26 26 26 26
0 24 24 24 24 25 25 25 25 25 0 24 24 24 24 24 24 24 0 22 22 22 22 22
0 7 7 9 8 9 10 11 11 11 0 16 16 16 16 16 16 16 0 8 8 7 7 7
0 21 21 21 21 21 21 21 21 21 0 33 32 33 34 34 34 34 0 21 21 23 23 23
"""
GENOME = Genome.of([("chr1", 10), ("chr2", 8), ("chr10", 6)])
SAMPLES = [f"s{k}" for k in range(1, 8)]
SETS = Grouping.of(SAMPLES, [("s1", "pop1"), ("s2", "pop1"), ("s3", "pop1"), ("s4", "pop2"), ("s5", "pop2"), ("s6", "pop3"), ("s7", "pop3"), ("zz", "pop9")])


@pytest.fixture(scope="module")
def track(spark):
    columns = [list(map(int, line.split())) for line in CELLS.strip().splitlines()]
    rows = []
    for i, (c, n) in enumerate(GENOME.lengths().items()):
        for p in range(n):
            pos = GENOME.offsets[i] + p
            rows.append((c, i, n, p, pos, *[x[pos] for x in columns]))
    return spark.createDataFrame(rows, "contig string, contig_idx int, len long, lpos long, pos long, " + ", ".join(f"{s} int" for s in SAMPLES)).repartition(3).cache()


def test_genome():
    assert GENOME.resolve(None) == [(0, 24)]
    assert GENOME.resolve(["chr2", "chr1"]) == [(0, 18)]
    assert GENOME.resolve(["chr10", "chr1"]) == [(0, 10), (18, 24)]
    assert GENOME.resolve(()) == []
    assert Genome(("a", "b", "c"), (0, 5, 6, 10)).resolve(["a", "c"]) == [(0, 5), (6, 10)]
    assert GENOME.in_length_range(7, 9) == ["chr2"]
    with pytest.raises(KeyError):
        GENOME.resolve(["chrX"])
    with pytest.raises(ValueError):
        Genome(("a",), (0,))


def test_columns():
    more = Grouping.of(SAMPLES, [("s1", "pop1"), ("s1", "pop2"), ("s4", "pop2"), ("s5", "pop2")])
    assert columns_of(more, None, ["pop2"]) == ["s1", "s4", "s5"]
    assert columns_of(SETS, ["s2", "s4"], ["pop1"]) == ["s2"]
    assert SETS.counts(SETS.members()["pop1"]) == [("ALL", 3, 7), ("pop1", 3, 3), ("pop2", 0, 2), ("pop3", 0, 2)]
    assert SETS.matching(["s4", "s5"]) == "pop2" and SETS.matching(["s1", "s4"]) is None
    with pytest.raises(ValueError):
        columns_of(SETS, None, ["pop7"])
    with pytest.raises(TypeError):
        Coordinates().with_contigs("chr1")
    assert Coordinates().with_sample_sets(["ALL", "pop1"]).sample_sets is None
    r = Coordinates().resolve(GENOME, SETS)
    assert (r.stride(5), r.stride(23), r.stride(0), r.stride(24)) == (5, 2, 1, 1)


def test_summaries(track):
    rows = {r["pos"]: r for r in T.summaries(track, SETS, [12, 3]).collect()}
    assert [rows[23][f"sum_{n}"] for n in SETS.members()] == [129, 51, 48, 30]
    assert [rows[0][f"missing_3_{n}"] for n in SETS.members()] == [7, 3, 2, 2]
    assert [rows[23][f"missing_12_{n}"] for n in SETS.members()] == [2, 1, 0, 1]


def test_thresholds(track, spark):
    hist = histogram.sum_hists(track, SETS)
    got = {r["sample_set"]: (r["lower"], r["upper"], r["max_bin"]) for r in histogram.thresholds(hist).collect()}
    assert got == {"ALL": (73, 229, 183), "pop1": (27, 90, 80), "pop2": (26, 83, 67), "pop3": (19, 59, 60)}
    profile = files.default_profile(histogram.thresholds(hist), SETS, 3)
    assert profile["ALL"]["max_missing_samples"] == 3 and profile["pop1"]["max_missing_samples"] == 1
    assert files.profile_from_yaml(files.profile_to_yaml(profile, "x")) == (profile, "x")
    with pytest.raises(ValueError):
        files.profile_from_yaml("schema_version: 2")
    means = {r["contig"]: r["mean"] for r in T.contig_means(track, SETS).where("sample_set = 'ALL'").collect()}
    assert means["chr1"] == 135.6 and means["chr2"] == 118.25 and round(means["chr10"], 6) == 106.166667


def test_masks(track, spark):
    profile = {"ALL": {"lower_coverage": 10, "upper_coverage": 200, "missing_cutoff": 3, "max_missing_samples": 0}}
    mask = masks.layers(track, SETS, profile)
    for span in (3, 1000):
        runs = masks.runs(mask, span=span).orderBy("contig_idx", "start").collect()
        assert [(r["contig"], r["start"], r["end"]) for r in runs] == [("chr1", 1, 10), ("chr2", 1, 8), ("chr10", 1, 6)]
    assert [r[0] for r in files.fasta(mask, GENOME).collect()] == [">chr1", "0111111111", ">chr2", "01111111", ">chr10", "011111"]
    with pytest.raises(masks.MissingSetError):
        masks.layers(track, SETS, {"pop8": profile["ALL"]})


def test_windows_and_pca(track):
    for size, starts in ((4, [0, 4, 10, 14, 18]), (3, [0, 3, 6, 10, 13, 18, 21]), (8, [0, 10]), (11, [])):
        assert sorted(r["start"] for r in pca.window_starts(track, size).collect()) == starts
    got = pca.analyse(track, SAMPLES, 4)
    assert got.n_windows == 5 and [round(float(x), 8) for x in got.eigenvalues[:3]] == [0.51296931, 0.29894785, 0.06963144]
    with pytest.raises(ValueError):
        pca.analyse(track, SAMPLES, 11)
    with pytest.raises(ValueError):
        pca.windows(track, 0)


def test_one_scan(track, spark, tmp_path):
    track.write.parquet(str(tmp_path / "t"))
    hist = histogram.sum_hists(spark.read.parquet(str(tmp_path / "t")), SETS)
    assert hist._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_command_line(track, spark, tmp_path, capsys):
    out = str(tmp_path)
    (tmp_path / "genome").write_text("".join(f"{c}\t{n}\n" for c, n in GENOME.lengths().items()))
    rows = track.orderBy("pos").collect()
    for s in SAMPLES:
        (tmp_path / f"{s}.per-base.bed").write_text("".join(f"{r['contig']}\t{r['lpos']}\t{r['lpos'] + 1}\t{r[s]}\n" for r in rows))
    (tmp_path / "sets").write_text("".join(f"{s} {n}\n" for n, c in SETS.members().items() if n != "ALL" for s in c))
    store = f"{out}/store"
    with pytest.raises(StoreNotFoundError):
        Store.open(spark, store)
    assert main(["import", store, f"{out}/genome", *[f"{out}/{s}.per-base.bed" for s in SAMPLES]]) == 0
    with pytest.raises(MissingSummaryError):
        main(["thresholds", store])
    main(["preprocess", store, "all", "--sampleset-info", f"{out}/sets"])
    main(["thresholds", store, "-o", f"{out}/t.yml"])
    with pytest.raises(SystemExit):
        main(["thresholds", store, "-o", f"{out}/t.yml"])
    profile, _ = files.profile_from_yaml((tmp_path / "t.yml").read_text())
    assert profile["pop2"] == {"lower_coverage": 26, "upper_coverage": 83, "missing_cutoff": 3, "max_missing_samples": 1}
    main(["mask", store, f"{out}/t.yml", f"{out}/mask"])
    main(["export", f"{out}/mask", f"{out}/bed"])
    main(["export", f"{out}/mask", f"{out}/fa", "-O", "FASTA", "--genome", f"{out}/genome"])
    assert spark.read.text(f"{out}/bed").count() == 3
    main(["pca", store, "-o", f"{out}/p", "--window-size", "3", "--min-contig-length", "8", "--sample-set", "pop1", "--sample-set", "pop2"])
    assert [x.split("\t")[0] for x in (tmp_path / "p.scores.tsv").read_text().splitlines()] == ["sample", "s1", "s2", "s3", "s4", "s5"]
    last = {r["pos"]: r for r in Store.open(spark, store).read("depth_sum").collect()}[23]
    assert [last[n] for n in SETS.members()] == [129, 51, 48, 30]
    assert Store.open(spark, store).base().name == "depth"


def test_sizes():
    assert positions_per_chunk(1) == 25_000_000 and positions_per_chunk(1000) == 100_000
    with pytest.raises(ValueError):
        positions_per_chunk(0)
