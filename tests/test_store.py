"""Stores, imports, selections and masks beyond the golden track."""

import warnings

import pytest
from pyspark.sql import functions as F

from basetrack.__main__ import main
from basetrack.operators import masks
from basetrack.operators import track as T
from basetrack.plans import rewrite
from basetrack.plans.selection import Coordinates, Genome, Grouping, filtered
from basetrack.sources import derived, files
from basetrack.sources.store import Entry, Store

SF = "/root/testdata/sf0.001"
GENOME = Genome.of([("chr1", 300), ("chr2", 0), ("chr10", 200_000)])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digests_tell_names_apart():
    one = Grouping(("a", "b"), (("cd", frozenset("ab")),))
    others = [Grouping(("a", "bc"), (("d", frozenset(("a", "bc"))),)), Grouping(("a", "b"), (("c", frozenset("ab")), ("d", frozenset("ab")))), Grouping(("ab",), (("c", frozenset(["ab"])), ("d", frozenset(["ab"]))))]
    assert len({g.digest() for g in (one, *others)}) == 4
    assert one.digest() == Grouping(("a", "b"), (("cd", frozenset("ba")),)).digest()


def test_filters_together():
    g = Genome.of([("a", 5), ("b", 7), ("c", 9)])
    assert filtered(g).contigs is None
    assert filtered(g, 6).contigs == ("b", "c") and filtered(g, 6, 8).contigs == ("b",)
    assert filtered(g, 6, None, ("a", "c")).contigs == ("c",) and filtered(g, 6, None, ("a",)).contigs == ()
    assert filtered(g, samples=("s",)).samples == ("s",) and filtered(g).samples is None


def test_selections_on_any_dimension():
    columns = tuple("abcd")
    sets = Grouping.of(columns, [("a", "x"), ("b", "x"), ("c", "y")])
    more = Grouping.of(columns, [("a", "north"), ("c", "north")])
    both = {"sample_set": sets, "region": more}
    at = lambda c, g=both, dim="sample": c.resolve(GENOME, g, dim).columns
    assert at(Coordinates().with_columns("region", ["north"])) == ("a", "c")
    assert at(Coordinates().with_columns("region", ["north"]).with_sample_sets(["x"])) == ("a",)
    assert at(Coordinates().with_columns("region", ["north"]).with_columns("region", None)) == columns
    assert at(Coordinates().with_columns("color", ["red"])) == columns and at(Coordinates().with_samples([])) == ()
    assert at(Coordinates().with_columns("identity", ["ALL"]), {"identity": sets}) == columns
    with pytest.raises(ValueError, match="no sample sets"):
        at(Coordinates().with_sample_sets(["x"]), {"region": more})
    with pytest.raises(ValueError, match="unknown regions: south"):
        at(Coordinates().with_columns("region", ["south"]))
    with pytest.raises(TypeError):
        Coordinates("chr1")
    with pytest.raises(ValueError, match="twice"):
        Coordinates(others=(("r", ()), ("r", ())))
    assert sets.of_selection(["c"]) == ["ALL", "y"] and sets.matching(columns) == "ALL" and sets.matching(["c"]) == "y"


def test_import_of_long_runs(spark, tmp_path):
    (tmp_path / "a b.per-base.bed").write_text("chr1\t0\t10\t5\nchr10\t100\t190000\t7\nchrX\t0\t5\t1\nchr10\t0\t0\t9\n")
    (tmp_path / "c+d.bedgraph").write_text("#head\nchr10\t199999\t200000\t3\nchr1\t5\t6\t2\n")
    paths = [str(tmp_path / "a b.per-base.bed"), str(tmp_path / "c+d.bedgraph")]
    rows = files.import_tracks(spark, paths, GENOME)
    assert rows.columns == ["contig_idx", "lpos", "pos", "a b", "c+d"] and rows.count() == GENOME.size
    assert rows.where("pos = lpos + IF(contig_idx = 0, 0, 300)").count() == GENOME.size
    sums = rows.groupBy("contig_idx").agg(F.sum("a b"), F.sum("c+d")).collect()
    assert sorted(map(tuple, sums)) == [(0, 50, 2), (2, 189_900 * 7, 3)]
    assert plan(rows).count("Scan csv") == 1
    assert files.import_tracks(spark, [], GENOME).count() == GENOME.size
    with pytest.raises(ValueError, match="same sample name"):
        files.import_tracks(spark, [paths[0], "/x/a b.bed"], GENOME)


def test_selections_reach_the_scan(spark):
    store = derived.store(spark, SF)
    assert store is derived.store(spark, SF)
    r = Coordinates(("2-HIGH",), ("s1", "s4")).resolve(store.entries["depth"].genome, derived.GROUPING)
    text = plan(T.select(store.read("depth"), r))
    assert "PushedFilters: [IsNotNull(pos), GreaterThanOrEqual(pos," in text and "Exchange" not in text and "c1:" not in text.split("ReadSchema")[1]


def test_positions_are_numbered_in_order(spark, tmp_path):
    rows = [(3 * i % 1000, "b" if i % 3 else "a") for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, g = derived.numbered(spark.createDataFrame(rows, "o_orderkey long, contig string"), str(tmp_path / "axis"))
        rows.sort(key=lambda r: (r[1], r[0]))
        n = sum(c == "a" for _, c in rows)
        assert g.offsets == (0, n, 1000)
        assert sorted(map(tuple, got.select("pos", "lpos", "o_orderkey", "contig").collect())) == [(i, i - (n if c == "b" else 0), k, c) for i, (k, c) in enumerate(rows)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_summaries_are_columns_of_one_table(spark, tmp_path):
    store = derived.store(spark, SF)
    copy = Store.create(spark, str(tmp_path / "s"))
    e = store.entries["depth"]
    copy.write(Entry("t", list(e.labels), e.contigs, e.offsets), store.read("depth"), chunk_size=100)
    names = copy.preprocess("t", derived.GROUPING, [3, 12, 3])
    assert names == ["t_sum", "t_missing_cutoff=3", "t_missing_cutoff=12"] and len({copy.entries[n].data for n in names}) == 1
    assert {copy.entries[n].attributes["coordinates"] for n in ("t", *names)} == {"0-based half-open"}
    again = Store.open(spark, copy.path)
    both = again.read("t_sum").join(T.summaries(again.read("t"), derived.GROUPING), "pos")
    assert both.where("ALL != sum_ALL OR pop1 != sum_pop1").count() == 0 and both.count() == e.genome.size
    with pytest.raises(KeyError):
        again.column("t", "s9")
    assert again.column("t", "s2").columns == ["pos", "s2"]
    before = again.identity()
    again.write(again.entries["t"], store.read("depth"))
    assert again.identity() != before
    with pytest.raises(ValueError):
        again.set_grouping("t", derived.GROUPING, "sample")
    with pytest.raises(ValueError):
        again.set_grouping("t", derived.GROUPING, "identity")


def test_histograms_read_summaries_where_they_can(spark):
    store = derived.store(spark, SF)
    grouped = rewrite.hists(store, "depth", {"ALL": Coordinates(), "pop1": Coordinates(None, ("s1", "s2", "s3"))})
    assert plan(grouped).count("FileScan") == 1 and all("/_summaries/" in f for f in grouped.inputFiles())
    own = rewrite.hists(store, "depth", {"x": Coordinates(None, ("s1", "s4")), "y": Coordinates(("2-HIGH",), ("s7",))}, 3)
    assert plan(own).count("FileScan") == 1 and not any("/_summaries/" in f for f in own.inputFiles())
    assert rewrite.missingness_hist(store, "depth", Coordinates(None, ("s1",)), 5).agg(F.sum("count")).first()[0] == store.entries["depth"].genome.size
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        hist = rewrite.sum_hists(store, "depth")
    assert hist.where("selection = 'pop2'").agg(F.sum("count")).first()[0] == store.entries["depth"].genome.size


def test_runs_over_many_spans(spark):
    bits = "1101111111101000111111111111111110000001"
    rows = [(i % 2, "c", i // 2, bits[i // 2] == "1" and (i % 2 == 0 or i // 2 != 20)) for i in range(2 * len(bits))]
    mask = spark.createDataFrame(rows, "contig_idx int, contig string, lpos long, accessible boolean")
    expected = set()
    for c in (0, 1):
        line = "".join("1" if a else "0" for i, _, _, a in rows if i == c)
        start = None
        for p, x in enumerate(line + "0"):
            if x == "1" and start is None:
                start = p
            if x == "0" and start is not None:
                expected.add((c, start, p))
                start = None
    for span in (1, 2, 3, 5, 40, 100):
        assert {(r["contig_idx"], r["start"], r["end"]) for r in masks.runs(mask, span=span).collect()} == expected


def test_masks_say_what_made_them(spark, tmp_path, capsys):
    store = derived.store(spark, SF)
    profile = {"ALL": {"lower_coverage": 20, "upper_coverage": 300, "missing_cutoff": 3, "max_missing_samples": 3}}
    out = str(tmp_path / "mask")
    files.write_mask(masks.layers(store.read("depth"), derived.GROUPING, profile, [3, 12]), out, profile, "id", [12, 3])
    got = files.mask_attributes(spark, out)
    assert got["missing_cutoffs"] == [3, 12] and got["thresholds"]["sample_sets"] == profile and got["thresholds"]["dataset_id"] == "id"
    assert spark.read.parquet(out).count() == 2 * store.entries["depth"].genome.size
    assert main(["export", out, str(tmp_path / "a.bed"), "--cutoff", "3"]) == 0
    lines = (tmp_path / "a.bed").read_text().splitlines()
    contigs = list(store.entries["depth"].genome.contigs)
    order = [(contigs.index(c), int(a), int(b)) for c, a, b in (line.split("\t") for line in lines)]
    assert order == sorted(order) and all(a < b for _, a, b in order)
    assert main(["version"]) == 0 and capsys.readouterr().out.strip().count(".") == 2
