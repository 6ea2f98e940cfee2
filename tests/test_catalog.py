"""Versions of a store: fresh and stale summaries, commits together, conflicts, what is cleared."""

import json

import pytest

from basetrack.plans import bundle, rewrite
from basetrack.plans.selection import Coordinates, Genome, Grouping
from basetrack.sources import store as S
from basetrack.sources.store import CatalogConflictError, Entry, MissingSummaryError, StaleSummaryError, Store

GENOME = Genome.of([("a", 3), ("b", 2)])
P = Coordinates().with_sample_sets(["p"])


@pytest.fixture
def path(spark, tmp_path):
    """Three samples whose sums over a and b are 11 at the last position, over a and c 101."""
    out = Store.create(spark, str(tmp_path / "store"))
    out.write(Entry("depth", ["a", "b", "c"], list(GENOME.contigs), list(GENOME.offsets)), table(spark, [(1, 10, 100)] * 5))
    return out.path


def table(spark, cells):
    rows = [(i, int(i > 2), i - 3 * (i > 2), *c) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "pos long, contig_idx int, lpos long, a int, b int, c int")


def sets(**members):
    return Grouping.of(["a", "b", "c"], [(c, n) for n, m in members.items() for c in m])


def values(store, coordinates=P, cutoff=None):
    return {r["value"]: r["count"] for r in rewrite.hists(store, "depth", {"x": coordinates}, cutoff).collect()}


def test_a_set_that_changed_is_read_from_the_track(spark, path):
    store = Store.open(spark, path)
    store.preprocess("depth", sets(p="ab"), [3])
    assert values(store) == {11: 5} and any("/_summaries/" in f for f in rewrite.hists(store, "depth", {"x": P}).inputFiles())
    store.set_grouping("depth", sets(p="ac"))
    assert values(store) == {101: 5} and values(store, cutoff=3) == {1: 5}
    with pytest.raises(StaleSummaryError):
        store.summary("depth", "sum")
    with pytest.raises(MissingSummaryError, match="it has: 3"):
        store.summary("depth", "missing", 7)


def test_data_that_changed_are_read_from_the_track(spark, path):
    store = Store.open(spark, path)
    store.preprocess("depth", sets(p="ab"), [3])
    store.write(store.entries["depth"], table(spark, [(5, 10, 100)] * 5))
    assert values(store) == {15: 5} and values(Store.open(spark, path)) == {15: 5}
    assert store.entries["depth"].grouping().members()["p"] == ["a", "b"]
    store.preprocess("depth", None, [3])
    assert values(store) == {15: 5} and "_sum" in rewrite.source_of(store, "depth", rewrite.resolved(store, "depth", P), None)[0]


def test_a_set_that_the_summary_lacks(spark, path):
    store = Store.open(spark, path)
    store.preprocess("depth", sets(p="ab"), [3])
    store.set_grouping("depth", sets(p="ab", q="bc"))
    assert values(store, Coordinates().with_sample_sets(["q"])) == {110: 5} and values(store) == {11: 5}


def test_an_open_store_keeps_its_version(spark, path):
    old = Store.open(spark, path)
    before = values(old, Coordinates(None, ("a",)))
    Store.open(spark, path).write(old.entries["depth"], table(spark, [(7, 0, 0)] * 5))
    assert values(old, Coordinates(None, ("a",))) == before == {1: 5}
    assert values(old.refresh(), Coordinates(None, ("a",))) == {7: 5}
    assert values(Store.open(spark, path, old.versions()[0]), Coordinates(None, ("a",))) == {1: 5}


def test_summaries_and_their_grouping_appear_together(spark, path, monkeypatch):
    store = Store.open(spark, path)
    version = store.version
    names = store.preprocess("depth", sets(p="ab"), [3, 12])
    assert store.version == version + 1 and set(names) <= set(Store.open(spark, path).entries)

    def stop(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(Store, "commit", stop)
    with pytest.raises(OSError):
        store.preprocess("depth", sets(p="bc"), [3])
    again = Store.open(spark, path)
    assert again.version == version + 1 and again.entries["depth"].grouping().members()["p"] == ["a", "b"] and values(again) == {11: 5}


def test_conflicts(spark, path):
    one, two = Store.open(spark, path), Store.open(spark, path)
    one.set_grouping("depth", sets(p="ab"))
    with pytest.raises(CatalogConflictError):
        two.set_grouping("depth", sets(p="ac"))
    # what doesn't depend on the change is published after it
    two.write(Entry("other", ["x"], list(GENOME.contigs), list(GENOME.offsets)), table(spark, [(1, 2, 3)] * 5).withColumnRenamed("a", "x"))
    assert set(two.entries) == {"depth", "other"} and two.entries["depth"].groupings
    with pytest.raises(CatalogConflictError):
        two.commit(two.entries["other"], of=[Entry("depth", [], [], [], version="older")])
    with pytest.raises(ValueError, match="one genome"):
        two.write(Entry("odd", ["x"], ["z"], [0, 5]), table(spark, [(1, 2, 3)] * 5).withColumnRenamed("a", "x"))
    with pytest.raises(FileExistsError):
        two.write(two.entries["other"], table(spark, []), mode="errorifexists")


def test_a_version_that_another_writer_took(spark, path, monkeypatch):
    store = Store.open(spark, path)
    real, calls = Store._published, []

    def late(self, version=None):
        """Another writer publishes right after the first look."""
        out = real(self, version)
        if not calls:
            calls.append(1)
            Store.open(spark, path).set_grouping("depth", sets(q="a"))
        return out

    monkeypatch.setattr(Store, "_published", late)
    store.commit(Entry("more", ["x"], list(GENOME.contigs), list(GENOME.offsets)))
    assert set(store.entries) == {"depth", "more"} and store.entries["depth"].groupings["sample_set"][1][0] == "q"


def test_vacuum(spark, path):
    store = Store.open(spark, path)
    store.preprocess("depth", sets(p="ab"), [3])
    store.preprocess("depth", sets(p="ac"), [3])
    store.write(store.entries["depth"], table(spark, [(2, 2, 2)] * 5))
    store.preprocess("depth", None, [3])
    assert store.vacuum() == []  # all is new
    gone = store.vacuum(-5)
    assert len([x for x in gone if x.startswith("_summaries/")]) == 2 and len([x for x in gone if x.startswith("depth-")]) == 1
    again = Store.open(spark, path)
    assert again.versions() == [again.version] and values(again) == {4: 5} and again.vacuum(-5) == []


def test_catalogs_are_text(spark, path):
    text = json.loads(spark.read.text(f"{path}/_catalog/*").first()[0])
    assert text["version"] == 1 and [e["name"] for e in text["entries"]] == ["depth"]
    with pytest.raises(S.StoreNotFoundError):
        Store.open(spark, f"{path}/nothing")


def test_masks_from_summaries(spark, path):
    store = Store.open(spark, path)
    profile = {"p": {"lower_coverage": 5, "upper_coverage": 20, "missing_cutoff": 3, "max_missing_samples": 1}}
    store.preprocess("depth", sets(p="ab"), [3, 12])
    fresh = rewrite.mask_layers(store, "depth", profile, [3, 12])
    assert all("/_summaries/" in f for f in fresh.inputFiles())
    other = rewrite.mask_layers(store, "depth", profile, [7])
    assert not any("/_summaries/" in f for f in other.inputFiles())
    rows = sorted(map(tuple, fresh.select("pos", "missing_cutoff", "accessible").collect()))
    store.set_grouping("depth", sets(p="ab", q="c"))
    stale = rewrite.mask_layers(store, "depth", profile, [3, 12])
    assert not any("/_summaries/" in f for f in stale.inputFiles()) and sorted(map(tuple, stale.select("pos", "missing_cutoff", "accessible").collect())) == rows
    assert {r[1:] for r in rows} == {(3, True), (12, False)}


class Jobs:
    """How many jobs a block runs."""

    def __init__(self, spark):
        self.sc, self.group = spark.sparkContext, "counted"

    def __enter__(self):
        self.sc.setJobGroup(self.group, "")
        self.before = len(self.sc.statusTracker().getJobIdsForGroup(self.group))
        return self

    def __exit__(self, *_):
        self.n = len(self.sc.statusTracker().getJobIdsForGroup(self.group)) - self.before
        self.sc.setLocalProperty("spark.jobGroup.id", None)


def test_the_second_page_reads_nothing(spark, path, monkeypatch):
    store = Store.open(spark, path)
    store.preprocess("depth", sets(p="ab"), [3, 12])
    chosen = {"p": P, "raw": Coordinates(None, ("a", "c")), "part": Coordinates(("b",), ("b", "c"))}
    pages = bundle.Pages(store, "depth")
    read = []
    monkeypatch.setattr(bundle.Pages, "_count", lambda self, asked, f=bundle.Pages._count: (read.append(len(asked)), f(self, asked))[1])
    with Jobs(spark) as first:
        assert pages.coverage(chosen) == {"p": {11: 5}, "raw": {101: 5}, "part": {110: 2}}
    with Jobs(spark) as second:
        assert pages.missingness(chosen, [3, 12]) == {("p", 3): {1: 5}, ("p", 12): {2: 5}, ("raw", 3): {1: 5}, ("raw", 12): {1: 5}, ("part", 3): {0: 2}, ("part", 12): {1: 2}}
        assert pages.coverage(chosen, 50) == {"p": {11: 5}, "raw": {49: 5}, "part": {49: 2}}
        # no position reached the cap, so more bins than it has are known too
        assert pages.coverage(chosen, 10_000)["raw"] == {101: 5}
    assert first.n >= 1 and second.n == 0 and read == [3]
    pages.missingness({"raw": chosen["raw"]}, [7])
    assert read == [3, 1]
    with Jobs(spark) as shared:
        assert bundle.Pages(store, "depth", pages.results).coverage({"again": chosen["raw"]}) == {"again": {101: 5}}
    assert shared.n == 0


def test_a_page_is_one_aggregation_over_each_table(spark, path):
    store = Store.open(spark, path)
    store.preprocess("depth", sets(p="ab"), [3])
    pages = bundle.Pages(store, "depth")
    seen = []
    real = type(spark.range(1)).collect
    try:
        type(spark.range(1)).collect = lambda self: (seen.append(self._jdf.queryExecution().executedPlan().toString()), real(self))[1]
        pages.missingness({"p": P, "raw": Coordinates(None, ("a",)), "x": Coordinates(("a",), ("c",))}, [3, 8])
    finally:
        type(spark.range(1)).collect = real
    # p at 3 is read from the summary, all else from the track
    assert len(seen) == 1 and seen[0].count("FileScan") == 2


def test_beyond_the_cap_is_counted_again(spark, path):
    store = Store.open(spark, path)
    store.write(store.entries["depth"], table(spark, [(1000, 0, 0), (5, 0, 0), (5, 0, 0), (0, 0, 0), (301, 0, 0)]))
    pages = bundle.Pages(store, "depth")
    chosen = {"a": Coordinates(None, ("a",))}
    assert pages.coverage(chosen) == {"a": {0: 1, 5: 2, 100: 2}}
    assert pages.coverage(chosen, 400) == {"a": {0: 1, 5: 2, 301: 1, 399: 1}}
    assert pages.coverage(chosen, 2000) == {"a": {0: 1, 5: 2, 301: 1, 1000: 1}}


def test_old_results_go(spark):
    results = bundle.Results(most=5)
    results.put("a", 9, {i: 1 for i in range(3)})
    results.put("b", 9, {i: 1 for i in range(3)})
    assert results.get("a", 9) is None and results.get("b", 1) == {0: 1, 1: 2}
