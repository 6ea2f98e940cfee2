"""Queries over the derived track, by name, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import histogram as H
from .operators import masks as M
from .operators import pca as P
from .operators import track as T
from .plans import rewrite as R
from .plans.bundle import Pages
from .plans.selection import Coordinates, Grouping, Intervals, filtered
from .sources import files
from .sources.derived import GROUPING, SAMPLES, depth, folder, genome, store
from .sources.store import Entry, Store

TWO = ("1-URGENT", "3-MEDIUM")
ADHOC = ("s1", "s4", "s5", "s6")
SETS = GROUPING.members()
LIMITS = {n: {"lower_coverage": 20, "upper_coverage": 300, "missing_cutoff": 3, "max_missing_samples": m} for n, m in (("ALL", 3), ("pop1", 1), ("pop2", 1), ("pop3", 1))}
WINDOW = 100


def _resolved(s, d, contigs=None, samples=None, sets=None):
    return Coordinates(contigs, samples, sets).resolve(genome(s, d), GROUPING)


def _sums(s, d, contigs=None):
    return H.sum_hists(_on(s, d, contigs), GROUPING)


def _on(s, d, contigs=None):
    rows = depth(s, d)
    where = T.at(_resolved(s, d, contigs))
    return rows if where is None else rows.where(where)


def track_sum(s, d):
    return T.summaries(depth(s, d), GROUPING)


def track_missingness(s, d):
    return T.summaries(depth(s, d), GROUPING, [3]).select("pos", *[f"missing_3_{n}" for n in SETS])


def preprocess_multi_cutoff(s, d):
    return T.summaries(depth(s, d), GROUPING, [12, 3, 12])


def sel_track(s, d):
    return T.select(depth(s, d), _resolved(s, d, TWO, ("s1", "s4", "s5")))


def sel_columns(s, d):
    r = _resolved(s, d, None, ("s2", "s4", "s6"), ("pop1", "pop2"))
    one = depth(s, d).agg(*[F.sum(c).alias(c) for c in r.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("sample"), F.col(c).alias("total")) for c in r.columns])))


def sel_merge_adjacent(s, d):
    return s.createDataFrame(list(_resolved(s, d, ("1-URGENT", "2-HIGH", "4-NOT SPECIFIED")).intervals), "start long, end long")


def sel_stride(s, d):
    r = _resolved(s, d, TWO)
    return T.strided(depth(s, d), r, 1000).select("pos", T.total(SAMPLES).alias("sum_ALL"))


def hist_coverage(s, d):
    return H.count_values(depth(s, d).select(F.least(F.col("s1").cast("long"), F.lit(40)).alias("value")))


def hist_sum_sets(s, d):
    return _sums(s, d)


def hist_missing_sets(s, d):
    return H.missing_hists(depth(s, d), GROUPING, 3)


def hist_coverage_contigs(s, d):
    return _sums(s, d, TWO)


def hist_missing_adhoc(s, d):
    return H.count_values(_on(s, d, TWO).select(T.missing(ADHOC, 12).alias("value")))


def hist_bundle(s, d):
    """Several selections and metrics behind one scan."""
    values = {"ALL": SAMPLES, "adhoc": ADHOC, "pop2": SETS["pop2"]}
    cells = []
    for n, c in values.items():
        metrics = {"sum": T.total(c)} | {f"missing_{k}": T.missing(c, k) for k in (3, 12)}
        cells += [F.struct(F.lit(n).alias("selection"), F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics.items()]
    return H.count_values(depth(s, d).select(F.inline(F.array(*cells))), "selection", "metric")


def hist_summary_rewrite(s, d):
    """Two selections that are sample sets, read from the sum summary, and one that isn't."""
    chosen = {"ALL": Coordinates(), "pop2 in two": Coordinates(TWO, None, ("pop2",)), "adhoc": Coordinates(TWO, ADHOC)}
    return R.hists(store(s, d), "depth", chosen)


def hist_many(s, d):
    """Missing samples of several selections at two cutoffs, every k-th position, brought to the whole."""
    chosen = {"ALL": Coordinates(), "pop1 in two": Coordinates(TWO, None, ("pop1",)), "adhoc": Coordinates(None, ADHOC)}
    pages = Pages(store(s, d), "depth")
    return pages.table(pages.missingness(chosen, (3, 7), 2000), "selection", "cutoff")


def hist_pages(s, d):
    """Two pages of the same selections behind one aggregation: sums with fewer bins, then with more, then missing samples."""
    chosen = {n: Coordinates(TWO, c) for n, c in {"pop2": tuple(SETS["pop2"]), "adhoc": ADHOC}.items()}
    pages = Pages(store(s, d), "depth")
    few, many = pages.coverage(chosen, {"pop2": 20, "adhoc": 60}), pages.coverage(chosen)
    out = pages.table(few).withColumn("page", F.lit("few")).unionByName(pages.table(many).withColumn("page", F.lit("all")))
    for k in (3, 12):
        missing = {n: hist for (n, _), hist in pages.missingness(chosen, (k,)).items()}
        out = out.unionByName(pages.table(missing).withColumn("page", F.lit(f"missing {k}")))
    return out


def hist_stale_summary(s, d):
    """Histograms of a track whose sample sets, and then whose data, change after its summaries were made.

    Each has the numbers of the track as it is: of the set p as it is now, of
    a set that the summary doesn't have, and of the data as they are now.
    """
    source = store(s, d)
    e = source.entries["depth"]
    own = Store.create(s, folder(s))
    rows = source.read("depth")
    own.write(Entry("depth", list(SAMPLES), e.contigs, e.offsets), rows)
    own.preprocess("depth", Grouping.of(SAMPLES, [("s1", "p"), ("s2", "p")]), (3,))
    of = lambda *sets: {n: Coordinates(None, None, (n,)) for n in sets}
    out = [R.hists(own, "depth", of("p"))]
    own.set_grouping("depth", Grouping.of(SAMPLES, [("s1", "p"), ("s3", "p"), ("s4", "q"), ("s5", "q")]))
    out.append(R.hists(own, "depth", of("p", "q")))
    own.write(own.entries["depth"], rows.withColumn("s1", F.col("s1") + F.col("s2")))
    out.append(R.hists(own, "depth", of("p", "q")))
    out.append(R.hists(own, "depth", of("p"), 3))
    named = [h.withColumn("step", F.lit(x)) for h, x in zip(out, ("first", "regrouped", "rewritten", "missing"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def hist_beyond_cap(s, d):
    """More bins than the cap that goes with one column."""
    return R.coverage_hist(store(s, d), "depth", Coordinates(None, SAMPLES), 250)


def coverage_indicators(s, d):
    """The table of a selection of samples, plain and by sample."""
    given = s.createDataFrame([(n, p["lower_coverage"], p["upper_coverage"]) for n, p in LIMITS.items()], "sample_set string, lower long, upper long")
    chosen = Coordinates(TWO, ADHOC)
    hist = R.hists(store(s, d), "depth", {n: chosen.with_sample_sets((n,)) for n in GROUPING.of_selection(ADHOC)}).withColumnRenamed("selection", "sample_set")
    sizes = {n: k for n, k, _ in GROUPING.counts(ADHOC)}
    both = [H.coverage_indicators(hist, given, sizes, genome(s, d).size, x).withColumn("by_sample", F.lit(x)) for x in (False, True)]
    return both[0].unionByName(both[1])


def contigs_filtered(s, d):
    """Contigs that filters together leave: of a range of lengths, and picked."""
    g = genome(s, d)
    lower = sorted(g.lengths().values())[1]
    kept = filtered(g, lower, None, (*TWO, "2-HIGH", "5-LOW"))
    return s.createDataFrame([(c, e) for c, _, e in g.regions(kept.contigs)], "contig string, contig_len long")


def hist_scaled(s, d):
    r = _resolved(s, d)
    k = r.stride(4000)
    kept = T.strided(depth(s, d), r, 4000)
    counted = -(-r.n_positions // k)
    return H.scaled(H.count_values(kept.select(T.total(SAMPLES).alias("value"))), r.n_positions, counted)


def hist_fold(s, d):
    return H.fold(_sums(s, d), 100, "sample_set")


def hist_stats(s, d):
    out = H.stats(_sums(s, d), "sample_set")
    return out.withColumn("mean", F.round("mean", 8)).withColumn("std", F.round("std", 8))


def hist_boxplot(s, d):
    return H.boxplot(_sums(s, d), "sample_set")


def hist_quantile(s, d):
    return H.quantiles(_sums(s, d), (0.05, 0.5, 0.995), "sample_set")


def thresholds(s, d):
    return H.thresholds(_sums(s, d))


def threshold_table(s, d):
    hist = R.sum_hists(store(s, d), "depth").withColumnRenamed("selection", "sample_set")
    return H.threshold_table(hist, H.thresholds(hist), GROUPING, genome(s, d).size)


def coverage_table(s, d):
    """Of a selection of contigs, with limits that are given."""
    given = s.createDataFrame([(n, p["lower_coverage"], p["upper_coverage"]) for n, p in LIMITS.items()], "sample_set string, lower long, upper long")
    return H.accessible(_sums(s, d, TWO), given, _resolved(s, d, TWO).n_positions)


def missingness_table(s, d):
    given = s.createDataFrame([(n, p["max_missing_samples"], len(SETS[n])) for n, p in LIMITS.items()], "sample_set string, max_missing long, n_samples long")
    size = float(genome(s, d).size)
    rows = H.missing_hists(depth(s, d), GROUPING, 3).join(given, "sample_set").groupBy("sample_set", "max_missing", "n_samples")
    rows = rows.agg(F.sum(F.when(F.col("value") <= F.col("max_missing"), F.col("count")).otherwise(0)).alias("accessible_bp"))
    return rows.select("sample_set", "accessible_bp", F.round(F.col("accessible_bp") / size, 8).alias("frac_genome"), F.round(F.col("max_missing") / F.col("n_samples"), 8).alias("max_missing_by_sample"))


def contig_means(s, d):
    return T.contig_means(depth(s, d), GROUPING).select("contig", "sample_set", F.round("mean", 8).alias("mean"))


def contig_scatter(s, d):
    """The mean of the full set over the selected samples of each set (s1, s4, s5, s6); null for none."""
    n = s.createDataFrame([(a, b) for a, b, _ in GROUPING.counts(ADHOC)], "sample_set string, n_selected long")
    rows = T.contig_means(depth(s, d), GROUPING).join(n, "sample_set")
    return rows.select("sample_set", "contig", F.col("len").alias("length"), F.round(F.col("mean") / F.when(F.col("n_selected") > 0, F.col("n_selected")), 8).alias("mean"), F.round("mean", 8).alias("total_mean"))


def _by_flags(s, d):
    """Line numbers grouped by the flags that more of their lines have than the average flags, from the lines themselves."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.concat(F.lit("s"), "l_linenumber").alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("sample_set")).agg(F.count(F.lit(1)).alias("n"))
    most = lines.groupBy("sample").agg(F.avg("n").alias("most"))  # a row for each line number
    return files.grouping_of(lines.join(most, "sample").where("n >= most"), SAMPLES)


def group_counts(s, d):
    """How many of three samples each set of flags has."""
    return s.createDataFrame(_by_flags(s, d).counts(SETS["pop1"]), "sample_set string, selected long, total long")


def group_membership(s, d):
    """The flags of each sample."""
    g = _by_flags(s, d)
    return s.createDataFrame([(c, ",".join(g.of_column(c))) for c in SAMPLES], "sample string, sample_sets string")


def selection_overview(s, d):
    g = genome(s, d)
    r = _resolved(s, d, TWO, None, ("pop1",))
    rows = [("Contigs", "all", len(TWO), len(g.contigs)), ("Samples", "all", len(r.columns), len(SAMPLES)), ("Positions", "all", r.n_positions, g.size)]
    return s.createDataFrame(rows + [("Sample set", n, a, b) for n, a, b in GROUPING.counts(r.columns)], "type string, label string, active long, total long")


def active_genome(s, d):
    """Positions of the selected contigs, and their share of the genome in per cent."""
    r = _resolved(s, d, TWO)
    return s.createDataFrame([(r.n_positions, r.active_per_cent)], "active_bp long, active_per_cent double")


def _some(s, d):
    """The second half of the first contig, all of the next two, and the first two thirds of the fourth."""
    o = genome(s, d).offsets
    half = Intervals.of([(o[0] + (o[1] - o[0]) // 2, o[2]), (o[2], o[3] + (o[4] - o[3]) * 2 // 3)])
    return half - Intervals.of([(o[1], o[1])])


def window_starts_intervals(s, d):
    """Windows of the contigs that are wholly within some intervals."""
    return P.window_starts(P.in_whole_contigs(depth(s, d), genome(s, d), _some(s, d)), WINDOW)


def sel_intervals(s, d):
    """Sums of positions in intervals that are no contigs."""
    return depth(s, d).where(T.inside(_some(s, d).spans)).groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.sum(T.total(SAMPLES)).alias("total"))


def window_moments(s, d):
    """Moments made where the windows are and merged in a tree."""
    m = P.moments(P.window_means(depth(s, d), SAMPLES, WINDOW), SAMPLES)
    rows = [(a, b, m.n, round(float(m.mean[i]), 8), round(float(m.covariance[i, j]), 8)) for i, a in enumerate(SAMPLES) for j, b in enumerate(SAMPLES) if i <= j]
    return s.createDataFrame(rows, "a string, b string, n long, mean_a double, covariance double")


def import_runs(s, d):
    """Two samples as per-base files that Spark writes from the tables, a folder of files a sample, read again as a track."""
    at = folder(s)
    for c in ("s1", "s6"):
        depth(s, d).where(F.col(c) > 0).select("contig", "lpos", F.col("lpos") + 1, c).write.csv(f"{at}/{c}.per-base.bed", sep="\t")
    g = genome(s, d)
    out = Store.create(s, f"{at}/store")
    paths = [f"{at}/{c}.per-base.bed" for c in ("s1", "s6")]
    out.write(Entry("depth", [files.sample_name(p) for p in paths], list(g.contigs), list(g.offsets)), files.import_tracks(s, paths, g, 1000))
    return out.read("depth").select("contig", "lpos", "pos", "s1", "s6")


def summary_masks(s, d):
    """Accessible positions of each set, read from the summaries alone."""
    rows = R.mask_layers(store(s, d), "depth", LIMITS, [12, 3])
    return rows.groupBy("contig", "sample_set", "missing_cutoff").agg(F.count_if("accessible").alias("accessible_bp"))


def _mask_store(s, d):
    """A mask of runs, written and read again."""
    at = folder(s)
    files.write_mask(R.mask_runs(store(s, d), "depth", LIMITS, [12, 3]), f"{at}/mask", LIMITS, "", [12, 3])
    return s.read.parquet(f"{at}/mask")


def mask_store_bp(s, d):
    """Accessible positions of each contig, set and cutoff as sums of stored runs."""
    rows = _mask_store(s, d).where("layer = 'accessible'").groupBy("contig", "sample_set", "missing_cutoff").agg(F.sum(F.col("end") - F.col("start")).alias("accessible_bp"))
    return rows


def mask_store_layers(s, d):
    """What is accessible as the rest of what is excluded for coverage or for missing samples, all from stored runs."""
    runs = _mask_store(s, d).where("layer != 'accessible' AND coalesce(missing_cutoff, 3) = 3").drop("missing_cutoff")
    return M.complement(M.union(runs, "sample_set"), genome(s, d), "sample_set", list(LIMITS)).select("contig", "sample_set", "start", "end")


def mask_runs(s, d):
    """Runs of every layer of every set in one pass over the stored track."""
    sums = {n: (T.total(c) < LIMITS[n]["lower_coverage"]) | (T.total(c) > LIMITS[n]["upper_coverage"]) for n, c in SETS.items()}
    return M.stored_runs(depth(s, d), {n: ~x for n, x in sums.items()}).select("contig", F.col("name").alias("sample_set"), "start", "end")


def window_starts(s, d):
    return P.window_starts(depth(s, d), WINDOW)


def window_means(s, d):
    means = P.window_means(depth(s, d), SAMPLES, WINDOW)
    return means.select("contig_idx", "window", *[F.round(c, 8).alias(c) for c in SAMPLES])


def window_cov(s, d):
    row = P.covariance(P.window_means(depth(s, d), SAMPLES, WINDOW), SAMPLES)
    pairs = [(a, b) for i, a in enumerate(SAMPLES) for b in SAMPLES[i:]]
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"{a}_{b}", 8).alias("covariance")) for a, b in pairs])))


def pca_variance(s, d):
    r = P.analyse(depth(s, d), SAMPLES, WINDOW)
    return s.createDataFrame([(f"PC{i + 1}", float(v), float(q)) for i, (v, q) in enumerate(zip(r.eigenvalues, r.ratios))], "component string, eigenvalue double, explained_variance_ratio double")


def pca_invariants(s, d):
    """What the eigenvalues say of the matrix: its trace and its squares; and that they are its eigenvalues."""
    r = P.analyse(depth(s, d), SAMPLES, WINDOW)
    row = (int(r.n_windows), round(float(r.eigenvalues.sum()), 8), round(float((r.eigenvalues**2).sum()), 8), round(float(r.ratios.sum()), 8))
    return s.createDataFrame([row], "n_windows long, trace double, squares double, ratios double")


def pca_scores(s, d):
    r = P.analyse(depth(s, d), SAMPLES, WINDOW)
    k = 3
    return s.createDataFrame([(c, *map(float, r.scores[i, :k])) for i, c in enumerate(SAMPLES)], "sample string, " + ", ".join(f"PC{i + 1} double" for i in range(k)))


def mask_layers(s, d):
    return M.layers(depth(s, d), GROUPING, LIMITS).select("pos", "sample_set", "excluded_coverage", "excluded_missing", "accessible")


def mask_multi_cutoff(s, d):
    return M.layer_counts(depth(s, d), GROUPING, LIMITS, [12, 3]).select("sample_set", "missing_cutoff", "accessible_bp", "missing_bp")


def mask_bed(s, d):
    return M.stored_runs(M.layers(depth(s, d), GROUPING, {"ALL": LIMITS["ALL"]}), {"": F.col("accessible")}).select("contig", "start", "end")


def mask_bp(s, d):
    return M.layer_counts(depth(s, d), GROUPING, LIMITS, None, "contig").select("contig", "sample_set", "accessible_bp")


_ALL = [track_sum, track_missingness, preprocess_multi_cutoff, sel_track, sel_columns, sel_merge_adjacent, sel_stride, hist_coverage, hist_sum_sets, hist_missing_sets, hist_coverage_contigs, hist_missing_adhoc, hist_bundle, hist_summary_rewrite, hist_many, hist_beyond_cap, hist_pages, hist_stale_summary, hist_scaled, hist_fold, hist_stats, hist_boxplot, hist_quantile, thresholds, threshold_table, contig_means, group_counts, group_membership, selection_overview, active_genome, sel_intervals, coverage_table, coverage_indicators, contigs_filtered, missingness_table, contig_scatter, window_starts, window_starts_intervals, window_means, window_cov, window_moments, pca_variance, pca_scores, pca_invariants, mask_layers, mask_multi_cutoff, mask_bed, mask_bp, mask_runs, mask_store_bp, mask_store_layers, summary_masks, import_runs]


def queries():
    return {f.__name__: f for f in _ALL}


# SQL: the derived track as a common table expression, then each query on it.
_CELLS = ", ".join(f"CAST(sum(CASE WHEN l_linenumber = {k} THEN l_quantity ELSE 0 END) AS INT) AS s{k}" for k in range(1, 8))
_TRACK = f"""
ax AS (SELECT o_orderkey, o_orderpriority AS contig, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS lpos FROM orders),
ct AS (SELECT contig, count(*) AS len FROM ax GROUP BY contig),
gn AS (SELECT contig, len, row_number() OVER (ORDER BY contig) - 1 AS contig_idx, coalesce(sum(len) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ct),
ln AS (SELECT l_orderkey, {_CELLS} FROM lineitem GROUP BY l_orderkey),
d AS (SELECT contig, CAST(contig_idx AS INT) AS contig_idx, CAST(len AS BIGINT) AS len, CAST(lpos AS BIGINT) AS lpos, CAST(start + lpos AS BIGINT) AS pos,
  {", ".join(f"coalesce(s{k}, 0) AS s{k}" for k in range(1, 8))} FROM ax JOIN gn USING (contig) LEFT JOIN ln ON l_orderkey = o_orderkey)"""
_SUM = {n: "CAST(" + " + ".join(c) + " AS BIGINT)" for n, c in SETS.items()}
_IN_TWO = "contig IN ('1-URGENT', '3-MEDIUM')"


def _gaps(columns, cutoff):
    return "CAST(" + " + ".join(f"CAST({c} <= {cutoff} AS INT)" for c in columns) + " AS BIGINT)"


def _union(parts):
    return " UNION ALL ".join(parts)


def _hist(where="true"):
    return "h AS (SELECT sample_set, value, count(*) AS count FROM (" + _union(f"SELECT '{n}' AS sample_set, least({x}, {H.cap_of(len(SETS[n]))}) AS value FROM d WHERE {where}" for n, x in _SUM.items()) + ") GROUP BY ALL)"


def _stats(source, name):
    return f"""{name} AS (SELECT sample_set, min(value) AS min, sum(value * count) / sum(count) AS mean, max(value) AS max,
  sqrt(sum(count * (value - m) * (value - m)) / sum(count)) AS std, min(CASE WHEN cum >= 0.5::DOUBLE * n THEN value END) AS median,
  min(CASE WHEN cum >= 0.25::DOUBLE * n THEN value END) AS q1, min(CASE WHEN cum >= 0.75::DOUBLE * n THEN value END) AS q3
  FROM (SELECT *, sum(count) OVER (PARTITION BY sample_set ORDER BY value) AS cum, sum(count) OVER (PARTITION BY sample_set) AS n,
  sum(value * count) OVER (PARTITION BY sample_set) / sum(count) OVER (PARTITION BY sample_set) AS m FROM {source}) GROUP BY sample_set)"""


_LIMIT_SQL = """w AS (SELECT sample_set, floor(0.6::DOUBLE * (sum(value * count) / sum(count))) AS lower, floor(min(CASE WHEN cum >= 0.995::DOUBLE * n THEN value END) * 1.2::DOUBLE) AS max_bin
  FROM (SELECT *, sum(count) OVER (PARTITION BY sample_set ORDER BY value) AS cum, sum(count) OVER (PARTITION BY sample_set) AS n FROM h) GROUP BY sample_set),
f AS (SELECT sample_set, least(value, greatest(max_bin, 1) - 1) AS value, sum(count) AS count FROM h JOIN w USING (sample_set) GROUP BY ALL), """ + _stats("f", "fs") + """,
t AS (SELECT sample_set, CAST(lower AS BIGINT) AS lower, CAST(floor(median + 2 * std) AS BIGINT) AS upper, CAST(max_bin AS BIGINT) AS max_bin FROM w JOIN fs USING (sample_set))"""
_LIMITS_SQL = "(VALUES " + ", ".join(f"('{n}', {p['lower_coverage']}, {p['upper_coverage']}, {p['max_missing_samples']}, {len(SETS[n])})" for n, p in LIMITS.items()) + ") AS l(sample_set, lo, up, mm, ns)"


def _accessible(hist, lower, upper, size, source):
    return f"""SELECT sample_set, CAST(round(sum(CASE WHEN value BETWEEN {lower} AND {upper} THEN count ELSE 0 END) * CAST({size} AS DOUBLE) / sum(count)) AS BIGINT) AS accessible_bp,
  round(round(sum(CASE WHEN value BETWEEN {lower} AND {upper} THEN count ELSE 0 END) * CAST({size} AS DOUBLE) / sum(count)) / CAST({size} AS DOUBLE), 8) AS frac_full_genome FROM {hist} JOIN {source} USING (sample_set) GROUP BY sample_set"""


def _layers(cutoffs):
    parts = []
    for n, p in LIMITS.items():
        for k in cutoffs:
            cov = f"({_SUM[n]} < {p['lower_coverage']} OR {_SUM[n]} > {p['upper_coverage']})"
            gap = f"({_gaps(SETS[n], k)} > {p['max_missing_samples']})"
            parts.append(f"SELECT contig, lpos, pos, '{n}' AS sample_set, {k} AS missing_cutoff, {cov} AS excluded_coverage, {gap} AS excluded_missing, NOT ({cov} OR {gap}) AS accessible FROM d")
    return "m AS (" + _union(parts) + ")"


_WINDOWS = f"wm AS (SELECT contig_idx, CAST(floor(lpos / {WINDOW}) AS BIGINT) AS win, " + ", ".join(f"sum({c}) / {WINDOW}::DOUBLE AS {c}" for c in SAMPLES) + f" FROM d WHERE floor(lpos / {WINDOW}) < floor(len / {WINDOW}) GROUP BY 1, 2)"


def oracle_sql():
    q, big = {}, "CAST({} AS BIGINT)"
    q["track_sum"] = "SELECT pos, " + ", ".join(f"{x} AS sum_{n}" for n, x in _SUM.items()) + " FROM d"
    gaps = lambda k: ", ".join(f"{_gaps(c, k)} AS missing_{k}_{n}" for n, c in SETS.items())
    q["track_missingness"] = f"SELECT pos, {gaps(3)} FROM d"
    q["preprocess_multi_cutoff"] = "SELECT pos, " + ", ".join(f"{x} AS sum_{n}" for n, x in _SUM.items()) + f", {gaps(3)}, {gaps(12)} FROM d"
    q["sel_track"] = f"SELECT pos, s1, s4, s5 FROM d WHERE {_IN_TWO}"
    q["sel_columns"] = "SELECT 's2' AS sample, CAST(sum(s2) AS BIGINT) AS total FROM d UNION ALL SELECT 's4', CAST(sum(s4) AS BIGINT) FROM d"
    q["sel_merge_adjacent"] = "SELECT CAST(min(start) AS BIGINT) AS start, CAST(max(start + len) AS BIGINT) AS \"end\" FROM (SELECT start, len, contig_idx - row_number() OVER (ORDER BY contig_idx) AS g FROM gn WHERE contig IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED')) GROUP BY g"
    strided = "SELECT *, row_number() OVER (ORDER BY pos) - 1 AS r, count(*) OVER () AS n FROM d"
    q["sel_stride"] = f"SELECT pos, {_SUM['ALL']} AS \"sum_ALL\" FROM ({strided} WHERE {_IN_TWO}) WHERE r % CASE WHEN n > 1000 THEN CAST(ceil(n / 1000.0) AS BIGINT) ELSE 1 END = 0"
    q["hist_coverage"] = "SELECT CAST(least(s1, 40) AS BIGINT) AS value, count(*) AS count FROM d GROUP BY 1"
    q["hist_sum_sets"] = (_hist(), "SELECT * FROM h")
    q["hist_coverage_contigs"] = (_hist(_IN_TWO), "SELECT * FROM h")
    q["hist_missing_sets"] = "SELECT sample_set, value, count(*) AS count FROM (" + _union(f"SELECT '{n}' AS sample_set, {_gaps(c, 3)} AS value FROM d" for n, c in SETS.items()) + ") GROUP BY ALL"
    q["hist_missing_adhoc"] = f"SELECT {_gaps(ADHOC, 12)} AS value, count(*) AS count FROM d WHERE {_IN_TWO} GROUP BY 1"
    parts = []
    for n, c in {"ALL": SAMPLES, "adhoc": ADHOC, "pop2": SETS["pop2"]}.items():
        for m, x in {"sum": big.format(" + ".join(c)), "missing_3": _gaps(c, 3), "missing_12": _gaps(c, 12)}.items():
            parts.append(f"SELECT '{n}' AS selection, '{m}' AS metric, {x} AS value FROM d")
    q["hist_bundle"] = f"SELECT selection, metric, value, count(*) AS count FROM ({_union(parts)}) GROUP BY ALL"
    k = "CASE WHEN n > 4000 THEN CAST(ceil(n / 4000.0) AS BIGINT) ELSE 1 END"
    q["hist_scaled"] = f"SELECT {_SUM['ALL']} AS value, CAST(round_even(count(*) * (max(n)::DOUBLE / max(c)), 0) AS BIGINT) AS count FROM (SELECT *, count(*) OVER () AS c FROM ({strided}) WHERE r % {k} = 0) GROUP BY 1"
    q["hist_fold"] = (_hist(), "SELECT sample_set, least(value, 99) AS value, CAST(sum(count) AS BIGINT) AS count FROM h GROUP BY ALL")
    q["hist_stats"] = (_hist(), _stats("h", "st"), "SELECT sample_set, min, round(mean, 8) AS mean, median, max, round(std, 8) AS std FROM st")
    q["hist_boxplot"] = (_hist(), _stats("h", "st"), "SELECT sample_set, min, q1, median, q3, max FROM st")
    q["hist_quantile"] = (_hist(), "SELECT sample_set, q, min(value) AS value FROM (SELECT *, sum(count) OVER (PARTITION BY sample_set ORDER BY value) AS cum, sum(count) OVER (PARTITION BY sample_set) AS n FROM h), (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.995::DOUBLE)) AS x(q) WHERE cum >= q * n GROUP BY ALL")
    q["thresholds"] = (_hist(), _LIMIT_SQL, "SELECT * FROM t")
    fold1 = "f1 AS (SELECT sample_set, least(value, greatest(max_bin + 1, 1) - 1) AS value, sum(count) AS count FROM h JOIN t USING (sample_set) GROUP BY ALL)"
    sizes = "(VALUES " + ", ".join(f"('{n}', {len(c)})" for n, c in SETS.items()) + ") AS z(sample_set, ns)"
    means = ", ".join(f"round(mean * ({p} / 100::DOUBLE), 8) AS mean_{p}" for p in (60, 70, 80, 90))
    q["threshold_table"] = (
        _hist(), _LIMIT_SQL, fold1, _stats("f1", "s1"), f"a AS ({_accessible('f1', 'lower', 'upper', '(SELECT sum(len) FROM gn)', 't')})",
        f"SELECT sample_set, CAST(ns AS BIGINT) AS n_samples, lower, upper, max_bin, round(lower / ns, 8) AS lower_by_sample, round(upper / ns, 8) AS upper_by_sample, accessible_bp, frac_full_genome, frac_full_genome AS frac_active_genome, CAST(median AS BIGINT) AS median, round(mean, 8) AS mean, {means}, round(median + std, 8) AS median_plus_std, round(median + 2 * std, 8) AS median_plus_2std, round(std, 8) AS std FROM t JOIN a USING (sample_set) JOIN s1 USING (sample_set) JOIN {sizes} USING (sample_set)",
    )
    q["coverage_table"] = (_hist(_IN_TWO), _accessible("h", "lo", "up", f"(SELECT sum(len) FROM gn WHERE {_IN_TWO})", _LIMITS_SQL))
    q["missingness_table"] = "SELECT sample_set, CAST(count(*) FILTER (value <= mm) AS BIGINT) AS accessible_bp, round(count(*) FILTER (value <= mm) / CAST((SELECT sum(len) FROM gn) AS DOUBLE), 8) AS frac_genome, round(max(mm) / max(ns), 8) AS max_missing_by_sample FROM (" + _union(f"SELECT '{n}' AS sample_set, {_gaps(c, 3)} AS value FROM d" for n, c in SETS.items()) + f") JOIN {_LIMITS_SQL} USING (sample_set) GROUP BY sample_set"
    q["contig_means"] = _union(f"SELECT contig, '{n}' AS sample_set, round(sum({x}) / max(len), 8) AS mean FROM d GROUP BY contig" for n, x in _SUM.items())
    q["contig_scatter"] = _union(f"SELECT '{n}' AS sample_set, contig, max(len) AS length, round(sum({_SUM[n]}) / max(len) / nullif({a}, 0), 8) AS mean, round(sum({_SUM[n]}) / max(len), 8) AS total_mean FROM d GROUP BY contig" for n, a, _ in GROUPING.counts(ADHOC))
    pairs = "(VALUES " + ", ".join(f"('{c}', '{n}')" for n, m in SETS.items() for c in m) + ") AS p(sample, sample_set)"
    flags = "lm AS (SELECT 's' || l_linenumber AS sample, l_returnflag || l_linestatus AS sample_set, count(*) AS n FROM lineitem GROUP BY ALL), mp AS (SELECT sample, sample_set FROM (SELECT *, avg(n) OVER (PARTITION BY sample) AS most FROM lm) WHERE n >= most UNION ALL SELECT DISTINCT sample, 'ALL' FROM lm)"
    q["group_counts"] = (flags, "SELECT sample_set, count(*) FILTER (sample IN ('s1', 's2', 's3')) AS selected, count(*) AS total FROM mp GROUP BY sample_set")
    q["group_membership"] = (flags, "SELECT sample, coalesce(string_agg(sample_set, ',' ORDER BY sample_set) FILTER (sample_set <> 'ALL'), 'ALL') AS sample_sets FROM mp GROUP BY sample")
    q["active_genome"] = f"SELECT CAST(sum(len) FILTER ({_IN_TWO}) AS BIGINT) AS active_bp, round_even(sum(len) FILTER ({_IN_TWO}) / sum(len)::DOUBLE * 100, 2) AS active_per_cent FROM gn"
    some = "CASE contig_idx WHEN 0 THEN lpos >= len // 2 WHEN 3 THEN lpos < len * 2 // 3 ELSE contig_idx < 3 END"
    q["sel_intervals"] = f"SELECT contig, count(*) AS n, CAST(sum({_SUM['ALL']}) AS BIGINT) AS total FROM d WHERE {some} GROUP BY contig"
    q["window_starts_intervals"] = f"SELECT contig_idx, CAST(floor(lpos / {WINDOW}) AS BIGINT) AS \"window\", min(pos) AS start FROM d WHERE contig_idx IN (1, 2) AND floor(lpos / {WINDOW}) < floor(len / {WINDOW}) GROUP BY 1, 2"
    q["selection_overview"] = f"SELECT 'Contigs' AS type, 'all' AS label, count(*) FILTER ({_IN_TWO}) AS active, count(*) AS total FROM gn UNION ALL SELECT 'Samples', 'all', 3, 7 UNION ALL SELECT 'Positions', 'all', CAST(sum(len) FILTER ({_IN_TWO}) AS BIGINT), CAST(sum(len) AS BIGINT) FROM gn UNION ALL SELECT 'Sample set', sample_set, count(*) FILTER (sample IN ('s1', 's2', 's3')), count(*) FROM {pairs} GROUP BY sample_set"
    q["window_starts"] = f"SELECT contig_idx, CAST(floor(lpos / {WINDOW}) AS BIGINT) AS \"window\", min(pos) AS start FROM d WHERE floor(lpos / {WINDOW}) < floor(len / {WINDOW}) GROUP BY 1, 2"
    q["window_means"] = (_WINDOWS, "SELECT contig_idx, win AS \"window\", " + ", ".join(f"round({c}, 8) AS {c}" for c in SAMPLES) + " FROM wm")
    q["window_cov"] = (_WINDOWS, _union(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 8) AS covariance FROM wm" for i, a in enumerate(SAMPLES) for b in SAMPLES[i:]))
    q["window_moments"] = (_WINDOWS, _union(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(avg({a}), 8) AS mean_a, round(covar_samp({a}, {b}), 8) AS covariance FROM wm" for i, a in enumerate(SAMPLES) for b in SAMPLES[i:]))
    q["summary_masks"] = (_layers([3, 12]), "SELECT contig, sample_set, missing_cutoff, count(*) FILTER (accessible) AS accessible_bp FROM m GROUP BY ALL")
    q["mask_store_bp"] = (_layers([3, 12]), "SELECT contig, sample_set, missing_cutoff, count(*) AS accessible_bp FROM m WHERE accessible GROUP BY ALL")
    q["mask_store_layers"] = (_layers([3]), "SELECT contig, sample_set, min(lpos) AS start, max(lpos) + 1 AS \"end\" FROM (SELECT contig, sample_set, lpos, lpos - row_number() OVER (PARTITION BY contig, sample_set ORDER BY lpos) AS g FROM m WHERE accessible) GROUP BY contig, sample_set, g")
    q["mask_runs"] = (_layers([3]), "SELECT contig, sample_set, min(lpos) AS start, max(lpos) + 1 AS \"end\" FROM (SELECT contig, sample_set, lpos, lpos - row_number() OVER (PARTITION BY contig, sample_set ORDER BY lpos) AS g FROM m WHERE NOT excluded_coverage) GROUP BY contig, sample_set, g")
    q["import_runs"] = "SELECT contig, lpos, pos, s1, s6 FROM d"
    q["mask_layers"] = (_layers([3]), "SELECT pos, sample_set, excluded_coverage, excluded_missing, accessible FROM m")
    q["mask_multi_cutoff"] = (_layers([3, 12]), "SELECT sample_set, missing_cutoff, count(*) FILTER (accessible) AS accessible_bp, count(*) FILTER (excluded_missing) AS missing_bp FROM m GROUP BY ALL")
    q["mask_bed"] = (_layers([3]), "SELECT contig, min(lpos) AS start, max(lpos) + 1 AS \"end\" FROM (SELECT contig, lpos, lpos - row_number() OVER (PARTITION BY contig ORDER BY lpos) AS g FROM m WHERE sample_set = 'ALL' AND accessible) GROUP BY contig, g")
    q["mask_bp"] = (_layers([3]), "SELECT contig, sample_set, count(*) FILTER (accessible) AS accessible_bp FROM m GROUP BY ALL")
    chosen = {"ALL": (SAMPLES, "true", H.cap_of(7)), "pop2 in two": (SETS["pop2"], _IN_TWO, H.cap_of(2)), "adhoc": (ADHOC, _IN_TWO, H.cap_of(4))}
    q["hist_summary_rewrite"] = "SELECT selection, value, count(*) AS count FROM (" + _union(f"SELECT '{n}' AS selection, least({big.format(' + '.join(c))}, {cap}) AS value FROM d WHERE {w}" for n, (c, w, cap) in chosen.items()) + ") GROUP BY ALL"
    q["hist_beyond_cap"] = f"SELECT least({_SUM['ALL']}, 249) AS value, count(*) AS count FROM d GROUP BY 1"
    parts = []
    for n, (c, w) in {"ALL": (SAMPLES, "true"), "pop1 in two": (SETS["pop1"], _IN_TWO), "adhoc": (ADHOC, "true")}.items():
        for cutoff in (3, 7):
            step = "CASE WHEN n > 2000 THEN CAST(ceil(n / 2000.0) AS BIGINT) ELSE 1 END"
            parts.append(f"SELECT '{n}' AS selection, {cutoff} AS cutoff, {_gaps(c, cutoff)} AS value, n, count(*) OVER () AS c FROM ({strided} WHERE {w}) WHERE r % {step} = 0")
    q["hist_many"] = f"SELECT selection, cutoff, value, CAST(round_even(count(*) * (max(n)::DOUBLE / max(c)), 0) AS BIGINT) AS count FROM ({_union(parts)}) GROUP BY ALL"
    two = {"pop2": SETS["pop2"], "adhoc": ADHOC}
    pages = [(n, "few", f"least({big.format(' + '.join(c))}, {k})") for (n, c), k in zip(two.items(), (19, 59))]
    pages += [(n, "all", f"least({big.format(' + '.join(c))}, {H.cap_of(len(c))})") for n, c in two.items()]
    pages += [(n, f"missing {k}", _gaps(c, k)) for n, c in two.items() for k in (3, 12)]
    q["hist_pages"] = "SELECT selection, page, value, count(*) AS count FROM (" + _union(f"SELECT '{n}' AS selection, '{p}' AS page, {x} AS value FROM d WHERE {_IN_TWO}" for n, p, x in pages) + ") GROUP BY ALL"
    steps = [("p", "first", "s1 + s2"), ("p", "regrouped", "s1 + s3"), ("q", "regrouped", "s4 + s5"), ("p", "rewritten", "s1 + s2 + s3"), ("q", "rewritten", "s4 + s5")]
    steps = [(n, x, f"least({big.format(v)}, {H.cap_of(2)})") for n, x, v in steps] + [("p", "missing", _gaps(("(s1 + s2)", "s3"), 3))]
    q["hist_stale_summary"] = "SELECT selection, step, value, count(*) AS count FROM (" + _union(f"SELECT '{n}' AS selection, '{x}' AS step, {v} AS value FROM d" for n, x, v in steps) + ") GROUP BY ALL"
    own = {n: [x for x in c if x in ADHOC] for n, c in SETS.items()}
    hist = "h AS (SELECT sample_set, value, count(*) AS count FROM (" + _union(f"SELECT '{n}' AS sample_set, least({big.format(' + '.join(c))}, {H.cap_of(len(c))}) AS value FROM d WHERE {_IN_TWO}" for n, c in own.items()) + ") GROUP BY ALL)"
    chosen = "(VALUES " + ", ".join(f"('{n}', {len(c)})" for n, c in own.items()) + ") AS z(sample_set, k)"
    per = f"""p AS (SELECT sample_set || CASE WHEN b THEN '|true' ELSE '|false' END AS sample_set, value::DOUBLE / CASE WHEN b THEN k ELSE 1 END AS value, count, lo, up, k, CASE WHEN b THEN k ELSE 1 END AS per
  FROM h JOIN {_LIMITS_SQL} USING (sample_set) JOIN {chosen} USING (sample_set), (VALUES (true), (false)) AS x(b))"""
    inside = "a AS (SELECT sample_set, max(lo) AS lo, max(up) AS up, max(k) AS k, sum(CASE WHEN value >= lo::DOUBLE / per AND value <= up::DOUBLE / per THEN count ELSE 0 END) AS bp FROM p GROUP BY sample_set)"
    means = ", ".join(f"round(mean * ({x} / 100::DOUBLE), 8) AS mean_{x}" for x in (60, 70, 80, 90))
    share = "round(bp / (SELECT sum(len) FROM gn)::DOUBLE, 8)"
    q["coverage_indicators"] = (
        hist, per, _stats("p", "st"), inside,
        f"SELECT split_part(sample_set, '|', 1) AS sample_set, split_part(sample_set, '|', 2) = 'true' AS by_sample, CAST(lo AS BIGINT) AS lower, round(lo / k, 8) AS lower_by_sample, CAST(up AS BIGINT) AS upper, round(up / k, 8) AS upper_by_sample, CAST(bp AS BIGINT) AS accessible_bp, {share} AS frac_active_genome, {share} AS frac_full_genome, round(median, 8) AS median, round(mean, 8) AS mean, {means}, round(median + std, 8) AS median_plus_std, round(median + 2 * std, 8) AS median_plus_2std, round(std, 8) AS std FROM a JOIN st USING (sample_set)",
    )
    q["contigs_filtered"] = f"SELECT contig, CAST(len AS BIGINT) AS contig_len FROM gn WHERE len >= (SELECT len FROM gn ORDER BY len LIMIT 1 OFFSET 1) AND ({_IN_TWO} OR contig IN ('2-HIGH', '5-LOW'))"
    matrix = {(a, b): f"covar_samp({a}, {b}) / (avg({a}) * avg({b}))" for a in SAMPLES for b in SAMPLES}
    trace, squares = " + ".join(matrix[a, a] for a in SAMPLES), " + ".join(f"power({x}, 2)" for x in matrix.values())
    q["pca_invariants"] = (_WINDOWS, f"SELECT count(*) AS n_windows, round({trace}, 8) AS trace, round({squares}, 8) AS squares, 1.0::DOUBLE AS ratios FROM wm")
    out = {}
    for name, x in q.items():
        *more, last = x if isinstance(x, tuple) else (x,)
        out[name] = "WITH " + ",\n".join([_TRACK, *more]) + "\n" + last
    return out
