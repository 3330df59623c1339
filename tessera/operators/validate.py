"""Held-out splits, ranking recovery, marker recovery and paired summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.checks import assert_empty
from tessera.functions.numeric import hash_uniform, ratio
from tessera.functions.ranks import avg_rank, pearson, spearman
from tessera.model import SpatialData

CUTOFFS = (100, 200, 500)


def split_slice(ds: SpatialData, slice_id: str, check: bool = True) -> tuple[SpatialData, SpatialData]:
    """(training, held-out) by one slice; at least two slices are needed."""
    if check and ds.spots.select("slice").distinct().limit(2).count() < 2:
        raise ValueError("a held-out split needs at least two slices")
    held = F.col("slice") == slice_id

    def part(keep: Column) -> SpatialData:
        return SpatialData(ds.spots.filter(keep), ds.genes, ds.expr.filter(keep), ds.pairs)

    return part(~held), part(held)


def split_individual(ds: SpatialData, donors: DataFrame, donor: str, check: bool = True) -> tuple[SpatialData, SpatialData]:
    """Hold out all slices of a donor. donors(slice, donor)."""
    own = donors.filter(F.col("donor") == donor).select("slice")

    def part(how: str) -> SpatialData:
        return SpatialData(ds.spots.join(own, "slice", how), ds.genes, ds.expr.join(own, "slice", how), ds.pairs)

    train, held = part("left_anti"), part("left_semi")
    if check:
        assert_empty(train.spots.select("spot_id").join(held.spots.select("spot_id"), "spot_id", "left_semi"), "spot in both parts")
    return train, held


def rank_vector(genes: DataFrame, ranking: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Every gene with length - rank + 1, or 0 when it is not ranked. `ranking` covers its groups."""
    by = list(by)
    size = F.count("*").over(Window.partitionBy(*by))
    known = ranking.join(genes.select("gene"), "gene", "left_semi")
    scored = known.select(*by, "gene", (size - F.col("rank") + 1).cast("double").alias(name))
    if not by:
        return genes.select("gene").join(scored, "gene", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    names = genes.agg(F.collect_set("gene")).scalar()  # the gene dictionary
    grid = known.select(*by).distinct().withColumn("gene", F.explode(names))
    return grid.join(scored, [*by, "gene"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def reproducibility(train: DataFrame, reference: DataFrame, genes: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Top-n Jaccard, mean reference percentile of the training top n, and Spearman of rank vectors.
    With groups, both rankings carry the group columns (folds, methods) and all run in one plan."""
    by = list(by)
    a, b = rank_vector(genes, train, "_t", by), rank_vector(genes, reference, "_r", by)
    j = a.join(b, [*by, "gene"], "full").na.fill(0.0, ["_t", "_r"])
    w = Window.partitionBy(*by)
    top_t = Window.partitionBy(*by).orderBy(F.desc("_t"), "gene")
    top_r = Window.partitionBy(*by).orderBy(F.desc("_r"), "gene")
    j = j.withColumns({"rt": avg_rank("_t", by), "rr": avg_rank("_r", by), "size": F.count("*").over(w),
                       "in_t": (F.row_number().over(top_t) <= n) & (F.col("_t") > 0),
                       "in_r": (F.row_number().over(top_r) <= n) & (F.col("_r") > 0)})
    return j.groupBy(*by).agg(
        (F.count_if(F.col("in_t") & F.col("in_r")) / F.greatest(F.count_if(F.col("in_t") | F.col("in_r")), F.lit(1))).alias("topn_jaccard"),
        F.avg(F.when(F.col("in_t"), F.col("rr") / F.col("size"))).alias("reference_percentile"),
        pearson("rt", "rr").alias("rank_spearman"))


def heldout_clustering(heldout: SpatialData, ranking: DataFrame, n: int, seed: int = 0, n_comp: int = 30,
                       n_init: int = 5) -> DataFrame:
    """SVD of the selected genes, k-means with as many clusters as labels, then agreement and spatial metrics."""
    from tessera.operators.embed import svd_embed
    from tessera.operators.metrics import ari, chaos, kmeans_embed, nmi, pas, silhouette

    features = ranking.filter(F.col("rank") <= n).select("gene")
    emb = svd_embed(heldout, features, n_comp)
    k = heldout.spots.select("label").distinct().count()
    pred = kmeans_embed(emb, k, seed, n_init)
    placed = heldout.spots.select("spot_id", "slice", "x", "y").join(pred.select("spot_id", "cluster"), "spot_id")
    mean = F.avg("value").alias("value")
    parts = {"ari": ari(pred, "label", "cluster"), "nmi": nmi(pred, "label", "cluster"), "silhouette": silhouette(pred, "cluster"),
             "CHAOS": chaos(placed, "cluster").agg(mean), "PAS": pas(placed, "cluster").agg(mean)}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def heldout_frame(scores: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide fold scores to long metric rows."""
    return scores.unpivot(list(keys), list(columns), "metric", "value")


def _recovery_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if("truth").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))


def score_ranking(ranking: DataFrame, truth: DataFrame, by: Sequence[str], cutoffs: Sequence[int] = CUTOFFS,
                  at: int = 500) -> DataFrame:
    """Recovery of true genes: AUROC, AUPRC, precision and recall at cut-offs, recall by pattern and effect.

    truth(gene, gene_index, is_svg, pattern, effect). Unranked genes score 0 and share one tie block.
    Groups are rankings over the gene dictionary."""
    by = list(by)
    vec = rank_vector(truth, ranking, "score", by)
    d = vec.join(truth, "gene").withColumn("truth", F.col("is_svg"))
    w = Window.partitionBy(*by)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("gene_index"))
    d = d.withColumns({"r": avg_rank("score", by), "place": F.row_number().over(order), "n": F.count("*").over(w)})
    c = d.groupBy(*by).agg(F.count_if("truth").cast("double").alias("p"), F.count("*").cast("double").alias("n"),
                           F.sum(F.when(F.col("truth"), F.col("r")).otherwise(0.0)).alias("rs"))
    auroc = ratio(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    # average precision: one step per distinct score
    steps = d.groupBy(*by, "score").agg(F.count_if("truth").alias("tp"), F.count("*").alias("m"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"ctp": F.sum("tp").over(down), "cm": F.sum("m").over(down), "pos": F.sum("tp").over(w)})
    ap = steps.groupBy(*by).agg(F.sum(ratio("tp", "pos") * F.col("ctp") / F.col("cm")).alias("value"))

    def row(df: DataFrame, summary: str, stratum: Column | str, cutoff: Column | None, metric: str, value: Column) -> DataFrame:
        return df.select(*by, F.lit(summary).alias("summary"), (F.lit(stratum) if isinstance(stratum, str) else stratum).alias("stratum"),
                         (F.lit(None) if cutoff is None else cutoff).cast("bigint").alias("cutoff"), F.lit(metric).alias("metric"), value.alias("value"))

    out = row(c, "overall", "all_svg", None, "AUROC", auroc).unionByName(row(ap, "overall", "all_svg", None, "AUPRC", F.col("value")))
    # one pass for all cut-offs: each gene counts for the cut-offs it is inside of
    levels = F.array(*[F.lit(int(k)) for k in cutoffs])
    inside = d.withColumn("cut", F.explode(levels)).withColumn("eff", F.least(F.col("cut").cast("bigint"), F.col("n"))).groupBy(*by, "cut", "eff").agg(
        F.count_if(F.col("truth") & (F.col("place") <= F.col("eff"))).alias("tp"), F.count_if("truth").alias("p"))
    out = out.unionByName(row(inside, "cutoff", "all_svg", F.col("eff"), "Precision", F.col("tp") / F.greatest("eff", F.lit(1))))
    out = out.unionByName(row(inside, "cutoff", "all_svg", F.col("eff"), "Recall", F.col("tp") / F.greatest("p", F.lit(1))))
    for name in ("pattern", "effect"):
        s = d.filter("truth").withColumn("eff", F.least(F.lit(at), F.col("n"))).groupBy(*by, name, "eff").agg(
            F.count_if(F.col("place") <= F.col("eff")).alias("tp"), F.count("*").alias("p"))
        out = out.unionByName(row(s, name, F.col(name), F.col("eff"), "Recall", F.col("tp") / F.greatest("p", F.lit(1))))
    return out


def score_all_features(truth: DataFrame) -> DataFrame:
    """Constants of the method that keeps every gene."""
    c = truth.agg(F.count("*").alias("n"), F.avg(F.col("is_svg").cast("double")).alias("prev"))
    none = F.lit(None).cast("bigint")

    def row(summary: str, cutoff: Column, metric: str, value: Column) -> Column:
        return F.struct(F.lit(summary).alias("summary"), cutoff.alias("cutoff"), F.lit(metric).alias("metric"), value.alias("value"))

    rows = F.array(row("overall", none, "AUROC", F.lit(0.5)), row("overall", none, "AUPRC", F.col("prev")),
                   row("cutoff", F.col("n"), "Precision", F.col("prev")), row("cutoff", F.col("n"), "Recall", F.lit(1.0)))
    return c.select(F.explode(rows).alias("r")).select("r.summary", F.lit("all_svg").alias("stratum"), "r.cutoff", "r.metric", "r.value")


def marker_recovery(selected: DataFrame, markers: DataFrame, universe: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlap of selections (by, gene) with marker sets (marker_set, gene) against the uniform expectation.
    Marker sets are short lists kept as one array per set, so a selection meets each set once."""
    by = list(by)
    n = universe.select(F.count("*")).scalar()
    sets = markers.join(universe.select("gene"), "gene", "left_semi").groupBy("marker_set").agg(F.count_distinct("gene").alias("available_markers"))
    every = sets.agg(F.collect_list(F.struct("marker_set", "available_markers"))).scalar()
    sizes = selected.groupBy(*by).agg(F.count_distinct("gene").alias("selected_genes")).withColumn("_s", F.explode(every)).select(
        *by, "selected_genes", "_s.marker_set", "_s.available_markers")
    hits = selected.distinct().join(markers.distinct(), "gene").groupBy(*by, "marker_set").agg(F.count("*").alias("overlap"))
    j = sizes.join(hits, [*by, "marker_set"], "left").na.fill(0, ["overlap"]).withColumn("background_genes", n)
    expected = F.col("selected_genes") * F.col("available_markers") / F.col("background_genes")
    return j.withColumns({"marker_recall": ratio("overlap", "available_markers"), "uniform_expected": expected,
                          "uniform_enrichment": ratio(F.col("overlap"), expected)})


def background_bins(gene_stats: DataFrame, q: int = 10) -> DataFrame:
    """Joint quantile bins of mean and detection (duplicate edges merge): gene, bin."""
    probs = [i / q for i in range(1, q)]
    edges = gene_stats.agg(F.percentile("mean", probs).alias("m"), F.percentile("detection", probs).alias("d"))
    j = gene_stats.withColumns({"_m": edges.select("m").scalar(), "_d": edges.select("d").scalar()})

    def place(cuts: str, v: str) -> Column:
        return F.size(F.filter(F.array_distinct(cuts), lambda e: F.round(e, 12) < F.round(F.col(v), 12)))

    return j.select("gene", F.concat_ws("_", place("_m", "mean"), place("_d", "detection")).alias("bin"))


def bin_counts(selected: DataFrame, markers: DataFrame, bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and bin: bin size, markers and selected genes in it (bins without selected genes drop out)."""
    size = bins.groupBy("bin").agg(F.count("*").alias("size"))
    m = markers.select("gene").distinct().join(bins, "gene").groupBy("bin").agg(F.count("*").alias("m"))
    n = selected.select(*by, "gene").distinct().join(bins, "gene").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return n.join(size, "bin").join(m, "bin", "left").na.fill(0, ["m"])


def matched_expectation(selected: DataFrame, markers: DataFrame, gene_stats: DataFrame, by: Sequence[str], q: int = 10) -> DataFrame:
    """Expected overlap when selected genes are drawn inside bins of like mean and detection."""
    bins = background_bins(gene_stats, q)
    c = bin_counts(selected, markers, bins, by)
    overlap = selected.select(*by, "gene").distinct().join(markers.select("gene").distinct(), "gene", "left_semi").groupBy(*by).agg(F.count("*").alias("overlap"))
    e = c.groupBy(*by).agg(F.sum(F.col("n") * F.col("m") / F.col("size")).alias("matched_expected"))
    return e.join(overlap, list(by), "left").na.fill(0, ["overlap"]).withColumn("matched_enrichment", ratio("overlap", "matched_expected"))


def matched_null(selected: DataFrame, markers: DataFrame, gene_stats: DataFrame, by: Sequence[str], draws: int = 10000,
                 seed: int = 0, q: int = 10) -> DataFrame:
    """95 % range of the overlap under draws without replacement inside each bin.

    Per draw and bin the overlap is hypergeometric. It is drawn by its inverse distribution function from one
    hashed uniform, so a draw costs one row per bin and not one row per gene."""
    c = bin_counts(selected, markers, background_bins(gene_stats, q), by).filter("m > 0")
    n, m, s = F.col("n"), F.col("m"), F.col("size")

    def ln_choose(a: Column, b: Column) -> Column:
        return _ln_fact(a) - _ln_fact(b) - _ln_fact(a - b)

    lo, hi = F.greatest(F.lit(0).cast("bigint"), n + m - s), F.least(n, m)
    pmf = F.transform(F.sequence(lo, hi), lambda k: F.struct(k.alias("k"), F.exp(
        ln_choose(m, k) + ln_choose(s - m, n - k) - ln_choose(s, n)).alias("p")))
    c = c.withColumn("_pmf", pmf).withColumn("_u0", F.concat_ws("|", *by, "bin"))
    d = c.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = hash_uniform(seed, F.concat_ws("|", "_u0", "draw"))
    d = d.withColumn("_u", u)
    k = F.aggregate("_pmf", F.struct(F.lit(0.0).alias("c"), lo.alias("k")), lambda a, e: F.struct(
        (a["c"] + e["p"]).alias("c"), F.when(a["c"] < F.col("_u"), e["k"]).otherwise(a["k"]).alias("k")))["k"]
    totals = d.groupBy(*by, "draw").agg(F.sum(k).alias("x"))
    return totals.groupBy(*by).agg(F.avg("x").alias("null_mean"), F.percentile("x", 0.025).alias("null_lower"),
                                   F.percentile("x", 0.975).alias("null_upper"))


def _ln_fact(k: Column) -> Column:
    """log k!: a table for small k, Stirling's series beyond it."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(33)])
    x = k.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k <= 32, F.get(small, k.cast("int"))).otherwise(series)


def hierarchical_mean(df: DataFrame, levels: Sequence[str], value: str, check: bool = False) -> DataFrame:
    """Mean over the last level, then over the one before, and so on: each level weighs its members equally."""
    levels = list(levels)
    if check:
        sizes = df.groupBy(*levels).agg(F.count(value).alias("c"))
        if sizes.select("c").distinct().limit(2).count() > 1:
            raise ValueError("incomplete block: groups differ in size")
    out = df.select(*levels, F.col(value).alias("value"))
    for depth in range(len(levels), 0, -1):
        out = out.groupBy(*levels[:depth]).agg(F.avg("value").alias("value"))
    return out


def paired_difference(df: DataFrame, keys: Sequence[str], condition: str, first: str, second: str, value: str) -> DataFrame:
    """second - first of the same key."""
    wide = df.groupBy(*keys).pivot(condition, [first, second]).agg(F.avg(value))
    return wide.select(*keys, F.col(first).alias("first_value"), F.col(second).alias("second_value"),
                       (F.col(second) - F.col(first)).alias("difference")).filter("difference IS NOT NULL")


def reference_concordance(long: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """heldout long rows (fold, method, reference, metric, value): Spearman of each metric between two
    references, and of each reference metric with `ari`, with a fold-cluster bootstrap interval."""
    from tessera.operators.robust import bootstrap_spearman

    mean = long.filter("metric <> 'ari'").groupBy("method", "metric", "reference").agg(F.round(F.avg("value"), 9).alias("v"))
    refs = long.filter("reference IS NOT NULL").agg(F.min("reference").alias("a"), F.max("reference").alias("b"))
    both = mean.groupBy("method", "metric").agg(
        F.max(F.when(F.col("reference") == refs.select("a").scalar(), F.col("v"))).alias("x"),
        F.max(F.when(F.col("reference") == refs.select("b").scalar(), F.col("v"))).alias("y"))
    cross = spearman(both, "x", "y", ["metric"], "rho").select(
        F.concat(F.lit("references:"), "metric").alias("comparison"), "n", "rho",
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    ari = long.filter("metric = 'ari'").select("fold", "method", F.col("value").alias("y"))
    j = long.filter("metric <> 'ari'").join(ari, ["fold", "method"]).select(
        F.concat_ws(":", "reference", "metric").alias("comparison"), "fold", F.col("value").alias("x"), "y")
    boot = bootstrap_spearman(j, "x", "y", "fold", draws, seed, ["comparison"]).select("comparison", "n", "rho", "lower", "upper")
    return cross.unionByName(boot)
