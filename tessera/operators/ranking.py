"""Gene rankings from per-gene statistics and ranked lists, and the common selection contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import hash_uniform, ratio
from tessera.functions.ranks import avg_rank, percentile_scores
from tessera.model import SpatialData
from tessera.session import cut_lineage


def top_features(scores: DataFrame, n: int | None, by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Rank by score descending, then gene index descending; keep the first n.
    Scores are rounded first so that sums taken in another order cannot break a tie."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("gene_index"))
    ranked = scores.withColumn("score", F.round(F.col("score"), digits)).withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def selection_summary(ranking: DataFrame, by: Sequence[str] = (), requested: int | None = None) -> DataFrame:
    """Requested and effective counts and the md5 of newline-joined names in rank order.
    A selection is bounded by the gene dictionary, so its ordered list fits one row."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda e: e["gene"])
    return ranking.groupBy(*by).agg(
        F.count("*").alias("effective_n_features"), F.md5(F.array_join(names, "\n")).alias("feature_hash")
    ).withColumn("requested_n_features", F.lit(requested).cast("bigint"))


def ranked_result(ranked: DataFrame, genes: DataFrame, n: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Ordered list (gene, position): first position per gene, unknown genes dropped, then cut at n."""
    first = ranked.groupBy(*by, "gene").agg(F.min("position").alias("position")).join(
        genes.select("gene", "gene_index"), "gene")
    w = Window.partitionBy(*by).orderBy("position")
    out = first.withColumn("rank", F.row_number().over(w))
    out = out if n is None else out.filter(F.col("rank") <= n)
    size = F.count("*").over(Window.partitionBy(*by))
    return out.withColumn("score", (size - F.col("rank") + 1).cast("double"))


def n_spots(ds: SpatialData) -> Column:
    return ds.spots.select(F.count("*")).scalar()


def expand_scores(scores: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes without a score get 0, over the full universe."""
    return genes.select("gene", "gene_index").join(scores.select("gene", "score"), "gene", "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0)))


def all_features(ds: SpatialData) -> DataFrame:
    total = ds.genes.select(F.count("*")).scalar()
    return ds.genes.select("gene", "gene_index", (total - F.col("gene_index")).cast("double").alias("score"))


def random(ds: SpatialData, seed: int = 0) -> DataFrame:
    return ds.genes.select("gene", "gene_index", hash_uniform(seed, "gene").alias("score"))


def highly_expressed(ds: SpatialData, column: str = "value") -> DataFrame:
    means = ds.expr.groupBy("gene").agg((F.sum(column) / n_spots(ds)).alias("score"))
    return expand_scores(means, ds.genes)


def statistic(ds: SpatialData, kind: str = "mean", column: str = "value") -> DataFrame:
    """Mean or population variance E[x^2] - E[x]^2 of the normalized log values."""
    n, v = n_spots(ds), F.col(column)
    score = F.sum(v) / n if kind == "mean" else F.greatest(F.sum(v * v) / n - (F.sum(v) / n) * (F.sum(v) / n), F.lit(0.0))
    return expand_scores(ds.expr.groupBy("gene").agg(score.alias("score")), ds.genes)


def slice_moments(ds: SpatialData, column: str = "value") -> DataFrame:
    """Per slice and present gene: slice size, mean, population and sample variance; zeros counted."""
    v = F.col(column)
    sums = ds.expr.groupBy("slice", "gene").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.count_if(v > 0).alias("n_detected"))
    m = F.col("_s") / F.col("n_spots")
    pop = F.greatest(F.col("_q") / F.col("n_spots") - m * m, F.lit(0.0))
    return sums.join(ds.slice_sizes(), "slice").select(
        "slice", "gene", "n_spots", "n_detected", m.alias("mean"), pop.alias("var_pop"),
        ratio(pop * F.col("n_spots"), F.col("n_spots") - 1).alias("var"))


def global_moments(ds: SpatialData, column: str = "value") -> DataFrame:
    v, n = F.col(column), F.col("n_spots")
    sums = ds.expr.groupBy("gene").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.count_if(v > 0).alias("n_detected"))
    m = F.col("_s") / n
    pop = F.greatest(F.col("_q") / n - m * m, F.lit(0.0))
    return sums.withColumn("n_spots", n_spots(ds)).select(
        F.lit("all").alias("slice"), "gene", "n_spots", "n_detected", m.alias("mean"), pop.alias("var_pop"),
        ratio(pop * n, n - 1).alias("var"))


def conserved(ds: SpatialData, column: str = "value") -> DataFrame:
    """Mean of slice means over (1 + CV). A gene absent from a slice has slice mean 0, so the sums over
    present slices with the full slice count give the same moments."""
    k = ds.spots.agg(F.count_distinct("slice").cast("double")).scalar()
    m = F.col("_m")
    sd = F.sqrt(F.greatest(ratio(F.col("_q") - k * m * m, k - 1), F.lit(0.0)))
    means = slice_moments(ds, column).groupBy("gene").agg((F.sum("mean") / k).alias("_m"), F.sum(F.col("mean") * F.col("mean")).alias("_q"))
    scores = means.select("gene", (m / (1.0 + F.coalesce(sd, F.lit(0.0)) / (m + 1e-8))).alias("score"))
    return expand_scores(scores, ds.genes)


def tf_list(ds: SpatialData, factors: DataFrame, species: str) -> DataFrame:
    """Transcription factors of a species in list order. The key is ENSEMBL when all gene names
    start with ENS, else the symbol without case."""
    head = ds.genes.agg(F.bool_and(F.col("gene").startswith("ENS")).alias("e")).first()["e"]
    known = factors.filter(F.lower("Species") == species.lower())
    if head:
        keyed = known.select(F.col("ENSEMBL").alias("gene"), "position")
    else:
        keyed = known.select(F.upper("Gene").alias("_key"), "position").join(
            ds.genes.select("gene", F.upper("gene").alias("_key")), "_key").select("gene", "position")
    return ranked_result(keyed, ds.genes, None)


def slice_percentile_mean(slice_scores: DataFrame, genes: DataFrame, n_slices: Column | int, missing: str = "zero") -> DataFrame:
    """Within-slice percentile ranks averaged over slices. Absent or non-finite genes count as 0,
    or are left out of the mean with missing='exclude'. Ranks run over genes of one slice,
    a group bounded by the gene dictionary."""
    finite = F.when(F.abs("score") < float("inf"), F.round("score", 12))
    scored = slice_scores.withColumn("_f", finite).filter("_f IS NOT NULL")
    p = scored.withColumn("_p", percentile_scores("_f", ["slice"]))
    divisor = F.count("*") if missing == "exclude" else n_slices
    return expand_scores(p.groupBy("gene").agg((F.sum("_p") / divisor).alias("score")), genes)


def sanitize_pvalue(column: str) -> Column:
    p = F.col(column)
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return F.when(finite, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(1.0))


def pvalue_percentile(df: DataFrame, column: str, by: Sequence[str] = (), floor: float = 1e-300) -> DataFrame:
    """-log10 of the cleaned p-value with a floor, and its average-rank percentile."""
    df = df.withColumn("p_clean", sanitize_pvalue(column))
    df = df.withColumn("neg_log10_p", -F.log10(F.greatest("p_clean", F.lit(floor))) + F.lit(0.0))
    return df.withColumn("percentile", percentile_scores("neg_log10_p", list(by)))


def balanced_union(a: DataFrame, b: DataFrame, n: int, by: Sequence[str] = (), extra_to_first: bool = False) -> DataFrame:
    """Half of each ranked list, then alternate from the same depth until n genes are chosen.

    Every gene gets its earliest place in the virtual sequence (phase, depth, source); the first n by
    that place are the union. The odd slot belongs to the second list, or to the first on request."""
    half = (n + 1) // 2 if extra_to_first else n // 2
    rest, start = n - half, 0 if extra_to_first else half

    def places(df: DataFrame, source: int, head: int) -> DataFrame:
        in_head = F.col("rank") <= head
        place = F.struct(
            F.when(in_head, source).otherwise(2).alias("phase"),
            F.when(in_head, F.col("rank")).otherwise(F.col("rank") - 1).alias("depth"),
            F.lit(source).alias("source"))
        # a gene past its own head is only reached by the alternation, which begins at `start`
        return df.filter(in_head | (F.col("rank") > start)).select(*by, "gene", place.alias("place"))

    first = places(a, 0, half).unionByName(places(b, 1, rest)).groupBy(*by, "gene").agg(F.min("place").alias("place"))
    w = Window.partitionBy(*by).orderBy("place")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(*by, "gene", "rank")


def rank_intersection(a: DataFrame, b: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Genes in both top-n lists by the sum of ranks, then name; not padded."""
    left = a.filter(F.col("rank") <= n).select(*by, "gene", F.col("rank").alias("_a"))
    right = b.filter(F.col("rank") <= n).select(*by, "gene", F.col("rank").alias("_b"))
    w = Window.partitionBy(*by).orderBy(F.col("_a") + F.col("_b"), "gene")
    return left.join(right, [*by, "gene"]).withColumn("rank", F.row_number().over(w)).select(*by, "gene", "rank")


def retain_targets(strategy: str, budget: int, first: DataFrame, second: DataFrame, targets: DataFrame,
                   n_targets: int, by: Sequence[str] = ()) -> DataFrame:
    """Exactly `budget` genes with all targets: the rest comes from either list or the alternating union
    without the targets (there the odd slot goes to the first list)."""
    if n_targets > budget:
        raise ValueError("more mandatory targets than the budget allows")
    fill = budget - n_targets
    targets = targets.select("gene").distinct()

    def without(df: DataFrame) -> DataFrame:
        left = df.join(targets, "gene", "left_anti")
        w = Window.partitionBy(*by).orderBy("rank")
        return left.withColumn("rank", F.row_number().over(w)).select(*by, "gene", "rank")

    if strategy == "HVG":
        chosen = without(first).filter(F.col("rank") <= fill)
    elif strategy == "SVG":
        chosen = without(second).filter(F.col("rank") <= fill)
    else:
        chosen = balanced_union(without(first), without(second), fill, by, extra_to_first=True)
    groups = first.select(*by).distinct() if by else None
    forced = targets.select("gene", F.lit(fill).alias("_o"))
    if groups is not None:
        names = targets.agg(F.sort_array(F.collect_set("gene")).alias("g")).scalar()
        forced = groups.select(*by, F.explode(names).alias("gene"), F.lit(fill).alias("_o"))
    forced = forced.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("gene")) + F.col("_o"))
    return chosen.select(*by, "gene", "rank", F.lit(False).alias("is_target")).unionByName(
        forced.select(*by, "gene", "rank", F.lit(True).alias("is_target")))


def candidate_genes(ds: SpatialData, max_genes: int, min_spots: int = 10, column: str = "value") -> DataFrame:
    """Per slice of sufficient size: genes with positive variance, the `max_genes` most variable."""
    w = Window.partitionBy("slice").orderBy(F.desc("variance"), "gene")
    return slice_moments(ds, column).filter(F.col("n_spots") >= min_spots).select(
        "slice", "gene", F.round("var_pop", 9).alias("variance")).filter("variance > 0").withColumn(
        "rank", F.row_number().over(w)).filter(F.col("rank") <= max_genes)


def wilcoxon(ds: SpatialData, n: int, column: str = "value", max_q: float = 0.01) -> DataFrame:
    """Rank-sum test of each label against the rest, per gene.

    Absent entries are one block of ties below all values, so only non-zero values are ranked; the
    ranking splits each gene into value ranges (`spread_rank`), which keeps common genes out of one task."""
    from tessera.functions.numeric import norm_sf
    from tessera.functions.ranks import bh_adjust, _ordered_values

    spots = ds.spots.filter("label IS NOT NULL").select("spot_id", "label")
    sizes = spots.groupBy("label").agg(F.count("*").cast("double").alias("n1"))
    total = spots.select(F.count("*").cast("double")).scalar()
    labels = sizes.agg(F.sort_array(F.collect_list(F.struct("label", "n1"))).alias("l")).scalar()
    x = ds.expr.filter(F.col(column) != 0).select("spot_id", "gene", F.round(column, 9).alias("_v")).join(spots, "spot_id")
    ordered = cut_lineage(_ordered_values(x, "_v", ["gene"]).select(
        "gene", "_v", "_ties", (F.col("_first") + (F.col("_ties") + 1) / 2).alias("_r")))
    tie = ordered.groupBy("gene").agg(
        F.sum(F.pow("_ties", F.lit(3)) - F.col("_ties")).alias("tie_sum"), F.sum("_ties").cast("double").alias("nnz"))
    per_label = x.groupBy("gene", "label", "_v").agg(F.count("*").alias("_c")).join(
        ordered.select("gene", "_v", "_r"), ["gene", "_v"]).groupBy("gene", "label").agg(
        F.sum(F.col("_c") * F.col("_r")).alias("rank_sum"), F.sum("_c").cast("double").alias("nnz1"),
        F.sum(F.col("_c") * F.col("_v")).alias("sum1"))
    whole = x.groupBy("gene").agg(F.sum("_v").alias("sum_all"))
    grid = ds.genes.select("gene", "gene_index", F.explode(labels).alias("_l")).select(
        "gene", "gene_index", F.col("_l.label").alias("label"), F.col("_l.n1").alias("n1"))
    g = grid.join(tie, "gene", "left").join(whole, "gene", "left").join(per_label, ["gene", "label"], "left").na.fill(
        0.0, ["tie_sum", "nnz", "sum_all", "rank_sum", "nnz1", "sum1"]).withColumn("nn", total)
    zeros, nn, n1 = F.col("nn") - F.col("nnz"), F.col("nn"), F.col("n1")
    ranks1 = F.col("rank_sum") + F.col("nnz1") * zeros + (n1 - F.col("nnz1")) * (zeros + 1) / 2
    correction = 1 - (F.col("tie_sum") + zeros * zeros * zeros - zeros) / (nn * nn * nn - nn)
    sd = F.sqrt(F.greatest(correction, F.lit(0.0)) * n1 * (nn - n1) * (nn + 1) / 12)
    mean1, mean2 = F.col("sum1") / n1, ratio(F.col("sum_all") - F.col("sum1"), nn - n1)
    g = g.withColumns({
        "z": F.coalesce(ratio(ranks1 - n1 * (nn + 1) / 2, sd), F.lit(0.0)),
        "logfc": F.log2((F.expm1(mean1) + 1e-9) / (F.expm1(mean2) + 1e-9))})
    g = bh_adjust(g.withColumn("p_value", 2 * norm_sf(F.abs("z"))), "p_value", ["label"])
    share = F.ceil(F.lit(n) / F.size(labels))
    kept = g.filter((F.col("q_value") <= max_q) & (F.col("logfc") > 0)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("logfc", 9)), "gene"))).withColumn(
        "share", F.greatest(share, F.lit(1))).filter(F.col("rank") <= F.col("share"))
    m = F.count("*").over(Window.partitionBy("label"))
    step = F.when(m > 1, (F.col("share") - 1) * (F.col("rank") - 1) / (m - 1)).otherwise(0.0)
    best = kept.withColumn("_s", F.col("share") - step).groupBy("gene").agg(F.max("_s").cast("double").alias("score"))
    return expand_scores(best, ds.genes)
