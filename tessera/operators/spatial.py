"""Gene rankings that use a graph or coordinates: autocorrelation, kernels, localization, anti-correlation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import hash_order, hash_uniform, norm_sf, ratio, sq_dist
from tessera.functions.ranks import bh_adjust, exact_quantiles, spread_rank
from tessera.model import SpatialData
from tessera.operators.blocks import edge_sums, neighbour_sum_counts, owned_pairs, spot_blocks
from tessera.operators.embed import gene_order
from tessera.operators.graph import knn_join
from tessera.operators.matrices import correlation_tiles, low_counts, packed, partners_below
from tessera.operators.prepare import is_mito
from tessera.operators.ranking import candidate_genes, expand_scores, slice_percentile_mean
from tessera.session import cut_lineage


def morans_i_scores(ds: SpatialData, k: int = 8, column: str = "value", edges: DataFrame | None = None) -> DataFrame:
    """Moran's I per slice and gene on the symmetric kNN graph with binary weights.

    With sparse values, sum w z_i z_j = sum w x_i x_j - 2 mu sum d_i x_i + mu^2 W, so only non-zero
    entries take part. Constant genes have no score (they rank as minus infinity)."""
    pairs = cut_lineage(owned_pairs(knn_join(ds.spots, k) if edges is None else edges, ["slice"]))
    degree = pairs.select("slice", F.explode(F.array("src", "dst")).alias("spot_id")).groupBy("slice", "spot_id").agg(
        F.count("*").alias("w"))
    sizes = ds.slice_sizes().join(degree.groupBy("slice").agg(F.sum("w").alias("w")), "slice")
    m = edge_sums(ds.expr, ds.genes, degree, pairs, spot_blocks(ds.spots), column, ["slice"]).withColumnRenamed("wx", "dx").join(sizes, "slice")
    n, w = F.col("n_spots"), F.col("w")
    mu = F.col("s") / n
    den = F.col("q") - n * mu * mu
    num = 2 * F.col("cross") - 2 * mu * F.col("dx") + mu * mu * w
    ok = (n >= 3) & (w > 0) & (den > 1e-12)
    return m.select("slice", "gene", "n_spots", F.when(ok, (n / w) * ratio(num, den)).alias("score"))


def morans_i(ds: SpatialData, k: int = 8, column: str = "value", missing: str = "zero", edges: DataFrame | None = None) -> DataFrame:
    """Mean within-slice percentile of Moran's I over slices with at least three spots."""
    used = ds.slice_sizes().filter("n_spots >= 3").select(F.count("*")).scalar()
    return slice_percentile_mean(morans_i_scores(ds, k, column, edges), ds.genes, used, missing)


def coordinate_kernels(spots: DataFrame) -> DataFrame:
    """(slice, spot_id, kernels): eleven (name, kx, ky) structs per spot: centred coordinates, and Gaussian
    and cosine transforms of them at five quantile scales of their absolute values."""
    means = spots.groupBy("slice").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    c = spots.join(means, "slice").select("slice", "spot_id", (F.col("x") - F.col("_mx")).alias("_x"), (F.col("y") - F.col("_my")).alias("_y"))
    # both axes in one pass of the quantile operator
    axes = c.select("slice", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.abs("_x").alias("a")),
                                               F.struct(F.lit("y").alias("axis"), F.abs("_y").alias("a")))).alias("e")).select("slice", "e.axis", "e.a")
    q = exact_quantiles(axes, "a", ["slice", "axis"], {f"q{i}": i / 5 for i in range(1, 6)})
    scales = q.groupBy("slice").pivot("axis", ["x", "y"]).agg(F.first(F.array(*[f"q{i}" for i in range(1, 6)])))
    c = c.join(scales.withColumnsRenamed({"x": "_lx", "y": "_ly"}), "slice")

    def at(kind: str, axis: str, i: Column) -> Column:
        v, l = F.col(f"_{axis}"), F.get(f"_l{axis}", i)
        return F.exp(-ratio(v * v, 2 * l * l)) if kind == "g" else F.cos(ratio(2 * math.pi * v, l))

    def family(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
            F.concat(F.lit(kind), i.cast("string")).alias("name"), at(kind, "x", i).alias("kx"), at(kind, "y", i).alias("ky")))

    raw = F.array(F.struct(F.lit("raw").alias("name"), F.col("_x").alias("kx"), F.col("_y").alias("ky")))
    return c.select("slice", "spot_id", F.concat(raw, family("g"), family("c")).alias("kernels"))


def kernel_projection_test(ds: SpatialData, column: str = "count", max_genes: int | None = None,
                           min_spots: int = 10) -> DataFrame:
    """Covariance test per slice and gene, for eleven kernels of the coordinates.

    With X the centred kernel columns (n x 2) the statistic is S = n y'X (X'X)^-1 X'y / y'y. Under the null it is a mixture
    of chi-squares whose weights are the eigenvalues of X'X (X'X)^-1, which are all one, times l = y'Hy / y'y, H being the
    centring. The mixture is thus l times a chi-square of two degrees of freedom, moment matching is exact, and
    p = exp(-S / 2l) = exp(-n R^2 / 2) with R^2 of the regression on X. The p-values are combined by the Cauchy rule.
    Mitochondrial genes are left out. Non-zero entries meet the kernels of their spot and are summed per gene and kernel
    before any shuffle of products."""
    kernels = cut_lineage(coordinate_kernels(ds.spots))
    k = kernels.select("slice", F.explode("kernels").alias("k")).select("slice", "k.name", "k.kx", "k.ky")
    stats = k.groupBy("slice", "name").agg(
        F.count("*").cast("double").alias("n"), F.sum("kx").alias("sx"), F.sum("ky").alias("sk"),
        F.sum(F.col("kx") * F.col("kx")).alias("qx"), F.sum(F.col("ky") * F.col("ky")).alias("qk"),
        F.sum(F.col("kx") * F.col("ky")).alias("m")).filter(F.col("n") >= min_spots)
    expr = ds.expr.filter(~is_mito())
    if max_genes is not None:
        keep = candidate_genes(ds.with_expr(expr), max_genes, min_spots, column).select("slice", "gene")
        expr = expr.join(keep, ["slice", "gene"], "left_semi")
    y = F.col("_y")
    met = expr.select("slice", "spot_id", "gene", F.col(column).alias("_y")).join(kernels, ["slice", "spot_id"])
    dots = met.select("slice", "gene", "_y", F.explode("kernels").alias("k")).groupBy("slice", "gene", F.col("k.name").alias("name")).agg(
        F.sum(y).alias("sy"), F.sum(y * y).alias("qy"), F.sum(y * F.col("k.kx")).alias("dx"), F.sum(y * F.col("k.ky")).alias("dk")).join(stats, ["slice", "name"])
    n = F.col("n")
    aa, bb, ab = F.col("qx") - F.col("sx") * F.col("sx") / n, F.col("qk") - F.col("sk") * F.col("sk") / n, F.col("m") - F.col("sx") * F.col("sk") / n
    da, db = F.col("dx") - F.col("sy") * F.col("sx") / n, F.col("dk") - F.col("sy") * F.col("sk") / n
    c = dots.select("slice", "gene", "n", aa.alias("aa"), bb.alias("bb"), ab.alias("ab"), da.alias("da"), db.alias("db"),
                    (F.col("qy") - F.col("sy") * F.col("sy") / n).alias("zz")).withColumn("det", F.expr("aa * bb - ab * ab"))
    top = F.expr("bb * da * da - 2 * ab * da * db + aa * db * db")
    stat = n * ratio(top, F.when((F.col("det") > 1e-9) & (F.col("zz") > 1e-12), F.col("det") * F.col("zz")))
    p = F.greatest(F.least(F.exp(-F.coalesce(stat, F.lit(0.0)) / 2), F.lit(1 - 1e-9)), F.lit(1e-300))
    term = F.when(F.col("p") < 1e-8, 1.0 / (F.col("p") * math.pi)).otherwise(F.tan((0.5 - F.col("p")) * math.pi))
    t = c.withColumn("p", p).groupBy("slice", "gene").agg(F.avg(term).alias("t"))
    return t.select("slice", "gene", F.when(F.col("t") > 1e8, 1.0 / (F.col("t") * math.pi)).otherwise(
        0.5 - F.atan("t") / math.pi).alias("p_value"))


def kernel_ranking(ds: SpatialData, column: str = "count", max_genes: int | None = None) -> DataFrame:
    tests = kernel_projection_test(ds, column, max_genes).withColumn(
        "score", -F.log10(F.greatest("p_value", F.lit(2.2250738585072014e-308))))
    used = ds.slice_sizes().filter("n_spots >= 10").select(F.count("*")).scalar()
    return slice_percentile_mean(tests, ds.genes, used)


def local_autocorrelation(ds: SpatialData, edges: DataFrame, max_q: float = 0.05) -> DataFrame:
    """Autocorrelation of depth-adjusted counts on a graph: z = (c - p l) / sqrt(p l) with library size l.

    The product sum over edges splits into a part over non-zero entries, a part with one weight per spot
    and a constant, so zeros never become rows. Genes above the FDR limit score 0."""
    lib = ds.expr.groupBy("spot_id").agg(F.sum("count").alias("lib"))
    pairs = owned_pairs(edges, []).join(lib.select(F.col("spot_id").alias("src"), F.sqrt("lib").alias("_ra")), "src").join(
        lib.select(F.col("spot_id").alias("dst"), F.sqrt("lib").alias("_rb")), "dst")
    pairs = cut_lineage(pairs)
    total = lib.agg(F.sum("lib")).scalar()
    graph = pairs.agg(F.count("*").cast("double").alias("e"), F.sum(F.col("_ra") * F.col("_rb")).alias("c"))
    weight = pairs.select(F.explode(F.array(
        F.struct(F.col("src").alias("spot_id"), F.col("_rb").alias("v")),
        F.struct(F.col("dst").alias("spot_id"), F.col("_ra").alias("v")))).alias("w")).groupBy(F.col("w.spot_id").alias("spot_id")).agg(F.sum("w.v").alias("w"))
    scaled = ds.expr.join(lib, "spot_id").withColumn("_s", F.col("count") / F.sqrt("lib"))
    counted = ds.expr.groupBy("gene").agg(F.sum("count").alias("n_count"))
    sums = edge_sums(scaled, ds.genes, weight, pairs.select("src", "dst"), spot_blocks(ds.spots), "_s", [])
    single = sums.drop("s").join(counted.withColumnRenamed("n_count", "s"), "gene").withColumnRenamed("wx", "dx")
    n = ds.spots.select(F.count("*")).scalar()
    p = F.col("s") / total
    h = F.col("cross") / p - F.col("dx") + p * graph.select("c").scalar()
    var = (F.col("q") / p - F.col("s")) / n
    z = ratio(h, F.when(var > 1e-12, var) * F.sqrt(graph.select("e").scalar()))
    t = single.select("gene", F.lit("all").alias("slice"), F.coalesce(z, F.lit(0.0)).alias("z"))
    t = bh_adjust(t.withColumn("p_value", norm_sf("z")), "p_value", ["slice"])
    return expand_scores(t.select("gene", F.when(F.col("q_value") < max_q, F.col("z")).otherwise(0.0).alias("score")), ds.genes)


def _shuffled(spots: DataFrame, seed: int) -> DataFrame:
    """A permutation of the spots: the r-th by one hash takes the place of the r-th by another."""
    keyed = spots.select("spot_id", hash_uniform(seed, "spot_id").alias("_u"), F.lit(1).alias("_all"))
    by_hash = spread_rank(keyed, "_u", ["_all"], "_r").select(F.col("spot_id").alias("_to"), F.round(F.col("_r") * 2).alias("_r"))
    numeric = keyed.withColumn("_id", hash_uniform("id", "spot_id"))
    by_id = spread_rank(numeric, "_id", ["_all"], "_r").select(F.col("spot_id").alias("_from"), F.round(F.col("_r") * 2).alias("_r"))
    return by_id.join(by_hash, "_r").select("_from", "_to")


def knn_localization(ds: SpatialData, edges: DataFrame, seed: int = 0, column: str = "count") -> DataFrame:
    """Distance between the distribution of neighbour sums of a gene and the same sums after the
    neighbours are permuted: the area between the two cumulative curves."""
    perm = _shuffled(ds.spots, seed).select(F.col("_from").alias("from"), F.col("_to").alias("to"))
    edges = cut_lineage(edges.select("src", "dst"))
    n = edges.agg(F.count_distinct("src").cast("double")).scalar()
    # counted per distinct sum before any window, so common genes stay small
    both = cut_lineage(neighbour_sum_counts(ds.expr, ds.genes, edges, spot_blocks(ds.spots), perm, column).select("gene", F.col("s").alias("_s"), F.col("c").alias("_c")))
    zero = both.groupBy("gene").agg((-F.sum("_c")).alias("_c")).select("gene", F.lit(0.0).alias("_s"), "_c")
    steps = both.unionByName(zero).groupBy("gene", "_s").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy("gene").orderBy("_s")
    area = F.abs(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))) * (F.lead("_s").over(w) - F.col("_s"))
    return expand_scores(steps.withColumn("_a", area).groupBy("gene").agg(
        (F.coalesce(F.sum("_a"), F.lit(0.0)) / n).alias("score")), ds.genes)


def grid_kl(ds: SpatialData, emb: DataFrame, points: int = 25, column: str = "value", seed: int = 0) -> DataFrame:
    """Divergence between the density of spots that detect a gene and of all spots, over a few reference
    points (a hash sample of spots, at most `points`), with Gaussian weights."""
    refs = emb.orderBy(hash_order(seed, "spot_id"), "spot_id").limit(points).agg(
        F.sort_array(F.collect_list(F.struct(F.col("spot_id").alias("id"), F.col("emb").alias("e")))).alias("r"))
    # one array of at most `points` vectors, as a scalar
    d = emb.select("spot_id", "emb").withColumn("_r", refs.scalar()).withColumn(
        "_d", F.transform("_r", lambda r: sq_dist(F.col("emb"), r["e"]))).drop("_r")
    d = d.withColumn("_near", F.sqrt(F.array_min(F.transform("_d", lambda v: F.when(v > 0, v)))))
    d = d.withColumn("_width", exact_quantiles(d, "_near", [], {"w": 0.5}).scalar())
    weights = d.select("spot_id", F.transform("_d", lambda v: F.exp(-v / (2 * F.col("_width") * F.col("_width")))).alias("_w"))
    cols = [F.coalesce(F.get("_w", F.lit(i)), F.lit(0.0)).alias(f"w{i}") for i in range(points)]
    weights = weights.select("spot_id", *cols)
    names = [f"w{i}" for i in range(points)]
    whole = weights.agg(F.array(*[F.sum(c) for c in names]).alias("q")).select(
        F.transform("q", lambda v: v / F.aggregate("q", F.lit(0.0), lambda a, b: a + b)).alias("q")).scalar()
    hit = ds.expr.filter(F.col(column) > 0).select("spot_id", "gene").join(weights, "spot_id").groupBy("gene").agg(
        F.array(*[F.sum(c) for c in names]).alias("p")).withColumn(
        "p", F.transform("p", lambda v: v / F.aggregate("p", F.lit(0.0), lambda a, b: a + b))).withColumn("q", whole)
    kl = F.aggregate(F.zip_with("p", "q", lambda p, q: F.when((p > 0) & (q > 0), p * F.log(p / q)).otherwise(0.0)),
                     F.lit(0.0), lambda a, b: a + b)
    return expand_scores(hit.select("gene", kl.alias("score")), ds.genes)


def anticorrelation(ds: SpatialData, fpr: float = 0.001, seed: int = 0, column: str = "value") -> DataFrame:
    """-log10 FDR of having negatively correlated partners, over all genes.

    The null correlations come from the same genes after each gene's values are rotated over the spots by its own hashed
    offset. Partners below the null quantile `fpr` are compared with their expected number. Correlations are held to
    millionths, so the quantile comes from exact counts per value; partners are counted inside tiles of genes."""
    order = gene_order(ds.genes)
    n, size = ds.spots.count(), ds.genes.count()
    entries = ds.expr.select("spot_id", "gene", F.col(column).alias("value"))
    # one row per gene
    sums = np.zeros((2, size))
    for r in entries.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(order, "gene").toLocalIterator():
        sums[:, r["_p"]] = r["s"], r["q"]
    index = spread_rank(ds.spots.select("spot_id", F.lit(1).alias("_all"), hash_uniform(seed, "spot_id").alias("_u")),
                        "_u", ["_all"], "_r").select("spot_id", F.floor(F.col("_r") - 1).alias("_k"))
    moved = entries.join(index, "spot_id").select(
        F.pmod(F.col("_k") + F.floor(hash_uniform(seed + 1, "gene") * n), n).alias("spot_id"), "gene", "value")
    real, null = (correlation_tiles(packed(e, order, ["spot_id"], "value"), size, n, *sums) for e in (entries, moved))
    upto = Window.orderBy("r")  # at most a million and one values
    below = low_counts(null).withColumn("_upto", F.sum("c").over(upto)).withColumn("_all", F.sum("c").over(Window.partitionBy()))
    cut = below.filter(F.col("_upto") >= F.lit(fpr) * F.col("_all")).agg(F.min("r")).first()[0] or 0
    seen = order.join(partners_below(real, cut), "_p", "left").na.fill(0, ["hits"])
    fdr = F.least(F.lit(1.0), F.lit(fpr) * (size - 1) / F.greatest("hits", F.lit(1)))
    return expand_scores(seen.select("gene", (-F.log10(fdr) + F.lit(0.0)).alias("score")), ds.genes)
