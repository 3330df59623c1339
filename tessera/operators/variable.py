"""Highly-variable-gene scores computed from zero-aware moments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import norm_sf, ratio
from tessera.functions.ranks import bh_adjust
from tessera.model import SpatialData
from tessera.operators.prepare import normalize_total
from tessera.operators.ranking import expand_scores, global_moments, slice_moments
from tessera.session import cut_lineage, spread

# fixed value: normal-consistency factor of the median absolute deviation
MAD_SCALE = 0.6744897501960817
SPANS = [0.3, 0.5, 0.75, 1.0]


SHARED_GENES = 100_000


def _of_genes(expr: DataFrame, keep: DataFrame) -> DataFrame:
    """Entries of the genes in a table whose lineage is cut. A list that was counted and is short goes to the entries, which then stay in place."""
    short = keep.count() <= SHARED_GENES
    return expr.join(F.broadcast(keep) if short else keep, "gene", "left_semi")


def _moments(ds: SpatialData, column: str, batch: bool) -> DataFrame:
    return slice_moments(ds, column) if batch else global_moments(ds, column)


def _combine(z: DataFrame, ds: SpatialData, batch: bool) -> DataFrame:
    """Mean of slice scores: a gene without counts in a slice scores 0 there, an undefined score is skipped."""
    if not batch:
        return expand_scores(z.select("gene", F.coalesce("z", F.lit(0.0)).alias("score")), ds.genes)
    k = ds.spots.agg(F.count_distinct("slice")).scalar()
    undefined = F.count_if(F.col("z").isNull())
    return expand_scores(z.groupBy("gene").agg(
        F.coalesce(ratio(F.sum("z"), k - undefined), F.lit(0.0)).alias("score")), ds.genes)


def hvg_seurat(ds: SpatialData, batch: bool = False, bins: int = 20) -> DataFrame:
    """Log dispersion of normalized counts, standardized in equal-width bins of log1p mean."""
    norm = ds.with_expr(normalize_total(ds.expr, entries=ds.entries))
    m = _moments(norm, "value", batch).withColumns({
        "lm": F.round(F.log1p("mean"), 12), "disp": F.when(F.col("var") > 0, F.log(F.col("var") / F.col("mean")))})
    s = Window.partitionBy("slice")
    width = F.max("lm").over(s) - F.min("lm").over(s)
    bin_ = F.greatest(F.lit(1), F.ceil(F.coalesce(ratio((F.col("lm") - F.min("lm").over(s)) * bins, width), F.lit(1.0))))
    b = Window.partitionBy("slice", "bin")
    m = m.withColumn("bin", bin_).withColumns({
        "mu": F.avg("disp").over(b), "sd": F.stddev_samp("disp").over(b), "n_bin": F.count("disp").over(b)})
    alone = F.col("n_bin") == 1
    z = F.when(alone, ratio("disp", "mu")).otherwise(ratio(F.col("disp") - F.col("mu"), "sd"))
    return _combine(m.withColumn("z", z), ds, batch)


def hvg_cell_ranger(ds: SpatialData, batch: bool = False, n: int = 2000, min_detected: int = 10, filter_needs: int = 1000) -> DataFrame:
    """Dispersion against the median and deviation of its percentile bin of the mean, after a
    low-count filter that applies only when `filter_needs` genes pass it, or all of a smaller table."""
    seen = cut_lineage(ds.expr.groupBy("gene").agg(F.sum("count").alias("t"), F.count_if(F.col("count") > 0).alias("d")))
    enough = seen.agg(F.count_if((F.col("t") > 0) & (F.col("d") > min_detected)).alias("k")).withColumn(
        "ok", F.col("k") >= F.least(F.lit(filter_needs), ds.genes.select(F.count("*")).scalar())).select("ok").scalar()
    keep = seen.filter(((F.col("t") > 0) & (F.col("d") > min_detected)) | ~enough).select("gene")
    # library sizes are those of the kept genes
    from tessera.operators.prepare import log1p

    kept = ds.with_expr(log1p(normalize_total(_of_genes(ds.expr, keep), entries=ds.entries)))
    m = _moments(kept, "value", batch).withColumns({
        "mean": F.round("mean", 12), "disp": F.when(F.col("var") > 0, F.col("var") / F.col("mean"))})
    # gene-level table: percentile buffers are bounded by the gene dictionary
    edges = m.groupBy("slice").agg(F.percentile("mean", [p / 100 for p in range(10, 101, 5)]).alias("edges"))
    m = m.join(edges, "slice").withColumn(
        "bin", F.size(F.filter("edges", lambda e: F.round(e, 12) < F.col("mean")))).drop("edges")
    med = m.groupBy("slice", "bin").agg(F.percentile("disp", 0.5).alias("med"))
    m = m.join(med, ["slice", "bin"])
    mad = m.groupBy("slice", "bin").agg((F.percentile(F.abs(F.col("disp") - F.col("med")), 0.5) / MAD_SCALE).alias("mad"))
    z = ratio(F.col("disp") - F.col("med"), "mad")
    return _combine(m.join(mad, ["slice", "bin"]).withColumn("z", z), ds, batch)


def _window_fits(xs: np.ndarray, ys: np.ndarray, q: int, own: slice, last: int) -> np.ndarray:
    """Tricube-weighted quadratic fits at xs[own], each over the q nearest of the ascending xs; NaN where singular.
    `last` is the greatest place where a window may start. Blocks of windows are fitted together."""
    at = np.arange(len(xs))[own]
    first = np.minimum(np.searchsorted(xs[:len(xs) - q] + xs[q:], 2 * xs[at]), last)
    fit = np.full(len(at), np.nan)
    step = max(1, 200_000 // q)
    for i in range(0, len(at), step):
        window = first[i:i + step, None] + np.arange(q)
        d, y = xs[window] - xs[at[i:i + step], None], ys[window]
        h = np.maximum(np.abs(d[:, 0]), np.abs(d[:, -1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(h[:, None] > 0, (1 - np.minimum(np.abs(d) / h[:, None], 1) ** 3) ** 3, 1.0)
        powers = [w]
        for _ in range(4):
            powers.append(powers[-1] * d)
        p = [v.sum(1) for v in powers]
        a = np.stack([np.stack(p[k:k + 3], 1) for k in range(3)], 1)
        r = np.stack([(v * y).sum(1) for v in powers[:3]], 1)
        full = np.linalg.matrix_rank(a) == 3
        fit[i:i + step][full] = np.linalg.solve(a[full], r[full][:, :, None])[:, 0, 0]
    return fit


def local_fit(df: DataFrame, x: str, y: str, span: float, by: str = "slice", rows_per_range: int = 256) -> DataFrame:
    """Local weighted quadratic regression of y on x over the genes of each slice; adds `fitted`.

    The genes of a slice are numbered by (x, gene) and cut into ranges. A range also receives the q genes before and
    behind it, q being the window size, since a window reaches no further; so a slice is fitted in as many tasks as it
    has ranges. Ranges are no shorter than a quarter of q, which bounds the copies of a gene by ten."""
    order = Window.partitionBy(by).orderBy(x, "gene")
    q = F.least(F.col("_n"), F.greatest(F.lit(3).cast("long"), F.floor(F.col("_n") * span + 1e-5)))
    placed = df.withColumn("_pos", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(by))).withColumn("_q", q)
    placed = placed.withColumn("_size", F.greatest(F.lit(rows_per_range).cast("long"), F.ceil(F.col("_q") / 4)))
    low = F.greatest(F.floor((F.col("_pos") - F.col("_q")) / F.col("_size")), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col("_pos") + F.col("_q")) / F.col("_size")), F.floor((F.col("_n") - 1) / F.col("_size")))
    dealt = placed.withColumn("_range", F.explode(F.sequence(low, high)))
    schema = T.StructType([*df.schema.fields, T.StructField("fitted", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        pos = pdf["_pos"].to_numpy()
        n, q, size, part = (int(pdf[c].iloc[0]) for c in ("_n", "_q", "_size", "_range"))
        own = slice(*np.searchsorted(pos, [part * size, (part + 1) * size]))
        fitted = _window_fits(pdf[x].to_numpy(float), pdf[y].to_numpy(float), q, own, n - q - int(pos[0]))
        return pdf.iloc[own].assign(fitted=fitted)[[f.name for f in schema.fields]]

    return dealt.groupBy(by, "_range").applyInPandas(fit, schema)


def _trend_points(ds: SpatialData, batch: bool) -> DataFrame:
    m = _moments(ds, "count", batch)
    return m.filter("var > 0").select("slice", "gene", "n_spots", "mean", F.round(F.log10("mean"), 12).alias("lm"), F.log10("var").alias("lv"))


def seurat_v3_variances(ds: SpatialData, batch: bool, span: float = 0.3, fit: DataFrame | None = None) -> DataFrame:
    """Variance of counts standardized by the fitted trend and clipped at sqrt(n), per slice and gene. A trend that is
    already fitted may be passed, which saves the pass over the entries for its moments."""
    fit = local_fit(_trend_points(ds, batch), "lm", "lv", span) if fit is None else fit
    fit = fit.withColumn("sd", F.sqrt(F.pow(F.lit(10.0), F.col("fitted"))))
    key = ["slice", "gene"] if batch else ["gene"]
    entries = ds.expr.select("slice", "gene", "count") if batch else ds.expr.select("gene", "count")
    side = fit.select(*key, "n_spots", "mean", "sd", "fitted") if batch else fit.select("gene", "n_spots", "mean", "sd", "fitted")
    n, mu, sd = F.col("n_spots").cast("double"), F.col("mean"), F.col("sd")
    c = F.least(F.col("count"), mu + sd * F.sqrt(n))
    sums = entries.join(side, key).groupBy(*key, "n_spots", "mean", "sd", "fitted").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    var = (n * mu * mu + F.col("q") - 2 * F.col("s") * mu) / ((n - 1) * sd * sd)
    out = sums.withColumn("norm_var", F.round(var, 9))
    return out if batch else out.withColumn("slice", F.lit("all"))


def rank_combine(variances: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    """Rank per slice, keep ranks below n, take the median over slices; score = max(rank) - rank."""
    w = Window.partitionBy("slice").orderBy(F.desc("norm_var"), "gene")
    ranked = variances.withColumn("r", F.row_number().over(w) - 1).filter(F.col("r") < n)
    med = ranked.groupBy("gene").agg(F.percentile("r", 0.5).alias("rank_median"), F.count("*").alias("n_slices"))
    top = med.agg(F.max("rank_median")).scalar()
    return expand_scores(med.select("gene", (top - F.col("rank_median")).alias("score")), genes)


def hvg_seurat_v3(ds: SpatialData, n: int = 2000, batch: bool = False, span: float = 0.3) -> DataFrame:
    return rank_combine(seurat_v3_variances(ds, batch, span), ds.genes, n)


def with_fallback(ds: SpatialData, n: int, spans: list[float] = SPANS) -> tuple[DataFrame, dict]:
    """Batch-aware ranking with the fallback ladder: larger spans, then fewer (smallest slices dropped,
    at least two kept), then one global fit. The mode used is returned.

    Slices are fitted apart, so the moments are taken once, all spans are fitted on them, and one flag per slice and
    span decides; the entries are then read once more, with the trend that was chosen."""
    points = cut_lineage(_trend_points(ds, True))
    fits = None
    for span in spans:
        one = local_fit(points, "lm", "lv", span).withColumn("span", F.lit(span))
        fits = one if fits is None else fits.unionByName(one)
    fits = cut_lineage(fits)
    # one row per slice and span
    bad = {(r["span"], r["slice"]) for r in fits.filter("fitted IS NULL OR isnan(fitted)").select("span", "slice").distinct().collect()}
    singular = {span: {s for p, s in bad if p == span} for span in spans}
    chosen, mode, excluded = next((span for span in spans if not singular[span]), None), "expanded_span", []
    if chosen is not None:
        mode = "none" if chosen == spans[0] else mode
    else:
        # slice sizes: one row per slice
        order = [r["slice"] for r in ds.slice_sizes().orderBy("n_spots", "slice").collect()]
        k = next((k for k in range(1, max(1, len(order) - 1)) if not singular[spans[0]] & set(order[k:])), None)
        if k is None:
            return hvg_seurat_v3(ds, n, False), {"mode": "global", "span": spans[0], "excluded": []}
        chosen, mode, excluded = spans[0], "exclude_small_slices", order[:k]
    fit = fits.filter(F.col("span") == chosen).drop("span")
    if excluded:
        fit = fit.filter(~F.col("slice").isin(excluded))
    return rank_combine(seurat_v3_variances(ds, True, chosen, fit), ds.genes, n), {"mode": mode, "span": chosen, "excluded": excluded}


def library_sums(genes: DataFrame, libraries: DataFrame, terms: dict[str, Callable[[np.ndarray, dict], np.ndarray]],
                 by: list[str], gene_pack: int = 256, lib_pack: int = 2048) -> DataFrame:
    """Sum of f(library size, gene) over all spots, for every gene.

    Spots of equal library size are counted first. Genes and sizes are then dealt by hash into packs, as many as the data
    need, and every gene pack meets every pack of sizes of its group as one dense tile; a task holds one tile, and partial
    sums are added per gene. `terms` take a row of sizes and the gene columns, as columns."""
    hist = libraries.groupBy(*by, "lib").agg(F.count("*").alias("n"))
    packs = max(1, -(-genes.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] // gene_pack) if not genes.isEmpty() else 1)
    chunks = max(1, -(-(hist.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0) // lib_pack))
    pack, chunk = F.pmod(F.xxhash64("gene"), F.lit(packs)).cast("int"), F.pmod(F.xxhash64("lib"), F.lit(chunks)).cast("int")
    tile = [*by, "_pack", "_chunk"]
    left = genes.withColumn("_pack", pack).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # fresh columns: both sides may come from the same entries
    right = hist.select(*[F.col(c).alias(c) for c in hist.columns]).withColumn("_chunk", chunk).withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    schema = ", ".join([*(f"{c} {genes.schema[c].dataType.simpleString()}" for c in by), "gene string", *(f"{k} double" for k in terms)])

    def work(g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if g.empty or h.empty:
            return pd.DataFrame(columns=[*by, "gene", *terms])
        sizes, n = h["lib"].to_numpy(float)[None, :], h["n"].to_numpy(float)
        params = {c: g[c].to_numpy()[:, None] for c in g.columns}
        return g[[*by, "gene"]].assign(**{k: f(sizes, params) @ n for k, f in terms.items()})

    met = spread(left, *tile).groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(work, schema)
    return met.groupBy(*by, "gene").agg(*[F.sum(k).alias(k) for k in terms])


def _libraries(ds: SpatialData, batch: bool) -> DataFrame:
    lib = ds.expr.groupBy("slice", "spot_id").agg(F.sum("count").alias("lib"))
    return lib if batch else lib.withColumn("slice", F.lit("all"))


def hvg_pearson(ds: SpatialData, theta: float = 100.0, batch: bool = False, n: int = 2000) -> DataFrame:
    """Variance of clipped Pearson residuals under a multiplicative null."""
    v = pearson_variances(ds, theta, batch)
    if not batch:
        return expand_scores(v.select("gene", F.col("norm_var").alias("score")), ds.genes)
    return rank_combine(v, ds.genes, n)


def pearson_variances(ds: SpatialData, theta: float = 100.0, batch: bool = False) -> DataFrame:
    lib = _libraries(ds, batch)
    entries = ds.expr.select("slice" if batch else F.lit("all").alias("slice"), "spot_id", "gene", "count")
    sizes = ds.slice_sizes() if batch else ds.spots.agg(F.count("*").alias("n_spots")).withColumn("slice", F.lit("all"))
    totals = lib.groupBy("slice").agg(F.sum("lib").alias("t")).join(sizes, "slice")
    g = entries.groupBy("slice", "gene").agg(F.sum("count").alias("s")).join(totals, "slice").select(
        "slice", "gene", (F.col("s") / F.col("t")).alias("p"), "n_spots")

    def zero(l: Column) -> Column:
        mu = F.col("p") * l
        return -F.least(F.sqrt(mu / (1.0 + mu / theta)), F.sqrt(F.col("n_spots").cast("double")))

    def zeros(l: np.ndarray, g: dict) -> np.ndarray:
        mu = g["p"] * l
        return -np.minimum(np.sqrt(mu / (1.0 + mu / theta)), np.sqrt(g["n_spots"].astype(float)))

    base = library_sums(g, lib, {"s1": zeros, "s2": lambda l, g: zeros(l, g) ** 2}, ["slice"])
    mu, root = F.col("p") * F.col("lib"), F.sqrt(F.col("n_spots").cast("double"))
    res = (F.col("count") - mu) / F.sqrt(mu + mu * mu / theta)
    res = F.greatest(F.least(res, root), -root)
    z = zero(F.col("lib"))
    delta = entries.join(lib, ["slice", "spot_id"]).join(g, ["slice", "gene"]).groupBy("slice", "gene", "n_spots").agg(
        F.sum(res - z).alias("d1"), F.sum(res * res - z * z).alias("d2"))
    m1, m2 = (F.col("s1") + F.col("d1")) / F.col("n_spots"), (F.col("s2") + F.col("d2")) / F.col("n_spots")
    return delta.join(base, ["slice", "gene"]).select("slice", "gene", F.round(m2 - m1 * m1, 9).alias("norm_var"))


def hvg_seurat_vst(ds: SpatialData, n: int = 2000) -> DataFrame:
    """The global standardized variance itself is the score."""
    v = seurat_v3_variances(ds, False)
    return expand_scores(v.select("gene", F.col("norm_var").alias("score")), ds.genes)


def hvg_seurat_disp(ds: SpatialData) -> DataFrame:
    return hvg_seurat(ds, False, 20)


def hvg_seurat_mvp(ds: SpatialData, mean_range: tuple[float, float] = (0.1, 8.0), min_z: float = 1.0) -> DataFrame:
    """Mean-variance plot: only genes inside the mean range with a scaled dispersion above the cut-off,
    so fewer genes than requested may come back."""
    norm = ds.with_expr(normalize_total(ds.expr, entries=ds.entries))
    mean = global_moments(norm).select("gene", F.log1p("mean").alias("lm"))
    return hvg_seurat(ds, False, 20).join(mean, "gene").filter(
        F.col("lm").between(*mean_range) & (F.col("score") > min_z)).drop("lm")


def brennecke(ds: SpatialData, n: int = 2000, filter_needs: int = 100) -> DataFrame:
    """Ratio of squared CV to a trend a0 + a1/mean, fitted with weights mean^2 so that both
    coefficients come from five sums. Genes in one spot only are left out if `filter_needs` others remain, or n if that is less."""
    seen = cut_lineage(ds.expr.groupBy("gene").agg(F.count_if(F.col("count") > 0).alias("d")))
    enough = seen.agg((F.count_if(F.col("d") > 1) >= min(filter_needs, n)).alias("ok")).scalar()
    keep = seen.filter((F.col("d") > 1) | ~enough).select("gene")
    kept = ds.with_expr(_of_genes(ds.expr, keep))
    mean_lib = kept.expr.agg(F.sum("count")).scalar() / ds.spots.select(F.count("*")).scalar()
    norm = kept.with_expr(normalize_total(kept.expr, 1.0, entries=ds.entries).withColumn("value", F.col("value") * mean_lib))
    m = global_moments(norm).filter("mean > 0 AND var > 0").withColumn("cv2", F.col("var") / (F.col("mean") * F.col("mean")))
    y = F.col("cv2") * F.col("mean")
    fit = m.agg(F.count("*").alias("k"), F.sum("mean").alias("sx"), F.sum(F.col("mean") * F.col("mean")).alias("sxx"),
                F.sum(y).alias("sy"), F.sum(y * F.col("mean")).alias("sxy"))
    a0 = ratio(F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx"))
    coef = fit.select(a0.alias("a0"), ((F.col("sy") - a0 * F.col("sx")) / F.col("k")).alias("a1"))
    trend = F.greatest(coef.select("a0").scalar() + coef.select("a1").scalar() / F.col("mean"), F.lit(1e-8))
    return expand_scores(m.select("gene", (F.col("cv2") / trend).alias("score")), ds.genes)


def deviance(ds: SpatialData) -> DataFrame:
    """Binomial deviance against a constant fraction. Spots without the gene add -2 n log(1 - p),
    a sum known from the totals."""
    lib = ds.expr.groupBy("spot_id").agg(F.sum("count").alias("lib"))
    total = lib.agg(F.sum("lib")).scalar()
    p = ds.expr.groupBy("gene").agg((F.sum("count") / total).alias("p"))
    y, l, q = F.col("count"), F.col("lib"), F.col("p")
    rest = F.when(l > y, (l - y) * F.log((l - y) / (l * (1 - q)))).otherwise(0.0)
    sums = ds.expr.join(lib, "spot_id").join(p, "gene").groupBy("gene", "p").agg(
        F.sum(y * F.log(y / (l * q)) + rest).alias("a"), F.sum("lib").alias("b"))
    score = 2 * (F.col("a") - (total - F.col("b")) * F.log(1 - F.col("p")))
    return expand_scores(sums.filter("p < 1").select("gene", score.alias("score")), ds.genes)


def bio_variance(ds: SpatialData, span: float = 0.3) -> DataFrame:
    """Variance of log2 normalized counts minus the fitted mean-variance trend of each slice, averaged
    over slices. Size factors are scaled to the slice with the lowest coverage."""
    lib = _libraries(ds, True)
    cover = lib.groupBy("slice").agg(F.sum("lib").alias("t")).join(ds.slice_sizes(), "slice").select(
        (F.col("t") / F.col("n_spots")).alias("c")).agg(F.min("c")).scalar()
    norm = normalize_total(ds.expr, 1.0, entries=ds.entries).withColumn("value", F.log2(F.col("value") * cover + 1.0))
    m = slice_moments(ds.with_expr(norm)).filter("var > 0").select("slice", "gene", F.round("mean", 12).alias("mean"), "var")
    bio = local_fit(m, "mean", "var", span).withColumn("bio", F.nanvl(F.col("var") - F.col("fitted"), F.lit(0.0)))
    k = ds.spots.agg(F.count_distinct("slice")).scalar()
    return expand_scores(bio.groupBy("gene").agg((F.sum("bio") / k).alias("score")), ds.genes)


def dropout_excess(ds: SpatialData) -> DataFrame:
    """Observed against expected zeros under a depth-adjusted negative binomial whose size follows the
    mean by a log-log line; -log10 of the Benjamini-Hochberg value of a one-sided normal test."""
    lib = _libraries(ds, False)
    n = ds.spots.select(F.count("*").cast("double")).scalar()
    t, l2 = lib.agg(F.sum("lib")).scalar(), lib.agg(F.sum(F.col("lib") * F.col("lib"))).scalar()
    g = ds.expr.join(lib.select("spot_id", "lib"), "spot_id").groupBy("gene").agg(
        F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"),
        F.sum(F.col("count") * F.col("lib")).alias("x"), F.count("*").alias("nnz"))
    p = F.col("s") / t
    g = g.withColumns({"slice": F.lit("all"), "p": p, "n": n, "rss": F.col("q") - 2 * p * F.col("x") + p * p * l2})
    size = ratio(F.col("s") * F.col("s") * l2 / (t * t), F.col("rss") - F.col("s"))
    g = g.withColumn("size_raw", size)
    cap = 10 * g.agg(F.max("size_raw")).scalar()
    g = g.withColumn("size", F.greatest(F.when(F.col("size_raw") > 0, F.col("size_raw")).otherwise(cap), F.lit(1e-10)))
    lx, ly = F.log(F.col("s") / F.col("n")), F.log("size")
    line = g.filter("size_raw > 0").agg(F.regr_slope(ly, lx).alias("b"), F.regr_intercept(ly, lx).alias("a"))
    g = g.withColumn("r", F.exp(line.select("a").scalar() + line.select("b").scalar() * lx))

    def p0(l: np.ndarray, g: dict) -> np.ndarray:
        return np.exp(-g["r"] * np.log1p(g["p"] * l / g["r"]))

    e = library_sums(g.select("slice", "gene", "p", "r"), lib, {"e0": p0, "v0": lambda l, g: p0(l, g) * (1 - p0(l, g))}, ["slice"])
    g = g.join(e, ["slice", "gene"])
    empty = n - lib.select(F.count("*")).scalar()  # spots without counts are zeros of every gene
    z = ratio((F.col("n") - F.col("nnz")) - (F.col("e0") + empty), F.sqrt("v0"))
    q = bh_adjust(g.withColumn("p_value", norm_sf(F.coalesce(z, F.lit(0.0)))), "p_value", ["slice"])
    return expand_scores(q.select("gene", (-F.log10(F.greatest("q_value", F.lit(1e-300))) + F.lit(0.0)).alias("score")), ds.genes)
