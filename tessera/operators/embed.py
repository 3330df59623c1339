"""Linear embeddings and batch correction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.checks import assert_empty
from tessera.functions.numeric import hash_order, ratio
from tessera.model import SpatialData
from tessera.operators.matrices import components, packed, projected
from tessera.operators.prepare import log1p, normalize_total
from tessera.session import cut_lineage


def gene_order(genes: DataFrame) -> DataFrame:
    """Position of each selected gene (a selection is bounded, so one window over it is small)."""
    return genes.select("gene", (F.row_number().over(Window.orderBy("gene_index")) - 1).alias("_p"))


def pca_embed(ds: SpatialData, features: DataFrame | None = None, n_comp: int = 50, column: str = "value",
              zeros: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Centred PCA: (spot_id, label, slice, emb) and explained variance ratios. The sign of a component makes its largest
    loading positive. Absent entries are 0, or the given per-slice value zeros(slice, gene, zero_value): then the rows
    are packed as differences to it, and the slice's values are one vector."""
    genes = ds.genes if features is None else ds.genes.join(features.select("gene"), "gene", "left_semi")
    order = cut_lineage(gene_order(genes))
    size = order.count()
    n = {r["slice"]: r["n_spots"] for r in ds.slice_sizes().collect()}  # one row per slice
    total = sum(n.values())
    offsets = {s: np.zeros(size) for s in n}
    entries = ds.expr.select("slice", "spot_id", "gene", F.col(column).alias("_v"))
    if zeros is not None:
        for r in zeros.join(order, "gene").select("slice", "_p", "zero_value").toLocalIterator():
            if r["slice"] in offsets:
                offsets[r["slice"]][r["_p"]] = r["zero_value"]
        entries = entries.join(zeros, ["slice", "gene"], "left").withColumn("_v", F.col("_v") - F.coalesce("zero_value", F.lit(0.0)))
    rows = cut_lineage(ds.spots.select("slice", "spot_id").join(packed(entries, order, ["spot_id"], "_v"), "spot_id", "left"))
    sums = {s: np.zeros((2, size)) for s in n}  # one row per slice and gene
    for r in entries.join(order, "gene").groupBy("slice", "_p").agg(F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("q")).toLocalIterator():
        sums[r["slice"]][:, r["_p"]] = r["s"], r["q"]
    mean = sum(n[s] * offsets[s] + sums[s][0] for s in n) / max(total, 1)
    variance = sum(float((sums[s][1] + 2 * (o := offsets[s] - mean) * sums[s][0] + n[s] * o * o).sum()) for s in n)
    centred = {s: offsets[s] - mean for s in n}
    v, theta = components(rows, centred, size, max(1, min(n_comp, size, total - 1)))
    out = projected(rows, centred, v)
    return ds.spots.select("spot_id", "label").join(out, "spot_id"), [float(t / variance) if variance > 0 else 0.0 for t in theta]


def svd_embed(ds: SpatialData, features: DataFrame, n_comp: int = 30) -> DataFrame:
    """Uncentred SVD of log-normalized selected counts; the library size is that of the selected genes."""
    order = cut_lineage(gene_order(ds.genes.join(features.select("gene"), "gene", "left_semi")))
    size = order.count()
    expr = ds.expr.join(order.select("gene"), "gene", "left_semi")
    lib = expr.groupBy("spot_id").agg(F.greatest(F.sum("count"), F.lit(1.0)).alias("_t"))
    entries = expr.join(lib, "spot_id").select("spot_id", "gene", F.log1p(F.col("count") * 1e4 / F.col("_t")).alias("_v"))
    rows = cut_lineage(ds.spots.select("slice", "spot_id").join(packed(entries, order, ["spot_id"], "_v"), "spot_id", "left"))
    nothing = {r["slice"]: np.zeros(size) for r in ds.slice_sizes().collect()}
    v, _ = components(rows, nothing, size, max(1, min(n_comp, ds.spots.count() - 1, size - 1)))
    return ds.spots.select("spot_id", "label").join(projected(rows, nothing, v), "spot_id")


def combat(ds: SpatialData, column: str = "value", rounds: int = 30) -> tuple[DataFrame, DataFrame]:
    """Empirical-Bayes location and scale correction per slice and gene.

    Returns (entries with `adjusted`, maps(slice, gene, scale, zero_value)); an absent entry becomes its zero_value. Everything is a function of the
    zero-aware moments of each (slice, gene), so the matrix is read once for moments and once to apply an
    affine map; the fixed-point rounds run inside one expression per (slice, gene)."""
    sizes = ds.slice_sizes()
    n = ds.spots.select(F.count("*").cast("double")).scalar()
    slices = sizes.agg(F.sort_array(F.collect_list(F.struct("slice", "n_spots"))).alias("s")).scalar()
    grid = ds.genes.select("gene", F.explode(slices).alias("_s")).select("gene", "_s.slice", F.col("_s.n_spots").cast("double").alias("nb"))
    v = F.col(column)
    sums = ds.expr.groupBy("slice", "gene").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    g = grid.join(sums, ["slice", "gene"], "left").na.fill(0.0, ["s", "q"]).withColumn("n", n)
    g = g.withColumn("ss", F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("nb"), F.lit(0.0)))
    by_gene = Window.partitionBy("gene")
    g = g.withColumns({"grand": F.sum("s").over(by_gene) / F.col("n"), "sd": F.sqrt(F.sum("ss").over(by_gene) / F.col("n"))})
    g = g.filter("sd > 1e-12").withColumns({
        "g_hat": (F.col("s") / F.col("nb") - F.col("grand")) / F.col("sd"),
        "d_hat": F.greatest(ratio("ss", (F.col("nb") - 1) * F.col("sd") * F.col("sd")), F.lit(1e-6))})
    prior = g.groupBy("slice").agg(F.avg("g_hat").alias("g_bar"), F.var_samp("g_hat").alias("t2"),
                                   F.avg("d_hat").alias("dm"), F.var_samp("d_hat").alias("dv"))
    a = (2 * F.col("dv") + F.col("dm") * F.col("dm")) / F.col("dv")
    b = (F.col("dm") * F.col("dv") + F.col("dm") * F.col("dm") * F.col("dm")) / F.col("dv")
    g = g.join(prior.select("slice", "g_bar", "t2", a.alias("a"), b.alias("b")), "slice")
    nb, gh, dh = F.col("nb"), F.col("g_hat"), F.col("d_hat")

    def step(acc: Column, _: Column) -> Column:
        new_g = (F.col("t2") * nb * gh + acc["d"] * F.col("g_bar")) / (F.col("t2") * nb + acc["d"])
        sum2 = dh * (nb - 1) + nb * (gh - new_g) * (gh - new_g)
        return F.struct(new_g.alias("g"), ((0.5 * sum2 + F.col("b")) / (nb / 2 + F.col("a") - 1)).alias("d"))

    star = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(gh.alias("g"), dh.alias("d")), step)
    g = g.withColumn("_star", star).withColumn("scale", 1 / F.sqrt("_star.d"))
    # x -> sd * ((x - grand) / sd - gamma) / sqrt(delta) + grand
    shift = F.col("grand") - F.col("grand") * F.col("scale") - F.col("sd") * F.col("_star.g") * F.col("scale")
    maps = g.select("slice", "gene", "scale", shift.alias("zero_value"))
    entries = ds.expr.join(maps, ["slice", "gene"], "left").withColumn(
        "adjusted", F.coalesce(v * F.col("scale") + F.col("zero_value"), v)).drop("scale", "zero_value")
    return entries, maps


def combat_pca(ds: SpatialData, features: DataFrame, n_comp: int = 50) -> tuple[DataFrame, list[float]]:
    entries, maps = combat(ds)
    return pca_embed(ds.with_expr(entries), features, n_comp, "adjusted", maps.select("slice", "gene", "zero_value"))


def scale_pca(ds: SpatialData, features: DataFrame, n_comp: int = 30) -> DataFrame:
    """PCA of z-scaled values clipped at 10. Absent entries carry the scaled zero of their gene."""
    from tessera.operators.prepare import scale

    kept = SpatialData(ds.spots, ds.genes, ds.expr.join(features.select("gene"), "gene", "left_semi"), ds.pairs)
    entries, params = scale(kept)
    slices = ds.spots.agg(F.collect_set("slice")).scalar()
    zeros = params.select("gene", F.col("zero_scaled").alias("zero_value"), F.explode(slices).alias("slice"))
    return pca_embed(kept.with_expr(entries), features, n_comp, "scaled", zeros)[0]


def harmony(emb: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0,
            rounds: int = 5, inner: int = 3, seed: int = 0) -> DataFrame:
    """Soft k-means with a diversity penalty over slices, then a ridge shift per cluster and slice.

    Only sums per (cluster, slice) leave the tasks: clusters x slices x dimensions numbers, whatever the
    number of spots. The corrected embedding is checkpointed after each round."""
    n = emb.count()
    k = clusters or max(2, min(100, round(n / 30)))
    slices = sorted(r["slice"] for r in emb.select("slice").distinct().collect())
    share = {r["slice"]: r["count"] / n for r in emb.groupBy("slice").count().collect()}
    pr = np.array([share[s] for s in slices])
    code = {s: i for i, s in enumerate(slices)}
    start = [r["emb"] for r in emb.select("emb", hash_order(seed, "spot_id").alias("_h")).orderBy("_h").limit(k).collect()]
    y = np.array(start, dtype=float)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    current = emb.select("spot_id", "slice", "emb", F.col("emb").alias("_z"))
    penalty = np.ones((k, len(slices)))
    d = y.shape[1]

    def soft(frame: pd.DataFrame, y: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.stack(frame["_z"].to_numpy())
        unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        b = frame["slice"].map(code).to_numpy()
        dist = 2 * (1 - unit @ y.T)
        r = np.exp(-(dist - dist.min(axis=1, keepdims=True)) / sigma) * penalty[:, b].T
        return r / r.sum(axis=1, keepdims=True), unit, b

    def sums(df: DataFrame, y: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = None
            for f in frames:
                if not len(f):
                    continue
                r, unit, b = soft(f, y, penalty)
                raw = np.stack(f["emb"].to_numpy())
                one = np.zeros((k, len(slices), 1 + 2 * d))
                for s in np.unique(b):
                    m = b == s
                    one[:, s, 0] = r[m].sum(0)
                    one[:, s, 1:1 + d] = r[m].T @ unit[m]
                    one[:, s, 1 + d:] = r[m].T @ raw[m]
                acc = one if acc is None else acc + one
            if acc is not None:
                flat = acc.reshape(-1)
                yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        total = np.zeros(k * len(slices) * (1 + 2 * d))
        for row in df.mapInPandas(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[row["i"]] = row["v"]
        t = total.reshape(k, len(slices), 1 + 2 * d)
        return t[:, :, 0], t[:, :, 1:1 + d], t[:, :, 1 + d:]

    for _ in range(rounds):
        for _ in range(inner):
            o, s_unit, _raw = sums(current, y, penalty)
            expected = o.sum(axis=1, keepdims=True) * pr[None, :]
            penalty = ((expected + 1) / (o + 1)) ** theta
            y = s_unit.sum(axis=1)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        o, _unit, s_raw = sums(current, y, penalty)
        shift = np.zeros((k, len(slices), d))
        for c in range(k):
            # ridge on the slice terms of a design with an intercept
            m = np.zeros((1 + len(slices), 1 + len(slices)))
            m[0, 0] = o[c].sum()
            m[0, 1:] = m[1:, 0] = o[c]
            m[1:, 1:] = np.diag(o[c] + ridge)
            rhs = np.vstack([s_raw[c].sum(0), s_raw[c]])
            shift[c] = np.linalg.lstsq(m, rhs, rcond=None)[0][1:]
        frozen_y, frozen_p = y.copy(), penalty.copy()

        def correct(frames: Iterator[pd.DataFrame], y=frozen_y, p=frozen_p, w=shift) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    r, _u, b = soft(f, y, p)
                    z = np.stack(f["emb"].to_numpy())
                    f = f.assign(_z=list(z - np.einsum("nk,nkd->nd", r, w[:, b].transpose(1, 0, 2))))
                yield f

        current = cut_lineage(current.mapInPandas(correct, current.schema))
    return emb.drop("emb").join(current.select("spot_id", F.col("_z").alias("emb")), "spot_id")


def slice_embedding(emb: DataFrame) -> DataFrame:
    """Mean vector per slice."""
    long = emb.select("slice", F.posexplode("emb").alias("pos", "v")).groupBy("slice", "pos").agg(F.avg("v").alias("m"))
    return long.groupBy("slice").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("emb"))


def align_embedding(emb: DataFrame, spots: DataFrame, check: bool = True) -> DataFrame:
    """Re-key an embedding to the input spots; a spot without a vector is an error."""
    if check:
        assert_empty(spots.join(emb, "spot_id", "left_anti").select("spot_id"), "spot without an embedding")
    return spots.join(emb.select("spot_id", "emb"), "spot_id", "left")


def normalized(ds: SpatialData) -> SpatialData:
    return ds.with_expr(log1p(normalize_total(ds.expr, entries=ds.entries)))
