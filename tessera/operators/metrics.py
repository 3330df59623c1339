"""Neighbourhood, clustering, spatial and alignment metrics on embeddings and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import hash_order, ratio
from tessera.model import SpatialData
from tessera.operators.far import plane_sums
from tessera.operators.graph import connected_components, knn_join, metric_knn, vector_knn, vectors
from tessera.session import cut_lineage, spread


def _with_values(edges: DataFrame, emb: DataFrame, column: str) -> DataFrame:
    """Edges with the value of both ends."""
    v = emb.select("spot_id", F.col(column).alias("_v"))
    return edges.select("src", "dst").join(v.toDF("src", "src_value"), "src").join(v.toDF("dst", "dst_value"), "dst")


def slice_mixing_entropy(emb: DataFrame, k: int = 15, edges: DataFrame | None = None) -> DataFrame:
    e = _with_values(metric_knn(emb, k) if edges is None else edges, emb, "slice")
    counts = e.groupBy("src", "dst_value").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("src"))
    h = counts.withColumn("p", p).groupBy("src").agg(
        (-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("h"), F.count("*").alias("m"))
    return h.agg(F.avg(F.when(F.col("m") > 1, F.col("h") / F.log("m")).otherwise(F.col("h"))).alias("value"))


def _distance_sums(a: np.ndarray, b: np.ndarray, weight: np.ndarray, first: np.ndarray, back: tuple[np.ndarray, np.ndarray] | None,
                   rows: int = 256, columns: int = 1024) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of weighted distances of every row of `a` to the runs of rows of `b` that start at `first`; with `back`, the weights and
    run starts of `a`, also those of every row of `b` to the runs of `a`.

    Distances come from products of centered vectors; pairs so close that a product loses digits are compared by direct differences."""
    center = b.mean(0)
    x, y = a - center, b - center
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    left = np.hstack([-2 * x, nx[:, None], np.ones((len(x), 1))])
    right = np.hstack([y, np.ones((len(y), 1)), ny[:, None]]).T
    run = np.searchsorted(first, np.arange(len(b)), "right") - 1
    out = np.zeros((len(a), len(first)))
    other, run_a = None, None
    if back is not None:
        other, run_a = np.zeros((len(back[1]), len(b))), np.searchsorted(back[1], np.arange(len(a)), "right") - 1
    for j in range(0, len(b), columns):
        part, r = right[:, j:j + columns].copy(), run[j:j + columns]
        heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        plain, w, most = bool((weight[j:j + columns] == 1).all()), weight[j:j + columns], ny[j:j + columns].max()
        for i in range(0, len(a), rows):
            d = left[i:i + rows] @ part
            low = 1e-6 * (nx[i:i + rows].max() + most)
            if d.min() <= low:
                at, to = np.nonzero(d <= low)
                for s in range(0, len(at), 4096):
                    diff = a[at[s:s + 4096] + i] - b[to[s:s + 4096] + j]
                    d[at[s:s + 4096], to[s:s + 4096]] = np.einsum("ij,ij->i", diff, diff)
            np.sqrt(d, out=d)
            if back is not None:
                ra = run_a[i:i + rows]
                tops = np.flatnonzero(np.r_[True, ra[1:] != ra[:-1]])
                wa = back[0][i:i + rows]
                other[ra[tops], j:j + columns] += np.add.reduceat(d if (wa == 1).all() else d * wa[:, None], tops, axis=0)
            out[i:i + rows, r[heads]] += np.add.reduceat(d if plain else d * w, heads, axis=1)
    return out, None if other is None else other.T


def silhouette_values(emb: DataFrame, cluster_col: str, sample: int | None = None, seed: int = 0,
                      by: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Euclidean silhouette of each point inside each `by` group; over a hashed sample only if `sample` is given.

    Equal vectors of a cluster are one weighted point. Points are hashed to blocks, 16 of a large group and more where one would pass
    `block` points; every unordered pair of blocks is one task unit that returns, per point of either block, its distance sums to the
    clusters of the other. So point pairs are never rows, and a point is sent once per block. Many points of one or two dimensions and no
    `by` are summed by `far.plane_sums` instead, whose work does not grow with the square."""
    by = list(by)
    x = emb.select(*by, "spot_id", F.col(cluster_col).cast("string").alias("c"), F.col("emb").cast("array<double>").alias("emb")).filter("c IS NOT NULL")
    if sample is not None:
        w = Window.partitionBy(*by).orderBy(hash_order(seed, "spot_id"), "spot_id")
        x = x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample).drop("_rn")
    if not by:
        x = x.withColumn("_g", F.lit(0))
    keys = by or ["_g"]
    points = x.groupBy(*keys, "c", "emb").agg(F.min("spot_id").alias("one"), F.count("*").alias("w"))
    points = cut_lineage(points)
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.size("emb")).alias("_dim"))
    most = F.lit(block) if block else F.least(F.greatest(F.floor(F.lit(2 ** 22) / F.greatest("_dim", F.lit(1))), F.lit(1024)), F.lit(131_072))
    few = F.lit(1) if block else F.least(F.lit(16), F.floor((F.col("_n") - 1) / 512) + 1)
    sizes = sizes.select(*keys, F.greatest(few, F.floor((F.col("_n") - 1) / most) + 1).cast("int").alias("_nb"))
    placed = points.join(sizes, keys).withColumn("_b", F.pmod(F.xxhash64("one", "c"), F.col("_nb")).cast("int"))
    # a block meets itself and the later ones from the left, the earlier ones from the right
    columns = [*keys, "one", "c", "w", "emb"]
    left = placed.select(*columns, F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_nb") - 1)).alias("_j"))
    right = placed.filter("_b > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_i"), F.col("_b").alias("_j"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    id_type = emb.schema["spot_id"].dataType.simpleString()
    group_type = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in keys)

    def sums_of(ids: pa.Table, totals: np.ndarray, names: pa.Array) -> dict:
        """One row per point and cluster."""
        each = pa.array(np.repeat(np.arange(len(totals)), len(names)))
        return {**{c: ids[c].combine_chunks().take(each) for c in [*keys, "one", "c"]},
                "k": names.take(pa.array(np.tile(np.arange(len(names)), len(totals)))), "total": pa.array(totals.ravel())}

    def runs(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Rows by cluster, their vectors and weights, where clusters start, and their names."""
        t = t.take(pc.sort_indices(t["c"]))
        c = t["c"].combine_chunks()
        code = c.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return t, vectors(t["emb"]), t["w"].to_numpy().astype(float), first, c.take(pa.array(first))

    def work(_, a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and (b.num_rows or a["_i"][0] == a["_j"][0]):
            a, va, wa, fa, ka = runs(a)
            if not b.num_rows:
                out.append(sums_of(a, _distance_sums(va, va, wa, fa, None)[0], ka))
            else:
                b, vb, wb, fb, kb = runs(b)
                there, back = _distance_sums(va, vb, wb, fb, (wa, fa))
                out += [sums_of(a, there, kb), sums_of(b, back, ka)]
        if not out:
            return pa.schema([*[a.schema.field(c) for c in [*keys, "one", "c"]], ("k", pa.string()), ("total", pa.float64())]).empty_table()
        return pa.concat_tables([pa.table(o) for o in out])

    unit = [*keys, "_i", "_j"]
    sums = None if by or block else plane_sums(points, keys)
    if sums is None:
        sums = spread(left, *unit).groupBy(*unit).cogroup(spread(right, *unit).groupBy(*unit)).applyInArrow(
            work, f"{group_type}, one {id_type}, c string, k string, total double")
    n = x.groupBy(*keys, F.col("c").alias("k")).agg(F.count("*").alias("n"))
    d = sums.groupBy(*keys, "one", "c", "k").agg(F.sum("total").alias("total")).join(n, [*keys, "k"])
    own = F.col("c") == F.col("k")
    s = d.groupBy(*keys, "one", "c").agg(
        F.max(F.when(own, F.col("n"))).alias("n_own"), F.max(F.when(own, ratio("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("n_own") == 1, 0.0).otherwise(F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    # back to all points of a vector
    of_one = points.select(*keys, "one", "c", "emb").join(s.select(*keys, "one", "c", value.alias("silhouette")), [*keys, "one", "c"])
    return x.join(of_one.select(*keys, "c", "emb", "silhouette"), [*keys, "c", "emb"]).select(*by, "spot_id", "c", "silhouette")


def squared_silhouette_values(emb: DataFrame, cluster_col: str, by: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """Silhouette on squared Euclidean distances, in time linear in the points.

    The summed squared distance of x to a cluster is n |x|^2 - 2 x.S + Q with the cluster's size n, vector sum S and sum of
    squares Q. Tasks sum their own points per cluster first; blocks of points then meet one row per cluster."""
    by = list(by)
    x = emb.select(*by, "spot_id", F.col(cluster_col).cast("string").alias("c"), "emb").filter("c IS NOT NULL")
    if not by:
        x = x.withColumn("_g", F.lit(0))
    keys = by or ["_g"]
    group_type = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in keys)
    id_type = emb.schema["spot_id"].dataType.simpleString()

    def partial(frames):
        for f in frames:
            for key, g in f.groupby([*keys, "c"], sort=False):
                m = np.stack(g["emb"].to_numpy())
                yield pd.DataFrame([[*key, len(m), m.sum(0), float((m * m).sum())]], columns=[*keys, "k", "n", "total", "q"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*f[[*keys, "k"]].iloc[0], f["n"].sum(), np.sum(np.stack(f["total"].to_numpy()), axis=0), f["q"].sum()]],
                            columns=[*keys, "k", "n", "total", "q"])

    schema = f"{group_type}, k string, n long, total array<double>, q double"
    stats = cut_lineage(x.select(*keys, "c", "emb").mapInPandas(partial, schema).groupBy(*keys, "k").applyInPandas(add, schema))
    blocks = stats.groupBy(*keys).agg((F.floor((F.sum("n") - 1) / block) + 1).cast("int").alias("_nb"))
    placed = x.join(blocks, keys).withColumn("_b", F.pmod(F.xxhash64("spot_id"), F.col("_nb")).cast("int")).drop("_nb")
    dealt = stats.join(blocks, keys).select(*stats.columns, F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_b"))

    def work(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "spot_id", "c", "silhouette"]
        if f.empty:
            return pd.DataFrame(columns=columns)
        m, n = np.stack(f["emb"].to_numpy()), s["n"].to_numpy(float)
        total = np.maximum((m * m).sum(1)[:, None] * n - 2 * m @ np.stack(s["total"].to_numpy()).T + s["q"].to_numpy(), 0)
        own = f["c"].to_numpy()[:, None] == s["k"].to_numpy()[None, :]
        size = (own * n).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (own * total).sum(1) / (size - 1)
            b = np.where(own, np.inf, total / n).min(1)
            value = np.where((size > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
        return f.assign(silhouette=value)[columns]

    unit = [*keys, "_b"]
    out = placed.groupBy(*unit).cogroup(dealt.groupBy(*unit)).applyInPandas(work, f"{group_type}, spot_id {id_type}, c string, silhouette double")
    return out.select(*by, "spot_id", "c", "silhouette")


def silhouette(emb: DataFrame, cluster_col: str, sample: int | None = None, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette; NULL with fewer than two clusters."""
    s = silhouette_values(emb, cluster_col, sample, seed, by)
    return s.groupBy(*by).agg(F.when(F.count_distinct("c") >= 2, F.avg("silhouette")).alias("value"), F.count("*").alias("n"))


def inverse_slice_silhouette(emb: DataFrame) -> DataFrame:
    s = silhouette(emb, "slice", None)
    return s.select(F.coalesce(1 - (F.col("value") + 1) / 2, F.lit(0.0)).alias("value"))


def dasw(emb: DataFrame, label_col: str = "label") -> DataFrame:
    return silhouette(emb, label_col).select(((F.col("value") + 1) / 2).alias("value"))


def basw(emb: DataFrame, slice_col: str = "slice", label_col: str | None = "label") -> DataFrame:
    """Mean over labels with at least three spots and two slices of 1 - |slice silhouette|."""
    x = emb.withColumn("_l", F.lit("all") if label_col is None else F.col(label_col).cast("string"))
    s = silhouette(x, slice_col, by=["_l"])
    return s.filter("n >= 3").agg(F.avg(1 - F.abs("value")).alias("value"))


def lisi(emb: DataFrame, column: str, k: int = 15, mode: str = "batch", edges: DataFrame | None = None) -> DataFrame:
    """Scaled inverse Simpson index of neighbour values."""
    e = _with_values(metric_knn(emb, k) if edges is None else edges, emb, column)
    counts = e.groupBy("src", "dst_value").agg(F.count("*").cast("double").alias("c"))
    s = counts.groupBy("src").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("s"))
    classes = emb.select(F.count_distinct(column)).scalar()
    scaled = s.withColumn("n", classes).withColumn("v", ratio(F.col("s") - 1, F.col("n") - 1))
    v = F.col("v") if mode == "batch" else 1 - F.col("v")
    clipped = F.least(F.greatest(F.avg(v), F.lit(0.0)), F.lit(1.0))
    return scaled.agg(F.when(F.max("n") <= 1, 1.0).otherwise(clipped).alias("value"))


def isolated_label_f1(emb: DataFrame, k: int = 15, edges: DataFrame | None = None) -> DataFrame:
    """Labels found in one slice only (all labels if there is none): a point is predicted to have a label
    when any neighbour has it."""
    e = _with_values(metric_knn(emb, k) if edges is None else edges, emb, "label")
    spread = emb.groupBy("label").agg(F.count_distinct("slice").alias("m"), F.count("*").alias("n"))
    lone = spread.select(F.count_if(F.col("m") == 1)).scalar()
    targets = spread.withColumn("_lone", lone).filter("_lone = 0 OR m = 1")
    predicted = e.groupBy("src", "src_value", F.col("dst_value").alias("label")).agg(F.count("*").alias("_c"))
    hits = predicted.groupBy("label").agg(
        F.count_if(F.col("src_value") == F.col("label")).alias("tp"), F.count_if(F.col("src_value") != F.col("label")).alias("fp"))
    j = targets.join(hits, "label", "left").na.fill(0, ["tp", "fp"])
    precision = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12)
    recall = F.col("tp") / (F.col("n") + 1e-12)
    return j.agg(F.avg(2 * precision * recall / (precision + recall + 1e-12)).alias("value"))


def graph_connectivity(emb: DataFrame, k: int = 15, edges: DataFrame | None = None) -> DataFrame:
    """Share of the largest component of each label in the neighbour graph, averaged over labels."""
    e = _with_values(metric_knn(emb, k) if edges is None else edges, emb, "label").filter("src_value = dst_value")
    c = connected_components(e, emb.select(F.col("spot_id").alias("node")))
    sized = c.join(emb.select(F.col("spot_id").alias("node"), "label"), "node").groupBy("label", "component").agg(F.count("*").alias("n"))
    share = sized.groupBy("label").agg((F.max("n") / F.sum("n")).alias("s"))
    return share.agg(F.avg("s").alias("value"))


def neighbor_overlap(reference: DataFrame, emb: DataFrame, k: int = 15) -> DataFrame:
    """Mean Jaccard index of the neighbour sets of each point in two embeddings."""
    a = metric_knn(reference, k).select("src", "dst", F.lit(1).alias("a"))
    b = metric_knn(emb, k).select("src", "dst", F.lit(1).alias("b"))
    both = a.join(b, ["src", "dst"], "full").groupBy("src").agg(
        (F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.greatest(F.count("*"), F.lit(1))).alias("j"))
    return both.agg(F.avg("j").alias("value"))


def label_purity(emb: DataFrame, k: int = 15, edges: DataFrame | None = None) -> DataFrame:
    e = _with_values(metric_knn(emb, k) if edges is None else edges, emb, "label")
    own = e.groupBy("src").agg(F.avg((F.col("src_value") == F.col("dst_value")).cast("double")).alias("p"))
    return own.agg(F.avg("p").alias("value"))


def _contingency(df: DataFrame, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))


def ari(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    c = _contingency(df, truth, pred, by)

    def pairs(col: Column) -> Column:
        return F.sum(col * (col - 1) / 2)

    t = c.groupBy(*by, "t").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(F.col("n")).alias("a"), F.sum("n").alias("total"))
    p = c.groupBy(*by, "p").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(F.col("n")).alias("b"))
    s = c.groupBy(*by).agg(pairs(F.col("n")).alias("s"))
    j = _zip(_zip(s, t, by), p, by)
    expected = ratio(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2)
    top = F.col("s") - expected
    return j.select(*by, F.coalesce(ratio(top, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("value"))


def _zip(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join one-row-per-group tables; without groups both have one row and the right one goes in as scalars."""
    if by:
        return left.join(right, list(by))
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


def nmi(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Normalized mutual information with the arithmetic mean of entropies."""
    c = _contingency(df, truth, pred, by)
    g = list(by)
    total = F.sum("n").over(Window.partitionBy(*g))
    joint = c.groupBy(*g, "t", "p").agg(F.sum("n").alias("n")).withColumns({
        "nt": F.sum("n").over(Window.partitionBy(*g, "t")), "np": F.sum("n").over(Window.partitionBy(*g, "p")), "total": total})
    mi = joint.groupBy(*g).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nt") * F.col("np")))).alias("mi"))

    def entropy(side: str) -> DataFrame:
        m = c.groupBy(*g, side).agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*g)))
        return m.groupBy(*g).agg((-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias(f"h{side}"))

    j = _zip(_zip(mi, entropy("t"), g), entropy("p"), g)
    return j.select(*g, F.coalesce(ratio(F.greatest("mi", F.lit(0.0)), F.when(F.col("ht") + F.col("hp") > 1e-15, (F.col("ht") + F.col("hp")) / 2)),
                                   F.lit(1.0)).alias("value"))


def chaos(spots: DataFrame, cluster_col: str, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Per group: sum of nearest in-cluster distances of clusters with more than two spots over all spots,
    on coordinates scaled to unit deviation."""
    by = list(by)
    x = spots.filter(F.col(cluster_col).isNotNull()).select(*by, "spot_id", F.col(cluster_col).cast("string").alias("_k"), "x", "y")
    m = x.groupBy(*by).agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"),
                           F.stddev_pop("y").alias("sy"), F.count("*").alias("n"))
    scaled = x.join(m.drop("n"), by).select(*by, "spot_id", "_k", ((F.col("x") - F.col("mx")) / (F.col("sx") + 1e-12)).alias("x"),
                                            ((F.col("y") - F.col("my")) / (F.col("sy") + 1e-12)).alias("y"))
    big = x.groupBy(*by, "_k").agg(F.count("*").alias("c")).filter("c > 2").drop("c")
    near = knn_join(scaled.join(big, [*by, "_k"], "left_semi"), 1, [*by, "_k"])
    total = near.groupBy(*by).agg(F.sum(F.sqrt("dist2")).alias("t"))
    return m.join(total, by, "left").select(*by, F.when(F.col("n") <= 1, 0.0).otherwise(
        F.coalesce("t", F.lit(0.0)) / F.col("n")).alias("value"))


def pas(spots: DataFrame, cluster_col: str, k: int = 10, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Share of spots with more than half of their neighbours (ranks 2..k+1) in another cluster."""
    by = list(by)
    c = spots.select(*by, "spot_id", F.col(cluster_col).alias("_v"))
    e = knn_join(spots, max(2, k + 1), by).filter("rank > 1").select(*by, "src", "dst")
    e = e.join(c.toDF(*by, "src", "a"), [*by, "src"]).join(c.toDF(*by, "dst", "b"), [*by, "dst"])
    bad = e.groupBy(*by, "src").agg((F.count_if(F.col("a") != F.col("b")) > F.count("*") / 2).cast("int").alias("d"))
    n = spots.groupBy(*by).agg(F.count("*").alias("n"))
    s = bad.groupBy(*by).agg(F.sum("d").alias("d"))
    return n.join(s, by, "left").select(*by, (F.coalesce("d", F.lit(0)) / F.col("n")).alias("value"))


def spatial_coherence(spots: DataFrame, label_col: str = "label", k: int = 8) -> DataFrame:
    """Share of directed neighbour edges whose ends have the same label."""
    c = spots.select("spot_id", F.col(label_col).alias("_v"))
    e = knn_join(spots, k).join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst")
    return e.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("value"))


def morans_i_column(spots: DataFrame, value_col: str, k: int = 8) -> DataFrame:
    """Moran's I of one column on the directed neighbour graph, over all slices."""
    mean = spots.select(F.avg(value_col)).scalar()
    z = spots.select("spot_id", (F.col(value_col) - mean).alias("z"))
    e = knn_join(spots, k).join(z.toDF("src", "a"), "src").join(z.toDF("dst", "b"), "dst").agg(
        F.sum(F.col("a") * F.col("b")).alias("num"), F.count("*").alias("w"))
    s = z.agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.count("*").alias("n"))
    return _zip(e, s, []).select(F.coalesce(F.col("n") / F.col("w") * ratio("num", F.when(F.col("den") > 1e-12, F.col("den"))), F.lit(0.0)).alias("value"))


def alignment_scores(emb: DataFrame, pairs: Sequence[tuple[str, str]], cap: int | None = None, seed: int = 0,
                     check: bool = True) -> DataFrame:
    """Accuracy and Ratio over declared slice pairs: nearest points both ways, label agreement, and
    |log2(smaller side / distinct targets)|. NULL without pairs."""
    if not pairs:
        return emb.sparkSession.range(1).select(F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("ratio"))
    if check:
        have = {r["slice"] for r in emb.select("slice").distinct().collect()}
        missing = sorted({s for p in pairs for s in p} - have)
        if missing:
            raise ValueError(f"alignment slices are missing: {missing}")
    if cap is not None:
        w = Window.partitionBy("slice").orderBy(hash_order(seed, "spot_id"), "spot_id")
        emb = emb.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")
    # both directions of all pairs are keys of one neighbour join
    sides = F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(a).alias("from"), F.lit(b).alias("to")) for p in pairs for a, b in (p, p[::-1])]))
    declared = emb.sparkSession.range(1).select(sides.alias("p")).select(F.col("p.*")).distinct()
    queries = emb.join(declared.withColumnRenamed("from", "slice"), "slice").select("pair", "spot_id", "emb", "label")
    targets = emb.join(declared.withColumnRenamed("to", "slice"), "slice").select("pair", "spot_id", "emb", "label")
    small = emb.groupBy("slice").agg(F.count("*").alias("n"))
    small = declared.join(small.toDF("from", "nf"), "from").join(small.toDF("to", "nt"), "to").select("pair", F.least("nf", "nt").alias("n"))
    e = vector_knn(targets, 1, queries=queries, by=["pair"], exclude_self=False)
    e = e.join(queries.select("pair", F.col("spot_id").alias("src"), F.col("label").alias("a")), ["pair", "src"]).join(
        targets.select("pair", F.col("spot_id").alias("dst"), F.col("label").alias("b")), ["pair", "dst"])
    out = e.groupBy("pair").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("acc"), F.count_distinct("dst").alias("t")).join(small, "pair").select(
        "pair", "acc", F.abs(F.log2(F.col("n") / F.greatest("t", F.lit(1)))).alias("rat"))
    # a pair weighs as often as it is declared
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{a}|{b}").alias("pair")) for i, p in enumerate(pairs) for a, b in (p, p[::-1])]))
    listed = emb.sparkSession.range(1).select(names.alias("p")).select("p.*")
    return listed.join(out, "pair").groupBy("i").agg(F.avg("acc").alias("acc"), F.avg("rat").alias("rat")).agg(
        F.avg("acc").alias("accuracy"), F.avg("rat").alias("ratio"))


def kmeans_embed(emb: DataFrame, k: int, seed: int = 0, n_init: int = 20) -> DataFrame:
    """k-means with several seeds; the run of lowest cost gives `cluster`."""
    x = cut_lineage(emb.withColumn("features", array_to_vector("emb")))
    best = None
    for i in range(n_init):
        model = KMeans(k=k, seed=seed * 1000 + i, maxIter=50).fit(x)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(x).withColumnRenamed("prediction", "cluster").drop("features")


def slice_abundance(df: DataFrame, slice_col: str = "slice", domain_col: str = "label") -> DataFrame:
    """Share of each domain in each slice (rows of present domains)."""
    c = df.groupBy(F.col(slice_col).alias("slice"), F.col(domain_col).cast("string").alias("domain")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("slice")))


def _slice_pairs(abundance: DataFrame) -> DataFrame:
    """Euclidean distance of every two slices (a dictionary-sized table): from dot products over shared
    domains, |a|^2 + |b|^2 - 2ab, so absent domains need no rows."""
    a = abundance.select("domain", F.col("slice").alias("u"), F.col("share").alias("su"))
    b = abundance.select("domain", F.col("slice").alias("v"), F.col("share").alias("sv"))
    norm = abundance.groupBy("slice").agg(F.sum(F.col("share") * F.col("share")).alias("q"))
    names = norm.agg(F.sort_array(F.collect_list(F.struct("slice", "q"))).alias("s")).scalar()
    every = norm.select(F.col("slice").alias("u"), F.col("q").alias("qu"), F.explode(names).alias("_s")).select(
        "u", "qu", F.col("_s.slice").alias("v"), F.col("_s.q").alias("qv")).filter("u < v")
    dots = a.join(b, "domain").filter("u < v").groupBy("u", "v").agg(F.sum(F.col("su") * F.col("sv")).alias("dot"))
    d2 = F.col("qu") + F.col("qv") - 2 * F.coalesce("dot", F.lit(0.0))
    return every.join(dots, ["u", "v"], "left").select("u", "v", F.sqrt(F.greatest(d2, F.lit(0.0))).alias("d"))


def slice_distance_mean(abundance: DataFrame) -> DataFrame:
    return _slice_pairs(abundance).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("value"))


def slice_clusters(abundance: DataFrame, n: int, method: str = "hclust", seed: int = 0) -> DataFrame:
    """Clusters of slices by complete linkage (repeated merges of the closest pair, with the larger
    distance kept) or k-means."""
    slices = abundance.select("slice").distinct()
    if method != "hclust":
        domains = sorted(r["domain"] for r in abundance.select("domain").distinct().collect())
        wide = abundance.groupBy("slice").pivot("domain", domains).agg(F.max("share")).na.fill(0.0)
        emb = wide.select("slice", F.array(*[F.col(f"`{d}`") for d in domains]).alias("emb"))
        return kmeans_embed(emb, min(n, slices.count()), seed).select("slice", F.col("cluster").cast("string").alias("cluster"))
    dist = cut_lineage(_slice_pairs(abundance).withColumn("d", F.round("d", 12)))
    member = cut_lineage(slices.select("slice", F.col("slice").alias("cluster")))
    for _ in range(max(0, slices.count() - n)):
        # one row: the closest pair
        u, v = dist.orderBy("d", "u", "v").select("u", "v").first()
        renamed = dist.filter(~((F.col("u") == u) & (F.col("v") == v))).select(
            F.when(F.col("u") == v, u).otherwise(F.col("u")).alias("u"), F.when(F.col("v") == v, u).otherwise(F.col("v")).alias("v"), "d")
        dist = cut_lineage(renamed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("d").alias("d")))
        member = member.withColumn("cluster", F.when(F.col("cluster") == v, u).otherwise(F.col("cluster")))
    return member


def slice_representation(spots: DataFrame, n: int, domain_col: str = "label", method: str = "hclust") -> DataFrame:
    """Slice clusters against slice classes (ARI, NMI), or the mean slice distance without classes."""
    abundance = slice_abundance(spots, "slice", domain_col)
    if "slice_class" not in spots.columns:
        return slice_distance_mean(abundance).select(F.lit("slice_repr_distance_mean").alias("metric_name"), F.col("value").alias("metric_value"))
    truth = spots.groupBy("slice").agg(F.min("slice_class").alias("slice_class"))
    j = cut_lineage(slice_clusters(abundance, n, method).join(truth, "slice"))
    return ari(j, "slice_class", "cluster").select(F.lit("slice_repr_ARI").alias("metric_name"), F.col("value").alias("metric_value")).unionByName(
        nmi(j, "slice_class", "cluster").select(F.lit("slice_repr_NMI").alias("metric_name"), F.col("value").alias("metric_value")))


# ---- task bundles --------------------------------------------------------------

def _rows(parts: dict[str, DataFrame], task: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(task).alias("task"), F.lit(name).alias("metric_name"), F.col("value").cast("double").alias("metric_value"))
        out = row if out is None else out.unionByName(row)
    return out


def eval_integration(emb: DataFrame, k: int = 15, labelled: bool = True) -> DataFrame:
    edges = metric_knn(emb, k)
    null = emb.sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
    return _rows({
        "bASW": basw(emb, label_col="label" if labelled else None), "iLISI": lisi(emb, "slice", k, "batch", edges),
        "dASW": dasw(emb) if labelled else null, "dLISI": lisi(emb, "label", k, "label", edges) if labelled else null,
        "ILL": isolated_label_f1(emb, k, edges) if labelled else null,
        "GC": graph_connectivity(emb, k, edges) if labelled else null}, "Integration")


def eval_clustering(spots: DataFrame, emb: DataFrame, cluster_col: str = "cluster", k: int = 10, labelled: bool = True) -> DataFrame:
    """`emb` carries predicted clusters (see `kmeans_embed`); CHAOS and PAS are means over slices."""
    placed = spots.select("spot_id", "slice", "x", "y").join(emb.select("spot_id", cluster_col), "spot_id")
    null = emb.sparkSession.range(1).select(F.lit(None).cast("double").alias("value"))
    mean = F.avg("value").alias("value")
    return _rows({
        "silhouette": silhouette(emb, cluster_col).select(F.coalesce("value", F.lit(0.0)).alias("value")), "ari": ari(emb, "label", cluster_col) if labelled else null,
        "nmi": nmi(emb, "label", cluster_col) if labelled else null,
        "CHAOS": chaos(placed, cluster_col).agg(mean), "PAS": pas(placed, cluster_col, k).agg(mean)}, "Clustering")


def eval_alignment(emb: DataFrame, pairs: Sequence[tuple[str, str]], cap: int | None = None, seed: int = 0) -> DataFrame:
    s = alignment_scores(emb, pairs, cap, seed)
    return _rows({"Accuracy": s.select(F.col("accuracy").alias("value")), "Ratio": s.select(F.col("ratio").alias("value"))}, "Alignment")


def eval_slices(spots: DataFrame, n: int, domain_col: str = "label", method: str = "hclust") -> DataFrame:
    return slice_representation(spots, n, domain_col, method).select(
        F.lit("SliceRepresentation").alias("task"), "metric_name", F.col("metric_value").cast("double").alias("metric_value"))


TASKS: dict[str, Callable[..., DataFrame]] = {
    "integration_eval": eval_integration, "clustering_eval": eval_clustering,
    "alignment_eval": eval_alignment, "slice_representation_eval": eval_slices}


def to_records(task_rows: DataFrame, **fields: object) -> DataFrame:
    """Task rows in the record schema; missing fields are NULL."""
    from tessera.model import RECORD_SCHEMA

    have = set(task_rows.columns)
    return task_rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(fields.get(f.name))).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA])


def run_selector(ds: SpatialData, fn: Callable[..., DataFrame], n: int | None, **params: object) -> DataFrame:
    """Apply a registered selector and cut its scores at n."""
    from tessera.operators.ranking import top_features

    return top_features(fn(ds, **params), n)
