"""Count contracts, filters, normalization, subsets, sampling and pooling on long expression triples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.checks import assert_empty
from tessera.functions.numeric import hash_order, ratio, solve3
from tessera.functions.ranks import exact_quantiles
from tessera.model import SpatialData
from tessera.session import spread_rows

# fixed values: annotation texts that stand for "no label"
INVALID_LABELS = ["", "nan", "none", "unknown", "unassigned", "na", "n/a"]


def resolve_counts(expr: DataFrame, requested: str | None = None) -> DataFrame:
    """Pick the count layer: the requested one, else `counts`, else `raw_count`, else `x`."""
    if requested is not None:
        source = "x" if requested.lower() == "x" else requested
        if source not in expr.columns:
            raise ValueError(f"count layer {requested} is not present")
    else:
        source = next((c for c in ("counts", "raw_count", "x") if c in expr.columns), None)
        if source is None:
            raise ValueError("no count layer: expected counts, raw_count or x")
    return expr.withColumn("count", F.col(source).cast("double")).filter("count <> 0")


def is_count_like(expr: DataFrame, column: str = "count", tolerance: float = 1e-6) -> DataFrame:
    """One row telling if all values are finite, not negative and whole within the tolerance."""
    v = F.col(column)
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = finite & (v >= -tolerance) & (F.abs(v - F.rint(v)) <= tolerance)
    return expr.agg(F.count("*").alias("n_values"), F.min(v).alias("min_value"),
                    F.max(F.abs(v - F.rint(v))).alias("max_fraction"),
                    F.coalesce(F.bool_and(ok), F.lit(True)).alias("count_like"))


def require_counts(expr: DataFrame, column: str = "count") -> DataFrame:
    if not is_count_like(expr, column).first()["count_like"]:
        raise ValueError(f"column {column} does not hold non-negative whole counts")
    return expr


def filter_genes(expr: DataFrame, min_spots: int, column: str = "count") -> DataFrame:
    keep = expr.groupBy("gene").agg(F.count_if(F.col(column) > 0).alias("_n")).filter(F.col("_n") >= min_spots)
    return expr.join(keep.select("gene"), "gene", "left_semi")


def filter_spots(expr: DataFrame, min_counts: float = 0, min_genes: int = 0, column: str = "count") -> DataFrame:
    keep = expr.groupBy("spot_id").agg(
        F.sum(column).alias("_t"), F.count_if(F.col(column) > 0).alias("_g")
    ).filter((F.col("_t") >= min_counts) & (F.col("_g") >= min_genes))
    return expr.join(keep.select("spot_id"), "spot_id", "left_semi")


def normalize_total(expr: DataFrame, target: float | None = 1e4, column: str = "count",
                    out: str = "value", entries: int | None = None) -> DataFrame:
    """Scale each spot to `target`; without a target, to the median of the positive spot totals.
    The number of `entries`, where it is known, keeps the entries of a task bounded."""
    expr = spread_rows(expr, entries, "spot_id")
    # a spot has at most one row per gene, so the window group is bounded by the gene dictionary
    total = F.sum(column).over(Window.partitionBy("spot_id"))
    if target is not None:
        return expr.withColumn(out, ratio(F.col(column) * F.lit(float(target)), total))
    totals = expr.groupBy("spot_id").agg(F.sum(column).alias("_total")).filter("_total > 0")
    median = exact_quantiles(totals, "_total", [], {"m": 0.5}).scalar()
    return expr.withColumn(out, ratio(F.col(column) * median, total))


def log1p(expr: DataFrame, column: str = "value") -> DataFrame:
    return expr.withColumn(column, F.log1p(column))


def gene_scale_params(expr: DataFrame, n_spots: Column, column: str = "value") -> DataFrame:
    """Zero-aware mean and ddof=1 deviation per gene, and the scaled value of an absent entry."""
    return expr.groupBy("gene").agg(
        (F.sum(column) / n_spots).alias("mean"), F.sum(F.col(column) * F.col(column)).alias("_sq")
    ).withColumn("sd", F.sqrt(F.greatest(
        (F.col("_sq") - n_spots * F.col("mean") * F.col("mean")) / (n_spots - 1), F.lit(0.0)))).withColumn(
        "sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).drop("_sq")


def scale(ds: SpatialData, column: str = "value", max_value: float | None = 10.0) -> tuple[DataFrame, DataFrame]:
    """Per-gene z-scale with an upper clip. Returns (entries with `scaled`, genes with `zero_scaled`):
    the matrix stays sparse because every absent entry of a gene has the same scaled value."""
    n = ds.spots.select(F.count("*")).scalar()
    params = gene_scale_params(ds.expr, n, column)

    def clip(z: Column) -> Column:
        return z if max_value is None else F.least(z, F.lit(float(max_value)))

    params = params.withColumn("zero_scaled", clip(-F.col("mean") / F.col("sd")))
    entries = ds.expr.join(params.select("gene", "mean", "sd"), "gene").withColumn(
        "scaled", clip((F.col(column) - F.col("mean")) / F.col("sd"))).drop("mean", "sd")
    return entries, params


def shift_nonnegative(expr: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Subtract a negative global minimum. Returns (entries, one row with the value of absent entries)."""
    low = expr.agg(F.least(F.min(column), F.lit(0.0)).alias("low"))
    shifted = expr.withColumn(column, F.col(column) - low.scalar())
    return shifted, low.select((-F.col("low")).alias("zero_value"))


def is_mito(gene: str = "gene") -> Column:
    return F.col(gene).rlike("^(MT-|mt-)")


def pct_mito(expr: DataFrame, mito: Column | None = None, column: str = "count") -> DataFrame:
    mito = is_mito() if mito is None else mito
    return expr.groupBy("slice", "spot_id").agg(
        F.sum(column).alias("total"),
        (100 * ratio(F.sum(F.when(mito, F.col(column)).otherwise(0.0)), F.sum(column))).alias("pct_mito"))


def qc_cascade(spots: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Audit of ordered keep-rules: each spot counts for the first rule it fails."""
    first = F.lit(len(rules))
    for i, (_, keep) in reversed(list(enumerate(rules))):
        first = F.when(~F.coalesce(keep, F.lit(False)), F.lit(i)).otherwise(first)
    failed = spots.groupBy(first.alias("step")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(r[0]) for r in rules])
    steps = spots.sparkSession.range(len(rules)).select(F.col("id").cast("int").alias("step"))
    removed = steps.join(failed, "step", "left").select(
        "step", F.element_at(names, F.col("step") + 1).alias("rule"), F.coalesce("n", F.lit(0)).alias("removed"))
    total = spots.select(F.count("*")).scalar()
    running = F.sum("removed").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return removed.select("step", "rule", "removed", (total - running).alias("remaining"))


def qc_keep(spots: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, keep in rules:
        spots = spots.filter(keep)
    return spots


def filter_metadata(spots: DataFrame, sections: Sequence[str], passed: Column, exclude_labels: Sequence[str]) -> DataFrame:
    return spots.filter(F.col("slice").isin(list(sections)) & passed & ~F.col("label").isin(list(exclude_labels)))


def subset_slices(ds: SpatialData, slices: Sequence[str], check: bool = True) -> SpatialData:
    keep = F.col("slice").isin(list(slices))
    return _nonempty(SpatialData(ds.spots.filter(keep), ds.genes, ds.expr.filter(keep), ds.pairs), "slices", check)


def subset_labels(ds: SpatialData, labels: Sequence[str] | DataFrame, check: bool = True) -> SpatialData:
    """`labels` are names, or a frame with a column `label`."""
    named = isinstance(labels, DataFrame)
    spots = ds.spots.join(labels.select("label"), "label", "left_semi") if named else ds.spots.filter(F.col("label").isin(list(labels)))
    expr = ds.expr.join(spots.select("spot_id"), "spot_id", "left_semi")
    return _nonempty(SpatialData(spots, ds.genes, expr, ds.pairs), "labels", check)


def subset_features(ds: SpatialData, features: DataFrame, check: bool = True) -> SpatialData:
    genes = ds.genes.join(features.select("gene"), "gene", "left_semi")
    if check and genes.isEmpty():
        raise ValueError("no requested feature is in the dataset")
    return SpatialData(ds.spots, genes, ds.expr.join(features.select("gene"), "gene", "left_semi"), ds.pairs)


def _nonempty(ds: SpatialData, what: str, check: bool) -> SpatialData:
    if check and ds.spots.isEmpty():
        raise ValueError(f"no spot is left after the choice of {what}")
    return ds


def quantile_crop(spots: DataFrame, lo: float, hi: float) -> DataFrame:
    """Keep the box between two coordinate quantiles of each slice."""
    box = exact_quantiles(spots, "x", ["slice"], {"x_lo": lo, "x_hi": hi}).join(
        exact_quantiles(spots, "y", ["slice"], {"y_lo": lo, "y_hi": hi}), "slice")
    inside = F.col("x").between(F.col("x_lo"), F.col("x_hi")) & F.col("y").between(F.col("y_lo"), F.col("y_hi"))
    return spots.join(box, "slice").filter(inside).select(*spots.columns)


def crop_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.groupBy("slice").agg(F.count("*").alias("n_before"))
    a = after.groupBy("slice").agg(F.count("*").alias("n_after"))
    return b.join(a, "slice", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


def annotate_slice_class(spots: DataFrame, sizes: dict[str, int], strict: bool = True) -> DataFrame:
    """Class of each slice from its position in sorted order and the given group sizes."""
    # slice names form a small dictionary; their sorted array gives each one its position
    names = spots.agg(F.sort_array(F.collect_set("slice")).alias("names"))
    if strict and names.first()["names"].__len__() != sum(sizes.values()):
        raise ValueError("slice class sizes do not add up to the number of slices")
    bounds, total = [], 0
    for label, size in sizes.items():
        total += size
        bounds.append((label, total))
    klass = F.lit(None).cast("string")
    for label, upper in reversed(bounds):
        klass = F.when(F.col("_pos") < upper, label).otherwise(klass)
    classes = names.select(F.posexplode("names").alias("_pos", "slice")).select("slice", klass.alias("slice_class"))
    return spots.drop("slice_class").join(classes, "slice")


def sample_spots(spots: DataFrame, n: int, seed: int, keep_order: bool = True) -> DataFrame:
    """Uniform sample without replacement: the n smallest hashes of (seed, spot)."""
    picked = spots.orderBy(hash_order(seed, "spot_id"), "spot_id").limit(n)
    return picked.sort("spot_id") if keep_order else picked


def _cap(spots: DataFrame, per_slice: Column, seed: int, extra: Sequence[Column | str] = ()) -> DataFrame:
    w = Window.partitionBy("slice").orderBy(hash_order(seed, *extra, "spot_id"), "spot_id")
    return spots.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_slice).drop("_rn")


def sample_by_slice(spots: DataFrame, max_cells: int, seed: int) -> DataFrame:
    """max(1, max_cells // slices) spots of each slice, then trimmed to max_cells; all if few enough."""
    size = spots.agg(F.count("*").alias("n"), F.count_distinct("slice").alias("k")).first()
    if size["n"] <= max_cells:
        return spots
    return sample_spots(_cap(spots, F.lit(max(1, max_cells // size["k"])), seed), max_cells, seed, False)


def cap_slices(spots: DataFrame, max_cells: int, seed: int, n_slices: int | None = None) -> DataFrame:
    """At most max(3, ceil(max_cells / slices)) spots of each slice, with a seed of its own per slice."""
    n_slices = n_slices or spots.agg(F.count_distinct("slice")).first()[0]
    return _cap(spots, F.lit(max(3, math.ceil(max_cells / max(1, n_slices)))), seed, ["slice"])


def valid_label(column: str = "label") -> Column:
    return F.col(column).isNotNull() & ~F.lower(F.trim(column)).isin(INVALID_LABELS)


def top_detected(expr: DataFrame, k: int, column: str = "count") -> DataFrame:
    return expr.groupBy("gene").agg(F.count_if(F.col(column) > 0).alias("n_detected")).orderBy(
        F.desc("n_detected"), "gene").limit(k)


def dataset_inventory(ds: SpatialData) -> DataFrame:
    per_slice = ds.spots.groupBy("slice").agg(F.count("*").alias("n"))
    whole = ds.spots.agg(F.count_distinct("slice").alias("n_slices"), F.count("*").alias("n_spots"),
                         F.count_distinct("label").alias("n_labels"), (F.count("label") > 0).alias("has_labels"))
    spread = per_slice.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.avg("n").alias("c"))
    return whole.withColumns({
        "n_features": ds.genes.select(F.count("*")).scalar(),
        "min_spots_per_slice": spread.select("a").scalar(), "max_spots_per_slice": spread.select("b").scalar(),
        "mean_spots_per_slice": spread.select("c").scalar()})


def map_symbols(names: DataFrame, genes: DataFrame, column: str = "symbol", gene_name: str = "gene") -> DataFrame:
    """Case-insensitive match of a list against gene names; only a single hit counts as matched."""
    lookup = genes.groupBy(F.upper(gene_name).alias("_key")).agg(
        F.count("*").alias("n_matches"), F.min("gene").alias("gene_id"))
    joined = names.withColumn("_key", F.upper(column)).join(lookup, "_key", "left")
    n = F.coalesce("n_matches", F.lit(0))
    return joined.select(
        *names.columns, n.alias("n_matches"), F.when(n == 1, F.col("gene_id")).alias("gene"),
        F.when(n == 1, "matched").when(n == 0, "missing").otherwise("ambiguous").alias("status"))


def hex_centres(spots: DataFrame, pitch: float, radius: float) -> DataFrame:
    """Nearest centre of a staggered lattice for each bead: the rows above and below the bead hold the
    candidates, and in each row the rounded column is nearest, so no join with centres is needed.
    Centres whose disc leaves the bounding box of the slice do not exist."""
    dy = math.sqrt(3.0) * pitch / 2.0
    box = spots.groupBy("slice").agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                     F.min("y").alias("y0"), F.max("y").alias("y1"))
    row_lo, row_hi = F.ceil((F.col("y0") + radius) / dy), F.floor((F.col("y1") - radius) / dy)
    base = F.floor(F.col("y") / dy)
    options = []
    for k in (-1, 0, 1, 2):
        row = F.least(F.greatest(base + k, row_lo), row_hi)
        shift = F.pmod(row, F.lit(2)) * (pitch / 2.0)
        col_lo = F.ceil((F.col("x0") + radius - shift) / pitch)
        col_hi = F.floor((F.col("x1") - radius - shift) / pitch)
        col = F.least(F.greatest(F.round((F.col("x") - shift) / pitch).cast("bigint"), col_lo), col_hi)
        cx, cy = col * pitch + shift, row * dy
        dist = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
        options.append(F.when((row_lo <= row_hi) & (col_lo <= col_hi), F.struct(
            dist.alias("dist"), row.alias("hex_row"), col.alias("hex_col"), cx.alias("cx"), cy.alias("cy"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    return spots.join(box, "slice").withColumn("_c", best).select(
        *spots.columns, "_c.hex_row", "_c.hex_col", "_c.cx", "_c.cy", "_c.dist").filter(
        F.col("dist") <= radius + 1e-9)


def hex_pool(ds: SpatialData, pitch: float, radius: float, column: str = "count",
             check: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pool beads to pseudo-spots: (mapping, pseudo_spots, pooled counts). Beads without counts are dropped."""
    totals = ds.expr.groupBy("spot_id").agg(F.sum(column).alias("_t")).filter("_t > 0").select("spot_id")
    mapping = hex_centres(ds.spots, pitch, radius).join(totals, "spot_id", "left_semi").withColumn(
        "pseudo_spot", F.format_string("%s:r%d:c%d", "slice", "hex_row", "hex_col"))
    pseudo = mapping.groupBy("slice", "pseudo_spot").agg(
        F.first("cx").alias("x"), F.first("cy").alias("y"), F.count("*").alias("n_beads"))
    kept = ds.expr.join(mapping.select("spot_id", "pseudo_spot"), "spot_id")
    pooled = kept.groupBy("slice", "pseudo_spot", "gene").agg(F.sum(column).alias(column))
    if check:
        before = kept.groupBy("gene").agg(F.sum(column).alias("b"))
        after = pooled.groupBy("gene").agg(F.sum(column).alias("a"))
        assert_empty(before.join(after, "gene", "full").filter("NOT (a <=> b)"), "gene totals changed by pooling")
    return mapping, pseudo, pooled


def pool_audit(spots: DataFrame, mapping: DataFrame, pseudo: DataFrame) -> DataFrame:
    inputs = spots.groupBy("slice").agg(F.count("*").alias("input_beads"))
    kept = pseudo.groupBy("slice").agg(F.sum("n_beads").alias("retained_beads"), F.count("*").alias("pseudo_spots"))
    median = exact_quantiles(pseudo, "n_beads", ["slice"], {"median_beads": 0.5})
    return inputs.join(kept, "slice", "left").join(median, "slice", "left").select(
        "slice", "input_beads", F.coalesce("retained_beads", F.lit(0)).alias("retained_beads"),
        (F.coalesce("retained_beads", F.lit(0)) / F.col("input_beads")).alias("retained_fraction"),
        F.coalesce("pseudo_spots", F.lit(0)).alias("pseudo_spots"), "median_beads")


def calibrate_lattice(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least squares of metric (u, v) on native (x, y, 1) per slice, from normal-equation sums.
    Returns (coefficients with mean singular value and anisotropy, residual per point)."""
    # centred coordinates keep the 3x3 system well conditioned
    c = points.groupBy("slice").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(c, "slice").withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    s = p.groupBy("slice", "mx", "my").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(e).alias(k) for k, e in {
            "sx": F.col("dx"), "sy": F.col("dy"), "sxx": F.col("dx") ** 2, "syy": F.col("dy") ** 2,
            "sxy": F.col("dx") * F.col("dy"), "su": F.col("u"), "sv": F.col("v"),
            "sxu": F.col("dx") * F.col("u"), "syu": F.col("dy") * F.col("u"),
            "sxv": F.col("dx") * F.col("v"), "syv": F.col("dy") * F.col("v")}.items()])
    m = [[F.col("sxx"), F.col("sxy"), F.col("sx")], [F.col("sxy"), F.col("syy"), F.col("sy")],
         [F.col("sx"), F.col("sy"), F.col("n")]]
    a = solve3(m, [F.col("sxu"), F.col("syu"), F.col("su")])
    b = solve3(m, [F.col("sxv"), F.col("syv"), F.col("sv")])
    fit = s.select("slice", "mx", "my", "n", a[0].alias("a0"), a[1].alias("a1"), a[2].alias("a2"),
                   b[0].alias("b0"), b[1].alias("b1"), b[2].alias("b2"))
    # singular values of [[a0, b0], [a1, b1]]
    tr = F.col("a0") ** 2 + F.col("a1") ** 2 + F.col("b0") ** 2 + F.col("b1") ** 2
    det = F.col("a0") * F.col("b1") - F.col("a1") * F.col("b0")
    root = F.sqrt(F.greatest(tr * tr - 4 * det * det, F.lit(0.0)))
    fit = fit.withColumns({"s1": F.sqrt((tr + root) / 2), "s2": F.sqrt(F.greatest((tr - root) / 2, F.lit(0.0)))})
    fit = fit.withColumns({"unit_mean": (F.col("s1") + F.col("s2")) / 2, "anisotropy": ratio("s1", "s2")})
    res = points.join(fit, "slice").withColumn("residual", F.sqrt(
        (F.col("a0") * (F.col("x") - F.col("mx")) + F.col("a1") * (F.col("y") - F.col("my")) + F.col("a2") - F.col("u")) ** 2
        + (F.col("b0") * (F.col("x") - F.col("mx")) + F.col("b1") * (F.col("y") - F.col("my")) + F.col("b2") - F.col("v")) ** 2))
    return fit, res.select("slice", "spot_id", "residual")


def lattice_summary(points: DataFrame) -> DataFrame:
    fit, res = calibrate_lattice(points)
    spread = res.groupBy("slice").agg(F.max("residual").alias("max_residual")).join(
        exact_quantiles(res, "residual", ["slice"], {"median_residual": 0.5}), "slice")
    return fit.select("slice", F.col("n").cast("bigint").alias("n_observations"), "unit_mean", "anisotropy").join(
        spread, "slice")
