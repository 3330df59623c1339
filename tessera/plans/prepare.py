"""Queries over preparation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import prepare as P
from tessera.plans import fixtures as fx
from tessera.plans.registry import query


@query("resolve_counts", "SELECT slice, count(*) AS n, sum(count)::DOUBLE AS total FROM counts WHERE count <> 0 GROUP BY 1")
def _(spark, path):
    raw = fx.counts(spark, path).withColumnRenamed("count", "raw_count").withColumn("x", F.log1p("raw_count"))
    return P.resolve_counts(raw).groupBy("slice").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query("count_contract", """
    SELECT layer, count(*) AS n_values, round(min(v), 6) + 0 AS min_value, round(max(abs(v - round_even(v, 0))), 6) + 0 AS max_fraction,
           bool_and(v >= -1e-6 AND abs(v - round_even(v, 0)) <= 1e-6) AS count_like
    FROM (SELECT 'count' AS layer, count AS v FROM expr UNION ALL SELECT 'value', value FROM expr) GROUP BY 1""")
def _(spark, path):
    e = fx.expr(spark, path)
    out = [P.is_count_like(e, c).withColumn("layer", F.lit(c)) for c in ("count", "value")]
    return out[0].unionByName(out[1]).withColumns({"min_value": r6("min_value"), "max_fraction": r6("max_fraction")})


@query("filter_genes", """
    SELECT gene, count(*) AS n, sum(count)::DOUBLE AS total FROM counts
    WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) FILTER (count > 0) >= 190) GROUP BY 1""")
def _(spark, path):
    return P.filter_genes(fx.counts(spark, path), 190).groupBy("gene").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query("filter_spots", """
    SELECT spot_id, count(*) AS n, sum(count)::DOUBLE AS total FROM counts GROUP BY 1
    HAVING sum(count) >= 900 AND count(*) FILTER (count > 0) >= 30""")
def _(spark, path):
    return P.filter_spots(fx.counts(spark, path), 900, 30).groupBy("spot_id").agg(
        F.count("*").alias("n"), F.sum("count").alias("total"))


@query("normalize_total", """
    SELECT spot_id, gene, round(10000.0::DOUBLE * count / sum(count) OVER (PARTITION BY spot_id), 6) + 0 AS value FROM counts""")
def _(spark, path):
    return P.normalize_total(fx.counts(spark, path)).select("spot_id", "gene", r6("value").alias("value"))


@query("normalize_total_median", """
    WITH t AS (SELECT spot_id, sum(count) AS total FROM counts GROUP BY 1)
    SELECT spot_id, gene, round(count * (SELECT quantile_cont(total, 0.5) FROM t) / total, 6) + 0 AS value
    FROM counts JOIN t USING (spot_id)""")
def _(spark, path):
    return P.normalize_total(fx.counts(spark, path), None).select("spot_id", "gene", r6("value").alias("value"))


@query("log1p", "SELECT spot_id, gene, round(value, 6) + 0 AS value FROM expr")
def _(spark, path):
    return fx.expr(spark, path).select("spot_id", "gene", r6("value").alias("value"))


@query("scale", """
    WITH p AS (SELECT gene, sum(value) / n AS mean, sum(value * value) AS q, n FROM expr, (SELECT count(*)::DOUBLE AS n FROM spots) GROUP BY gene, n),
    s AS (SELECT gene, mean, CASE WHEN sd = 0 THEN 1 ELSE sd END AS sd FROM
          (SELECT gene, mean, sqrt(greatest((q - n * mean * mean) / (n - 1), 0)) AS sd FROM p))
    SELECT gene, round(mean, 6) + 0 AS mean, round(sd, 6) + 0 AS sd, round(least(-mean / sd, 10), 6) + 0 AS zero_scaled,
           round(sum(least((value - mean) / sd, 10)), 6) + 0 AS scaled_sum
    FROM expr JOIN s USING (gene) GROUP BY gene, mean, sd""")
def _(spark, path):
    entries, params = P.scale(fx.dataset(spark, path))
    sums = entries.groupBy("gene").agg(r6(F.sum("scaled")).alias("scaled_sum"))
    return params.join(sums, "gene").select("gene", r6("mean").alias("mean"), r6("sd").alias("sd"),
                                            r6("zero_scaled").alias("zero_scaled"), "scaled_sum")


@query("shift_nonnegative", """
    WITH d AS (SELECT gene, value - 8 AS v FROM expr), lo AS (SELECT least(min(v), 0) AS low FROM d)
    SELECT gene, round(sum(v - low), 6) + 0 AS total, round(min(v - low), 6) + 0 AS low, round(-any_value(low), 6) + 0 AS zero_value
    FROM d, lo GROUP BY gene""")
def _(spark, path):
    e = fx.expr(spark, path).withColumn("value", F.col("value") - 8)
    shifted, zero = P.shift_nonnegative(e)
    return shifted.groupBy("gene").agg(r6(F.sum("value")).alias("total"), r6(F.min("value")).alias("low")).withColumn(
        "zero_value", r6(zero.scalar()))


@query("pct_mito", """
    SELECT slice, spot_id, sum(count)::DOUBLE AS total,
           round(100 * sum(CASE WHEN gene LIKE 'SMALL-%' THEN count ELSE 0 END) / sum(count), 6) + 0 AS pct_mito
    FROM counts GROUP BY 1, 2""")
def _(spark, path):
    return P.pct_mito(fx.counts(spark, path), F.col("gene").startswith("SMALL-")).withColumn("pct_mito", r6("pct_mito"))


QC = """
    WITH t AS (SELECT s.spot_id, s.x, coalesce(sum(count), 0) AS total, 100 * sum(CASE WHEN gene LIKE 'SMALL-%' THEN count ELSE 0 END) / sum(count) AS pct
               FROM spots s LEFT JOIN counts USING (spot_id) GROUP BY 1, 2)"""


def _qc(spark, path):
    mito = P.pct_mito(fx.counts(spark, path), F.col("gene").startswith("SMALL-")).drop("slice")
    spots = fx.spots(spark, path).join(mito, "spot_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return spots, [("mask", F.col("x") != 0), ("min_total", F.col("total") >= 75),
                   ("max_total", F.col("total") <= 10000), ("mito", F.col("pct_mito") < 30)]


@query("qc_cascade", QC + """,
    f AS (SELECT CASE WHEN x = 0 THEN 0 WHEN total < 75 THEN 1 WHEN total > 10000 THEN 2 WHEN pct IS NULL OR pct >= 30 THEN 3 END AS step FROM t),
    r AS (SELECT s.step, s.rule, count(f.step) AS removed FROM (VALUES (0, 'mask'), (1, 'min_total'), (2, 'max_total'), (3, 'mito')) s(step, rule)
          LEFT JOIN f ON f.step = s.step GROUP BY 1, 2)
    SELECT step, rule, removed, (SELECT count(*) FROM t) - sum(removed) OVER (ORDER BY step)::BIGINT AS remaining FROM r""")
def _(spark, path):
    return P.qc_cascade(*_qc(spark, path))


@query("qc_keep", QC + " SELECT spot_id FROM t WHERE x <> 0 AND total >= 75 AND total <= 10000 AND pct < 30")
def _(spark, path):
    return P.qc_keep(*_qc(spark, path)).select("spot_id")


@query("filter_metadata", """
    SELECT spot_id, slice, label FROM spots WHERE slice IN ('BUILDING', 'FURNITURE') AND x > 3 AND label NOT IN ('ASIA', 'EUROPE')""")
def _(spark, path):
    return P.filter_metadata(fx.spots(spark, path), ["BUILDING", "FURNITURE"], F.col("x") > 3, ["ASIA", "EUROPE"]).select(
        "spot_id", "slice", "label")


@query("subset", """
    SELECT slice, label, gene, sum(count)::DOUBLE AS total FROM counts JOIN spots USING (spot_id, slice)
    WHERE slice IN ('AUTOMOBILE', 'MACHINERY') AND label IN (SELECT label FROM spots GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 2)
      AND gene LIKE 'PROMO-%' GROUP BY ALL""")
def _(spark, path):
    ds = P.subset_slices(fx.dataset(spark, path), ["AUTOMOBILE", "MACHINERY"], check=False)
    labels = fx.spots(spark, path).groupBy("label").count().orderBy(F.desc("count"), "label").limit(2).select("label")
    ds = P.subset_labels(ds, labels, check=False)
    ds = P.subset_features(ds, ds.genes.filter(F.col("gene").startswith("PROMO-")), check=False)
    return ds.expr.join(ds.spots.select("spot_id", "label"), "spot_id").groupBy("slice", "label", "gene").agg(F.sum("count").alias("total"))


CROP = """
    WITH b AS (SELECT slice, quantile_cont(x, 0.2) AS x0, quantile_cont(x, 0.8) AS x1, quantile_cont(y, 0.2) AS y0, quantile_cont(y, 0.8) AS y1
               FROM spots GROUP BY 1)"""


@query("quantile_crop", CROP + """
    SELECT slice, count(*) AS n_before, count(*) FILTER (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS n_after
    FROM spots JOIN b USING (slice) GROUP BY 1""")
def _(spark, path):
    s = fx.spots(spark, path)
    return P.crop_counts(s, P.quantile_crop(s, 0.2, 0.8))


@query("slice_class", "SELECT slice, slice_class, count(*) AS n FROM spots GROUP BY ALL")
def _(spark, path):
    return fx.spots(spark, path, True).groupBy("slice", "slice_class").agg(F.count("*").alias("n"))


@query("sample_spots", "SELECT spot_id, slice FROM spots ORDER BY md5('11|' || spot_id), spot_id LIMIT 100")
def _(spark, path):
    return P.sample_spots(fx.spots(spark, path), 100, 11).select("spot_id", "slice")


@query("sample_by_slice", """
    WITH c AS (SELECT spot_id, slice FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY md5('3|' || spot_id), spot_id) AS rn FROM spots)
               WHERE rn <= greatest(1, 93 // (SELECT count(DISTINCT slice) FROM spots)))
    SELECT spot_id, slice FROM c ORDER BY md5('3|' || spot_id), spot_id LIMIT 93""")
def _(spark, path):
    return P.sample_by_slice(fx.spots(spark, path), 93, 3).select("spot_id", "slice")


@query("cap_slices", """
    SELECT spot_id, slice FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY md5('5|' || slice || '|' || spot_id), spot_id) AS rn FROM spots)
    WHERE rn <= greatest(3, ceil(104 / (SELECT count(DISTINCT slice) FROM spots)))""")
def _(spark, path):
    return P.cap_slices(fx.spots(spark, path), 104, 5).select("spot_id", "slice")


@query("valid_label", """
    SELECT label, lower(trim(label)) NOT IN ('', 'nan', 'none', 'unknown', 'unassigned', 'na', 'n/a') AND label IS NOT NULL AS valid, count(*) AS n
    FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' ELSE c_mktsegment END AS label FROM customer) GROUP BY ALL""")
def _(spark, path):
    k = F.col("c_custkey") % 5
    label = F.when(k == 0, " Unknown ").when(k == 1, "N/A").when(k == 2, "").otherwise(F.col("c_mktsegment"))
    c = fx.table(spark, path, "customer").select(label.alias("label"))
    return c.withColumn("valid", P.valid_label()).groupBy("label", "valid").agg(F.count("*").alias("n"))


@query("top_detected", "SELECT gene, count(*) AS n_detected FROM counts WHERE count > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, path):
    return P.top_detected(fx.counts(spark, path), 50)


@query("dataset_inventory", """
    WITH s AS (SELECT slice, count(*) AS n FROM spots GROUP BY 1)
    SELECT count(DISTINCT slice) AS n_slices, count(*) AS n_spots, count(DISTINCT label) AS n_labels, count(label) > 0 AS has_labels,
           (SELECT count(*) FROM genes) AS n_features, (SELECT min(n) FROM s) AS min_spots_per_slice,
           (SELECT max(n) FROM s) AS max_spots_per_slice, (SELECT avg(n) FROM s) AS mean_spots_per_slice FROM spots""")
def _(spark, path):
    return P.dataset_inventory(fx.dataset(spark, path))


@query("map_symbols", """
    WITH m AS (SELECT upper(p_type) AS k, count(*) AS n, min(p_type || '-' || p_size) AS g FROM (SELECT DISTINCT p_type, p_size FROM part) GROUP BY 1
               UNION ALL SELECT upper(gene), count(*), min(gene) FROM genes GROUP BY 1)
    SELECT symbol, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN g END AS gene,
           CASE WHEN n = 1 THEN 'matched' WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS status
    FROM (SELECT DISTINCT lower(p_type) || '-' || p_size AS symbol FROM part UNION SELECT DISTINCT lower(p_type) FROM part
          UNION SELECT DISTINCT p_brand FROM part) LEFT JOIN m ON upper(symbol) = k""")
def _(spark, path):
    part = fx.table(spark, path, "part")
    names = part.select(F.lower(fx.gene_name()).alias("symbol")).union(part.select(F.lower("p_type"))).union(part.select("p_brand")).distinct()
    genes = fx.genes(spark, path)
    alias = part.select(fx.gene_name().alias("gene"), F.col("p_type").alias("gene_name")).distinct()
    return P.map_symbols(names, alias.unionByName(genes.select("gene", F.col("gene").alias("gene_name"))), gene_name="gene_name")


HEX = """
    WITH c AS (SELECT slice, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM spots GROUP BY 1),
    rws AS (SELECT *, unnest(range(ceil((y0 + 2.2) / (sqrt(3) * 2))::BIGINT, floor((y1 - 2.2) / (sqrt(3) * 2))::BIGINT + 1)) AS r FROM c),
    cen AS (SELECT slice, r, unnest(range(ceil((x0 + 2.2 - ((r % 2 + 2) % 2) * 2) / 4)::BIGINT, floor((x1 - 2.2 - ((r % 2 + 2) % 2) * 2) / 4)::BIGINT + 1)) AS col FROM rws),
    ctr AS (SELECT slice, r, col, col * 4.0::DOUBLE + ((r % 2 + 2) % 2) * 2.0::DOUBLE AS cx, r * sqrt(3) * 2 AS cy FROM cen),
    near AS (SELECT s.slice, s.spot_id, min(sqrt((s.x - cx) * (s.x - cx) + (s.y - cy) * (s.y - cy))) AS d FROM spots s JOIN ctr USING (slice) GROUP BY 1, 2),
    kept AS (SELECT * FROM near WHERE d <= 2.2 + 1e-9 AND spot_id IN (SELECT spot_id FROM counts GROUP BY 1 HAVING sum(count) > 0))"""


@query("hex_pool", HEX + """
    SELECT slice, gene, sum(count)::DOUBLE AS total, (SELECT round(sum(d), 6) FROM kept) AS distance_total
    FROM counts WHERE spot_id IN (SELECT spot_id FROM kept) GROUP BY 1, 2""")
def _(spark, path):
    ds = fx.dataset(spark, path)
    mapping, _, pooled = P.hex_pool(ds, 4.0, 2.2)
    return pooled.groupBy("slice", "gene").agg(F.sum("count").alias("total")).withColumn(
        "distance_total", r6(mapping.agg(F.sum("dist")).scalar()))


@query("hex_pool_audit", HEX + """,
    near2 AS (SELECT s.slice, s.spot_id, arg_min((r, col), sqrt((s.x - cx) * (s.x - cx) + (s.y - cy) * (s.y - cy)) + r * 1e-9 + col * 1e-12) AS k
              FROM spots s JOIN ctr USING (slice) WHERE s.spot_id IN (SELECT spot_id FROM kept) GROUP BY 1, 2),
    ps AS (SELECT slice, k, count(*) AS n FROM near2 GROUP BY 1, 2)
    SELECT slice, count(*) AS input_beads, (SELECT coalesce(sum(n), 0)::BIGINT FROM ps WHERE ps.slice = s.slice) AS retained_beads,
           round((SELECT coalesce(sum(n), 0)::BIGINT FROM ps WHERE ps.slice = s.slice) / count(*), 6) + 0 AS retained_fraction
    FROM spots s GROUP BY 1""")
def _(spark, path):
    ds = fx.dataset(spark, path)
    mapping, pseudo, _ = P.hex_pool(ds, 4.0, 2.2)
    return P.pool_audit(ds.spots, mapping, pseudo).select(
        "slice", "input_beads", "retained_beads", r6("retained_fraction").alias("retained_fraction"))


@query("calibrate_lattice", """
    WITH p AS (SELECT slice, spot_id, x, y, 50.0::DOUBLE * x + 2.0::DOUBLE * y + (spot_id % 7) AS u, 86.0::DOUBLE * y - 3.0::DOUBLE * x + (spot_id % 5) AS v FROM spots),
    m AS (SELECT slice, avg(x) mx, avg(y) my, avg(u) mu, avg(v) mv, covar_pop(x, x) sxx, covar_pop(y, y) syy, covar_pop(x, y) sxy,
                 covar_pop(x, u) sxu, covar_pop(y, u) syu, covar_pop(x, v) sxv, covar_pop(y, v) syv, count(*) AS n FROM p GROUP BY 1),
    f AS (SELECT *, (sxu * syy - syu * sxy) / (sxx * syy - sxy * sxy) AS a0, (syu * sxx - sxu * sxy) / (sxx * syy - sxy * sxy) AS a1,
                 (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) AS b0, (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) AS b1 FROM m),
    g AS (SELECT *, a0*a0 + a1*a1 + b0*b0 + b1*b1 AS tr, abs(a0*b1 - a1*b0) AS det FROM f),
    h AS (SELECT *, sqrt((tr + sqrt(greatest(tr*tr - 4*det*det, 0))) / 2) AS s1, sqrt(greatest((tr - sqrt(greatest(tr*tr - 4*det*det, 0))) / 2, 0)) AS s2 FROM g),
    r AS (SELECT p.slice, sqrt(pow(mu + a0 * (x - mx) + a1 * (y - my) - u, 2) + pow(mv + b0 * (x - mx) + b1 * (y - my) - v, 2)) AS res FROM p JOIN h USING (slice))
    SELECT slice, h.n AS n_observations, round((s1 + s2) / 2, 6) + 0 AS unit_mean, round(s1 / s2, 6) + 0 AS anisotropy,
           round(max(res), 6) + 0 AS max_residual, round(quantile_cont(res, 0.5), 6) + 0 AS median_residual
    FROM r JOIN h USING (slice) GROUP BY slice, h.n, s1, s2""")
def _(spark, path):
    p = fx.spots(spark, path).withColumns({
        "u": 50.0 * F.col("x") + 2.0 * F.col("y") + (F.col("spot_id") % 7),
        "v": 86.0 * F.col("y") - 3.0 * F.col("x") + (F.col("spot_id") % 5)})
    out = P.lattice_summary(p)
    return out.withColumns({c: r6(c) for c in ("unit_mean", "anisotropy", "max_residual", "median_residual")})
