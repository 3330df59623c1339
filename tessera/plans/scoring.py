"""Queries over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import scoring as S
from tessera.plans import fixtures as fx
from tessera.plans.registry import query

SET = ["dataset", "fs_method", "n_features", "integration_method"]
SETQ = "dataset, fs_method, n_features, integration_method"


def tables(spark, path):
    """The score tables from oriented records to setting scores."""
    o = S.orient(fx.records(spark, path))
    setting = S.seed_average(o)
    ranges = S.frozen_ranges(setting)
    seeds = S.seed_task_scores(S.apply_ranges(o, ranges, "oriented"))
    return o, setting, ranges, seeds


def core_scores(spark, path):
    seeds = tables(spark, path)[3]
    # rounded once: the same stored score is ranked everywhere
    return S.setting_scores(seeds).withColumns({f"{s}Mean": F.round(f"{s}Mean", 9) for s in S.SCORES})


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("metric_metadata", """
    SELECT metric_name, task_group, component, direction, needs_label, count(dataset) AS n_records, count(metric_value) AS n_values
    FROM metric_meta LEFT JOIN records USING (metric_name) GROUP BY 1, 2, 3, 4, 5""")
def _(spark, path):
    seen = fx.records(spark, path).groupBy("metric_name").agg(F.count("*").alias("n_records"), F.count("metric_value").alias("n_values"))
    return S.metric_metadata(spark).join(seen, "metric_name", "left").na.fill(0, ["n_records", "n_values"]).select(
        "metric_name", "task_group", "component", "direction", "needs_label", "n_records", "n_values")


@query("orient", f"SELECT {SETQ}, metric_name, random_seed, round(oriented, 6) + 0 AS oriented FROM oriented")
def _(spark, path):
    return S.orient(fx.records(spark, path)).select(*SET, "metric_name", "random_seed", r6("oriented").alias("oriented"))


@query("seed_average", f"""
    SELECT {SETQ}, task, metric_name, round(value_mean, 6) + 0 AS value_mean, round(value_sd, 6) + 0 AS value_sd, round(oriented_mean, 6) + 0 AS oriented_mean,
           n_seeds, effective_min, effective_max, round(runtime_mean, 6) + 0 AS runtime_mean FROM setting""")
def _(spark, path):
    return rounded(tables(spark, path)[1].drop("oriented_sd"), "value_mean", "value_sd", "oriented_mean", "runtime_mean")


@query("frozen_ranges", """
    SELECT dataset, task, metric_name, round(lower, 6) + 0 AS lower, round(upper, 6) + 0 AS upper, n_finite, status, round(denominator, 6) + 0 AS denominator FROM ranges""")
def _(spark, path):
    return rounded(tables(spark, path)[2].drop("range"), "lower", "upper", "denominator")


@query("scale_metrics", f"SELECT {SETQ}, task, metric_name, random_seed, round(scaled, 5) + 0 AS scaled FROM seed_scaled")
def _(spark, path):
    o, _, ranges, _ = tables(spark, path)
    return S.apply_ranges(o, ranges, "oriented").select(*SET, "task", "metric_name", "random_seed", (F.round("scaled", 5) + F.lit(0.0)).alias("scaled"))


PARTS = ["BatchMixing", "BiologicalConservation", "Integration", "LabelIndependentClustering", "LabelAgreement", "Clustering", "Alignment",
         "CoreOverall", "AlignmentEligibleOverall"]


@query("strict_and_available_mean", f"""
    WITH p AS (SELECT {SETQ}, random_seed, max(scaled) FILTER (metric_name = 'bASW') AS a, max(scaled) FILTER (metric_name = 'iLISI') AS b FROM seed_scaled GROUP BY ALL)
    SELECT {SETQ}, random_seed, round((a + b) / 2, 5) + 0 AS strict, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 5) + 0 AS available FROM p""")
def _(spark, path):
    from tessera.functions.numeric import mean_if_complete, mean_of_present

    o, _, ranges, _ = tables(spark, path)
    w = S.pivot_metrics(S.apply_ranges(o, ranges, "oriented"), [*SET, "random_seed"], "scaled")
    a, b = F.col("bASW"), F.col("iLISI")
    return w.select(*SET, "random_seed", (F.round(mean_if_complete(a, b), 5) + F.lit(0.0)).alias("strict"),
                    (F.round(mean_of_present(a, b), 5) + F.lit(0.0)).alias("available"))


@query("seed_task_scores", f"SELECT {SETQ}, random_seed, " + ", ".join(f"round({p}, 5) + 0 AS {p}" for p in PARTS) + " FROM seed_scores")
def _(spark, path):
    s = tables(spark, path)[3].drop("method_group")
    return s.withColumns({p: F.round(p, 5) + F.lit(0.0) for p in PARTS})


GROUPED = "CASE p_partkey % 6 WHEN 0 THEN 'morans_i' WHEN 1 THEN 'random' WHEN 2 THEN 'wilcoxon' WHEN 3 THEN 'TFs' WHEN 4 THEN 'nnsvg' ELSE p_brand END"
GROUP_SQL = """CASE WHEN m IN ('morans_i', 'sparkx', 'nnsvg', 'spatialde', 'somde') THEN 'spatially_informed' WHEN m IN ('all_features', 'random', 'TFs', 'scsegindex') THEN 'control'
    WHEN m = 'wilcoxon' THEN 'label_informed' ELSE 'expression_driven' END"""


@query("method_group", f"SELECT m AS fs_method, {GROUP_SQL} AS method_group, count(*) AS n FROM (SELECT {GROUPED} AS m FROM part) GROUP BY ALL")
def _(spark, path):
    return fx.table(spark, path, "part").select(F.expr(GROUPED).alias("fs_method")).withColumn("method_group", S.method_group()).groupBy(
        "fs_method", "method_group").agg(F.count("*").alias("n"))


@query("setting_scores", f"SELECT {SETQ}, " + ", ".join(
    f"round(avg({p}), 5) + 0 AS {p}Mean, round(stddev_samp({p}), 5) + 0 AS {p}SD, count({p}) AS {p}NSeeds" for p in PARTS) + " FROM seed_scores GROUP BY ALL")
def _(spark, path):
    s = S.setting_scores(tables(spark, path)[3]).drop("method_group")
    return s.withColumns({f"{p}{k}": F.round(f"{p}{k}", 5) + F.lit(0.0) for p in PARTS for k in ("Mean", "SD")})


REP = "SELECT DISTINCT dataset, fs_method, n_features FROM records WHERE effective_n_features >= 1 AND fs_method <> 'Brand#7'"


def _settings(spark, path):
    return fx.records(spark, path).filter("fs_method <> 'Brand#7'").select("dataset", "fs_method", "n_features").distinct()


@query("representative", f"""
    WITH s AS ({REP}) SELECT {SETQ}, round(CoreOverallMean, 5) + 0 AS CoreOverallMean FROM core_scores SEMI JOIN s USING (dataset, fs_method, n_features)""")
def _(spark, path):
    r = S.representative(core_scores(spark, path), _settings(spark, path))
    return r.select(*SET, (F.round("CoreOverallMean", 5) + F.lit(0.0)).alias("CoreOverallMean"))


@query("dataset_ranks", f"SELECT {SETQ}, core_rank AS \"CoreOverallRank\" FROM core_ranked")
def _(spark, path):
    return S.dataset_ranks(core_scores(spark, path)).select(*SET, "CoreOverallRank")


GLOBAL = """
    g AS (SELECT fs_method, integration_method, avg(CoreOverallMean) AS score, round(avg(core_rank), 9) AS mr, stddev_samp(core_rank) AS sd, count(core_rank) AS n
          FROM {src} GROUP BY 1, 2)
    SELECT fs_method, integration_method, round(score, 5) + 0 AS "MeanCoreOverallScore", round(mr, 5) + 0 AS "MeanCoreOverallRank", round(sd, 5) + 0 AS "SDCoreOverallRank",
           n AS "NCoreOverallDatasets", CASE WHEN mr IS NOT NULL THEN rank() OVER (PARTITION BY integration_method ORDER BY mr NULLS LAST)
             + (count(*) OVER (PARTITION BY integration_method, mr) - 1) / 2.0::DOUBLE END AS "GlobalCoreOverallRank" FROM g"""


def _global(df):
    cols = ["MeanCoreOverallScore", "MeanCoreOverallRank", "SDCoreOverallRank"]
    return df.select("fs_method", "integration_method", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in cols], "NCoreOverallDatasets", "GlobalCoreOverallRank")


@query("global_ranks", "WITH " + GLOBAL.format(src="core_ranked"))
def _(spark, path):
    return _global(S.global_ranks(S.dataset_ranks(core_scores(spark, path))))


RENAMED = "CASE fs_method WHEN 'Brand#1' THEN 'all_features' WHEN 'Brand#2' THEN 'random' WHEN 'Brand#3' THEN 'wilcoxon' WHEN 'Brand#4' THEN 'morans_i' ELSE fs_method END"


@query("competitive_ranks", """
    WITH c AS (SELECT * REPLACE (CASE WHEN fs_method = 'Brand#4' THEN 'morans_i' ELSE fs_method END AS fs_method) FROM core_scores WHERE fs_method NOT IN ('Brand#1', 'Brand#2', 'Brand#3')),
    cr AS (SELECT *, CASE WHEN CoreOverallMean IS NOT NULL THEN rank() OVER (PARTITION BY dataset, integration_method ORDER BY CoreOverallMean DESC NULLS LAST)
            + (count(*) OVER (PARTITION BY dataset, integration_method, CoreOverallMean) - 1) / 2.0::DOUBLE END AS core_rank FROM c),""" + GLOBAL.format(src="cr"))
def _(spark, path):
    s = core_scores(spark, path).withColumn("fs_method", F.expr(RENAMED)).withColumn("method_group", S.method_group())
    return _global(S.global_ranks(S.dataset_ranks(S.competitive(s))))


LONG = "SELECT dataset, integration_method, fs_method, metric_name, component, avg(oriented) AS value FROM oriented GROUP BY ALL"


@query("baseline_overall", f"""
    WITH l AS ({LONG}), b AS (SELECT dataset, metric_name, min(value) AS lo, max(value) AS hi FROM l WHERE fs_method IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5') GROUP BY 1, 2),
    z AS (SELECT l.*, CASE WHEN value IS NULL THEN NULL WHEN hi = lo THEN 1 ELSE greatest(0, least(1, (value - lo) / nullif(hi - lo, 0))) END AS z FROM l JOIN b USING (dataset, metric_name)),
    t AS (SELECT dataset, fs_method, integration_method, avg(z) FILTER (component = 'BatchMixing') AS b, avg(z) FILTER (component = 'BiologicalConservation') AS c FROM z GROUP BY 1, 2, 3)
    SELECT dataset, fs_method, integration_method, round(CASE WHEN b IS NOT NULL THEN (0.4 * b + CASE WHEN c IS NULL THEN 0 ELSE 0.6 * c END) / (0.4 + CASE WHEN c IS NULL THEN 0 ELSE 0.6 END) END, 5) + 0 AS overall FROM t""")
def _(spark, path):
    long = S.orient(fx.records(spark, path)).groupBy("dataset", "integration_method", "fs_method", "metric_name", F.col("component").alias("metric_type")).agg(
        F.avg("oriented").alias("value"))
    out = S.baseline_overall(long, {"BatchMixing": 0.4, "BiologicalConservation": 0.6}, ["BatchMixing"], ["Brand#1", "Brand#2", "Brand#3", "Brand#5"])
    return out.select("dataset", "fs_method", "integration_method", (F.round("overall", 5) + F.lit(0.0)).alias("overall"))


@query("adapt_long", """
    SELECT dataset, integration_method, random_seed, metric_name, component AS metric_type, fs_method || '-N' || n_features AS method_key, fs_method AS method_label, round(oriented, 6) + 0 AS value FROM oriented""")
def _(spark, path):
    return rounded(S.adapt_long(fx.records(spark, path)), "value")


CELLS = ["F|Integration|iLISI", "O|Integration|iLISI", "F|Clustering|PAS", "O|Alignment|Ratio"]


@query("performance_matrix", "SELECT fs_method, " + ", ".join(
    f"round(avg(metric_value) FILTER (integration_method || '|' || task || '|' || metric_name = '{c}'), 6) + 0 AS \"{c}\"" for c in CELLS) + " FROM records GROUP BY 1")
def _(spark, path):
    return rounded(S.performance_matrix(fx.records(spark, path), CELLS), *CELLS)


@query("budget_profile", """
    WITH z AS (SELECT dataset, effective_n_features AS n, metric_value AS v, avg(metric_value) OVER w AS m, stddev_samp(metric_value) OVER w AS sd
               FROM records WINDOW w AS (PARTITION BY dataset, fs_method, integration_method, task))
    SELECT n AS n_features, round(avg(CASE WHEN sd > 0 THEN (v - m) / sd END), 5) + 0 AS mean_z, round(stddev_samp(CASE WHEN sd > 0 THEN (v - m) / sd END), 5) + 0 AS sd_z,
           count(CASE WHEN sd > 0 THEN (v - m) / sd END) AS n FROM z GROUP BY 1""")
def _(spark, path):
    r = fx.records(spark, path).withColumn("n_features", F.col("effective_n_features"))
    out = S.budget_profile(r, "metric_value", ["dataset", "fs_method", "integration_method", "task"])
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("mean_z", "sd_z")})


@query("best_setting", """
    WITH r AS (SELECT *, rank() OVER (PARTITION BY dataset, integration_method ORDER BY CoreOverallMean DESC) AS p FROM core_scores WHERE CoreOverallMean IS NOT NULL)
    SELECT dataset, integration_method, fs_method, round(CoreOverallMean, 5) + 0 AS score FROM r WHERE p = 1""")
def _(spark, path):
    b = S.best_setting(core_scores(spark, path), ["dataset", "integration_method"], "CoreOverallMean")
    return b.select("dataset", "integration_method", "fs_method", (F.round("CoreOverallMean", 5) + F.lit(0.0)).alias("score"))


@query("difference_from", """
    SELECT a.dataset, a.fs_method, a.n_features, a.integration_method, round(a.CoreOverallMean - b.CoreOverallMean, 5) + 0 AS difference
    FROM core_scores a JOIN core_scores b USING (dataset, fs_method, n_features) WHERE a.integration_method = 'O' AND b.integration_method = 'F'""")
def _(spark, path):
    d = S.difference_from(core_scores(spark, path), ["dataset", "fs_method", "n_features"], "integration_method", "F", "CoreOverallMean")
    return d.select(*SET, (F.round("difference", 5) + F.lit(0.0)).alias("difference"))


@query("diff_from_best_parent", """
    WITH p AS (SELECT dataset, integration_method, max(CoreOverallMean) AS b FROM core_scores WHERE fs_method IN ('Brand#2', 'Brand#3') GROUP BY 1, 2)
    SELECT dataset, integration_method, round(CoreOverallMean, 5) + 0 AS child_value, round(b, 5) + 0 AS best_parent, round(CoreOverallMean - b, 5) + 0 AS difference
    FROM core_scores JOIN p USING (dataset, integration_method) WHERE fs_method = 'Brand#4'""")
def _(spark, path):
    d = S.diff_from_best_parent(core_scores(spark, path), ["dataset", "integration_method"], "Brand#4", ["Brand#2", "Brand#3"], "CoreOverallMean")
    return d.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("child_value", "best_parent", "difference")})


@query("apply_frozen", f"""
    WITH old AS (SELECT * FROM setting WHERE fs_method <> 'Brand#9'), r AS (SELECT dataset, task, metric_name, min(oriented_mean) AS lo, max(oriented_mean) AS hi FROM old GROUP BY 1, 2, 3)
    SELECT {SETQ}, task, metric_name, round((oriented_mean - lo) / nullif(hi - lo, 0), 5) + 0 AS scaled FROM setting LEFT JOIN r USING (dataset, task, metric_name) WHERE fs_method = 'Brand#9'""")
def _(spark, path):
    setting = tables(spark, path)[1]
    stored = S.frozen_ranges(setting.filter("fs_method <> 'Brand#9'"))
    out = S.apply_ranges(setting.filter("fs_method = 'Brand#9'"), stored, "oriented_mean")
    return out.select(*SET, "task", "metric_name", (F.round("scaled", 5) + F.lit(0.0)).alias("scaled"))


@query("control_position", """
    WITH c AS (SELECT * FROM core_scores WHERE fs_method NOT IN ('Brand#1', 'Brand#2') AND CoreOverallMean IS NOT NULL),
    k AS (SELECT o.dataset, o.integration_method, o.fs_method, o.CoreOverallMean AS v, count(*) AS n, count(*) FILTER (c.CoreOverallMean > o.CoreOverallMean) AS up,
                 count(*) FILTER (c.CoreOverallMean < o.CoreOverallMean) AS dn, count(*) FILTER (c.CoreOverallMean = o.CoreOverallMean) AS eq, quantile_cont(c.CoreOverallMean, 0.5) AS med
          FROM core_scores o JOIN c USING (dataset, integration_method) WHERE o.fs_method IN ('Brand#1', 'Brand#2') GROUP BY 1, 2, 3, 4)
    SELECT dataset, integration_method, fs_method, n AS n_competitors, CASE WHEN v IS NOT NULL THEN 1 + up END AS position,
           round(CASE WHEN v IS NOT NULL THEN (dn + 0.5 * eq) / n END, 6) + 0 AS mid_percentile, round(v - med, 5) + 0 AS difference_vs_median FROM k""")
def _(spark, path):
    out = S.control_position(core_scores(spark, path), ["Brand#1", "Brand#2"], "CoreOverallMean").drop("control_value")
    return out.withColumns({"mid_percentile": r6("mid_percentile"), "difference_vs_median": F.round("difference_vs_median", 5) + F.lit(0.0)})


@query("seed_variability", f"""
    WITH l AS (UNPIVOT (SELECT {SETQ}, random_seed, Integration, Clustering, CoreOverall FROM seed_scores) ON Integration, Clustering, CoreOverall INTO NAME task VALUE score),
    s AS (SELECT dataset, task, stddev_samp(score) AS sd FROM l GROUP BY {SETQ}, task)
    SELECT dataset, task, count(sd) AS n_settings, round(quantile_cont(sd, 0.5), 5) + 0 AS median_sd, round(quantile_cont(sd, 0.9), 5) + 0 AS q90_sd FROM s WHERE sd IS NOT NULL GROUP BY 1, 2""")
def _(spark, path):
    out = S.seed_variability(tables(spark, path)[3], ["Integration", "Clustering", "CoreOverall"])
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("median_sd", "q90_sd")})


ENDPOINT = """
    WITH m AS (SELECT dataset AS arm, fs_method, integration_method, metric_name, round(value_mean, 9) AS mean FROM setting WHERE value_mean IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY arm, integration_method, metric_name ORDER BY CASE WHEN metric_name IN ('CHAOS', 'PAS') THEN -mean ELSE mean END DESC)
            + (count(*) OVER (PARTITION BY arm, integration_method, metric_name, mean) - 1) / 2.0::DOUBLE AS rank FROM m)"""


def _endpoint(spark, path):
    m = tables(spark, path)[1].filter("value_mean IS NOT NULL").select(
        F.col("dataset").alias("arm"), "fs_method", "integration_method", "metric_name", F.round("value_mean", 9).alias("mean"))
    return S.endpoint_ranks(m, "mean", ["arm", "integration_method", "metric_name"], ["CHAOS", "PAS"])


@query("endpoint_ranks", ENDPOINT + " SELECT arm, fs_method, integration_method, metric_name, rank FROM r")
def _(spark, path):
    return _endpoint(spark, path).select("arm", "fs_method", "integration_method", "metric_name", "rank")


@query("arm_comparison", ENDPOINT + """,
    w AS (SELECT a.integration_method, a.metric_name, a.arm AS first, b.arm AS second, a.fs_method, a.rank AS a, b.rank AS b FROM r a JOIN r b USING (integration_method, metric_name, fs_method) WHERE a.arm < b.arm),
    p AS (SELECT *, rank() OVER (PARTITION BY integration_method, metric_name, first, second ORDER BY a) <= 5 AS ta, rank() OVER (PARTITION BY integration_method, metric_name, first, second ORDER BY b) <= 5 AS tb,
            rank() OVER (PARTITION BY integration_method, metric_name, first, second ORDER BY a) + (count(*) OVER (PARTITION BY integration_method, metric_name, first, second, a) - 1) / 2.0::DOUBLE AS ra,
            rank() OVER (PARTITION BY integration_method, metric_name, first, second ORDER BY b) + (count(*) OVER (PARTITION BY integration_method, metric_name, first, second, b) - 1) / 2.0::DOUBLE AS rb FROM w)
    SELECT integration_method, metric_name, first, second, count(*) AS n_methods, round(corr(ra, rb), 6) + 0 AS rank_rho, round(quantile_cont(abs(b - a), 0.5), 6) + 0 AS median_abs_shift,
           count(*) FILTER (ta AND tb) AS top_overlap, count(*) FILTER (ta) AS top_first, count(*) FILTER (tb) AS top_second FROM p GROUP BY 1, 2, 3, 4""")
def _(spark, path):
    out = S.arm_comparisons(_endpoint(spark, path), "arm", ["integration_method", "metric_name"])
    return rounded(out, "rank_rho", "median_abs_shift")


@query("summarize_results", f"SELECT {SETQ}, task, metric_name, round(avg(metric_value), 6) + 0 AS mean, round(stddev_samp(metric_value), 6) + 0 AS sd, count(metric_value) AS n FROM records GROUP BY ALL")
def _(spark, path):
    return rounded(S.summarize_results(fx.records(spark, path)), "mean", "sd")


@query("contrast_pick", """
    WITH m AS (SELECT dataset, integration_method, n_features, fs_method, round(avg(oriented), 9) AS s FROM oriented GROUP BY 1, 2, 3, 4 HAVING avg(oriented) IS NOT NULL),
    c AS (SELECT dataset, integration_method, n_features, round(avg(s), 9) AS ms FROM m GROUP BY 1, 2, 3),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ms DESC, integration_method, n_features) AS r FROM c) WHERE r = 1)
    SELECT dataset, integration_method, n_features, round(ms, 6) + 0 AS mean_score, arg_max(fs_method, (s, fs_method)) AS best_method, round(max(s), 6) + 0 AS best_score,
           arg_min(fs_method, (s, fs_method)) AS worst_method, round(min(s), 6) + 0 AS worst_score FROM m JOIN p USING (dataset, integration_method, n_features) GROUP BY 1, 2, 3, 4""")
def _(spark, path):
    return rounded(S.contrast_pick(fx.records(spark, path)), "mean_score", "best_score", "worst_score")


@query("rerank_with", """
    WITH n AS (SELECT * REPLACE (CASE WHEN fs_method IN ('Brand#5', 'Brand#6') AND dataset <> 'MACHINERY' THEN round(1 - CoreOverallMean, 9) ELSE CoreOverallMean END AS CoreOverallMean) FROM core_scores),
    rk AS (SELECT fs_method, integration_method, core_rank AS a, NULL AS b FROM core_ranked UNION ALL
           SELECT fs_method, integration_method, NULL, CASE WHEN CoreOverallMean IS NOT NULL THEN rank() OVER (PARTITION BY dataset, integration_method ORDER BY CoreOverallMean DESC NULLS LAST)
             + (count(*) OVER (PARTITION BY dataset, integration_method, CoreOverallMean) - 1) / 2.0::DOUBLE END FROM n),
    m AS (SELECT fs_method, integration_method, round(avg(a), 9) AS a, round(avg(b), 9) AS b FROM rk GROUP BY 1, 2),
    g AS (SELECT *, CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY integration_method ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY integration_method, a) - 1) / 2.0::DOUBLE END AS ra,
                 CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY integration_method ORDER BY b NULLS LAST) + (count(*) OVER (PARTITION BY integration_method, b) - 1) / 2.0::DOUBLE END AS rb FROM m)
    SELECT fs_method, integration_method, ra AS before_rank, rb AS after_rank, rb - ra AS rank_change FROM g""")
def _(spark, path):
    base = core_scores(spark, path)
    new = base.filter(F.col("fs_method").isin("Brand#5", "Brand#6") & (F.col("dataset") != "MACHINERY")).withColumn(
        "CoreOverallMean", F.round(1 - F.col("CoreOverallMean"), 9))
    return S.rerank_with(base, new).select("fs_method", "integration_method", "before_rank", "after_rank", "rank_change")
