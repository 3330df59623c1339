"""Queries over scaling alternatives, concordance and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.functions.ranks import spearman
from tessera.operators import robust as J
from tessera.operators import scoring as S
from tessera.plans import fixtures as fx
from tessera.plans.registry import query
from tessera.plans.scoring import SETQ, core_scores, tables

LABELLED = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def r5(df, *cols):
    return df.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in cols})


ALT = """
    al AS (SELECT *, CASE WHEN oriented_mean IS NOT NULL THEN (rank() OVER (PARTITION BY dataset, task, metric_name ORDER BY round(oriented_mean, 12) NULLS LAST)
             + (count(*) OVER (PARTITION BY dataset, task, metric_name, round(oriented_mean, 12)) - 1) / 2.0::DOUBLE - 1) / greatest(count(oriented_mean) OVER w - 1, 1) END AS rank_scaled,
             (oriented_mean - avg(oriented_mean) OVER w) / nullif(stddev_pop(oriented_mean) OVER w, 0) AS z_scaled FROM setting_scaled WINDOW w AS (PARTITION BY dataset, task, metric_name))"""


def scaled(spark, path):
    _, setting, ranges, _ = tables(spark, path)
    return J.alt_scaling(S.apply_ranges(setting, ranges, "oriented_mean"))


@query("alt_scaling", "WITH " + ALT + f" SELECT {SETQ}, metric_name, round(rank_scaled, 5) + 0 AS rank_scaled, round(z_scaled, 5) + 0 AS z_scaled FROM al")
def _(spark, path):
    return r5(scaled(spark, path).select(*S.SETTING, "metric_name", "rank_scaled", "z_scaled"), "rank_scaled", "z_scaled")


def core_sql(value: str, w: str = "0.5, 0.5, 0.5") -> str:
    """Weighted core score per setting from `al`."""
    a, b, c = [x.strip() + "::DOUBLE" if "." in x else x.strip() for x in w.split(",")]
    parts = ", ".join(f"CASE WHEN count({value}) FILTER (metric_name IN ({names})) = {n} THEN avg({value}) FILTER (metric_name IN ({names})) END AS {p}" for p, n, names in (
        ("bm", 2, "'bASW','iLISI'"), ("bc", 4, "'dASW','dLISI','ILL','GC'"), ("li", 3, "'silhouette','CHAOS','PAS'"), ("la", 2, "'ari','nmi'")))

    def wa(x: str, y: str, k: str) -> str:
        return (f"(coalesce({x} * {k}, 0) + coalesce({y} * (1 - {k}), 0)) / nullif(CASE WHEN {x} IS NOT NULL THEN {k} ELSE 0 END + CASE WHEN {y} IS NOT NULL THEN 1 - {k} ELSE 0 END, 0)")

    return f"""SELECT *, round({wa('it', 'cl', c)}, 9) AS core FROM (SELECT *, {wa('bm', 'bc', a)} AS it, {wa('li', 'la', b)} AS cl FROM
        (SELECT {SETQ}, {parts} FROM al GROUP BY ALL))"""


@query("weighted_available", "WITH " + ALT + f", c AS ({core_sql('scaled', '0.6, 0.6, 0.6')}) SELECT {SETQ}, round(it, 5) + 0 AS \"Integration\", round(cl, 5) + 0 AS \"Clustering\", round(core, 5) + 0 AS \"CoreOverall\" FROM c")
def _(spark, path):
    return r5(J.task_scores(scaled(spark, path), "scaled", (0.6, 0.6, 0.6)).select(*S.SETTING, "Integration", "Clustering", "CoreOverall"),
              "Integration", "Clustering", "CoreOverall")


def _scenario_sql() -> str:
    parts = []
    for name, (value, w, only) in J.SCENARIOS.items():
        where = " WHERE dataset IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD')" if only else ""
        parts.append(f"SELECT '{name}' AS scenario, dataset, fs_method, integration_method, core FROM ({core_sql(value, ', '.join(map(str, w)))}){where}")
    return "WITH " + ALT + ", sc AS (" + " UNION ALL ".join(parts) + """),
    dr AS (SELECT *, CASE WHEN core IS NOT NULL THEN rank() OVER (PARTITION BY scenario, integration_method, dataset ORDER BY core DESC NULLS LAST)
             + (count(*) OVER (PARTITION BY scenario, integration_method, dataset, core) - 1) / 2.0::DOUBLE END AS r FROM sc),
    gm AS (SELECT scenario, integration_method, fs_method, round(avg(r), 9) AS m, avg(core) AS s, count(DISTINCT dataset) AS n FROM dr GROUP BY 1, 2, 3),
    gr AS (SELECT *, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY scenario, integration_method ORDER BY m NULLS LAST) + (count(*) OVER (PARTITION BY scenario, integration_method, m) - 1) / 2.0::DOUBLE END AS g FROM gm)"""


@query("scenario_ranks", _scenario_sql() + """
    SELECT scenario, integration_method, fs_method, round(m, 5) + 0 AS mean_dataset_rank, round(s, 5) + 0 AS mean_score, n AS n_datasets, g AS global_rank FROM gr""")
def _(spark, path):
    return r5(J.scenario_ranks(scaled(spark, path), LABELLED), "mean_dataset_rank", "mean_score")


FULL = """,
    fu AS (SELECT gr.* FROM gr WHERE (integration_method, fs_method) IN (SELECT (integration_method, fs_method) FROM gr WHERE g IS NOT NULL GROUP BY integration_method, fs_method HAVING count(*) = 6))"""


@query("kendalls_w", _scenario_sql() + FULL + """,
    s AS (SELECT integration_method, fs_method, sum(g) AS s FROM fu GROUP BY 1, 2), a AS (SELECT integration_method, var_pop(s) * count(*) AS ss, count(*)::DOUBLE AS n FROM s GROUP BY 1),
    t AS (SELECT integration_method, sum(c * c * c - c) AS t FROM (SELECT integration_method, scenario, g, count(*)::DOUBLE AS c FROM fu GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT integration_method, 6::BIGINT AS n_raters, n::BIGINT AS n_items, round(12 * ss / (36 * (n * n * n - n) - 6 * t), 6) + 0 AS kendalls_w FROM a JOIN t USING (integration_method)""")
def _(spark, path):
    ranks = J.scenario_ranks(scaled(spark, path), LABELLED)
    return J.kendalls_w(ranks, "scenario", "fs_method", "global_rank", ["integration_method"]).withColumn("kendalls_w", r6("kendalls_w"))


def spearman_sql(source: str, keys: str, x: str = "x", y: str = "y") -> str:
    """Spearman per key from rows with both values."""
    return f"""
    sp AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0::DOUBLE AS ry FROM ({source}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
    so AS (SELECT {keys}, round(CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END, 6) + 0 AS rho, count(*) AS n FROM sp GROUP BY {keys})"""


@query("concordance", _scenario_sql() + FULL + "," + spearman_sql(
    "SELECT a.integration_method, a.scenario AS first, b.scenario AS second, a.g AS x, b.g AS y FROM fu a JOIN fu b USING (integration_method, fs_method) WHERE a.scenario < b.scenario",
    "integration_method, first, second") + " SELECT * FROM so")
def _(spark, path):
    ranks = J.scenario_ranks(scaled(spark, path), LABELLED)
    return J.concordance(ranks, "scenario", "fs_method", "global_rank", ["integration_method"]).withColumn("rho", r6("rho"))


@query("spearman", "WITH " + spearman_sql("SELECT dataset, metric_name, runtime AS x, metric_value AS y FROM records", "dataset, metric_name") + " SELECT * FROM so")
def _(spark, path):
    return spearman(fx.records(spark, path), "runtime", "metric_value", ["dataset", "metric_name"], "rho").withColumn("rho", r6("rho"))


def draws_sql(units: str, by: str, unit: str, n: int, seed: int) -> str:
    """CTEs of hashed resamples: `wt`(by, draw, unit, weight)."""
    return f"""
    un AS (SELECT {by}, list_sort(list(DISTINCT {unit})) AS u FROM ({units}) GROUP BY {by}),
    sl AS (SELECT {by}, draw, u[1 + floor(('0x' || substr(md5('{seed}|' || draw || '|' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * len(u))::INT] AS {unit}
           FROM (SELECT {by}, u, draw, unnest(range(len(u))) AS k FROM un, (SELECT unnest(range({n})) AS draw))),
    wt AS (SELECT {by}, draw, {unit}, count(*) AS weight FROM sl GROUP BY ALL)"""


BOOT_X = "SELECT metric_name || '/' || integration_method AS side, dataset || '-' || fs_method AS cl, round(runtime, 9) AS x, metric_value AS y FROM records WHERE metric_value IS NOT NULL"


@query("bootstrap_spearman", f"WITH bx AS ({BOOT_X}), " + draws_sql("SELECT * FROM bx", "side", "cl", 5000, 3) + """,
    ex AS (SELECT bx.side, draw, x, y FROM bx JOIN wt ON wt.side = bx.side AND wt.cl = bx.cl, range(100) g(i) WHERE i < weight),
    er AS (SELECT *, rank() OVER (PARTITION BY side, draw ORDER BY x) + (count(*) OVER (PARTITION BY side, draw, x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY side, draw ORDER BY y) + (count(*) OVER (PARTITION BY side, draw, y) - 1) / 2.0::DOUBLE AS ry FROM ex),
    es AS (SELECT side, draw, corr(rx, ry) AS r FROM er GROUP BY 1, 2),
    ci AS (SELECT side, round(quantile_cont(r, 0.025), 6) + 0 AS lower, round(quantile_cont(r, 0.975), 6) + 0 AS upper, count(r) AS n_draws FROM es GROUP BY 1),""" + spearman_sql("SELECT * FROM bx", "side")
       + " SELECT side, n, rho, lower, upper, n_draws FROM so JOIN ci USING (side)")
def _(spark, path):
    d = fx.records(spark, path).filter("metric_value IS NOT NULL").select(
        F.concat_ws("/", "metric_name", "integration_method").alias("side"), F.concat_ws("-", "dataset", "fs_method").alias("cl"),
        F.round("runtime", 9).alias("x"), F.col("metric_value").alias("y"))
    out = J.bootstrap_spearman(d, "x", "y", "cl", 5000, 3, ["side"])
    return out.withColumns({c: r6(c) for c in ("rho", "lower", "upper")})


SUMMARY = """
    SELECT integration_method, fs_method, round(quantile_cont(rank, 0.5), 5) + 0 AS median_rank, round(quantile_cont(rank, 0.25), 5) + 0 AS q25_rank, round(quantile_cont(rank, 0.75), 5) + 0 AS q75_rank,
           round(quantile_cont(rank, 0.025), 5) + 0 AS lower_rank, round(quantile_cont(rank, 0.975), 5) + 0 AS upper_rank, round(avg((rank <= 5)::INT), 5) + 0 AS top5_probability
    FROM rk GROUP BY 1, 2"""
SUMMARY_COLS = ["median_rank", "q25_rank", "q75_rank", "lower_rank", "upper_rank", "top5_probability"]
RANK_DRAWS = """
    md AS (SELECT integration_method, draw, fs_method, round(sum(core_rank * weight) / sum(weight), 9) AS m FROM core_ranked JOIN wt USING (integration_method, dataset) WHERE core_rank IS NOT NULL GROUP BY 1, 2, 3),
    rk AS (SELECT *, rank() OVER (PARTITION BY integration_method, draw ORDER BY m) + (count(*) OVER (PARTITION BY integration_method, draw, m) - 1) / 2.0::DOUBLE AS rank FROM md)"""


@query("bootstrap_ranks", "WITH " + draws_sql("SELECT * FROM core_ranked WHERE core_rank IS NOT NULL", "integration_method", "dataset", 5000, 9) + "," + RANK_DRAWS + SUMMARY)
def _(spark, path):
    return r5(J.bootstrap_ranks(core_scores(spark, path), 5000, 9), *SUMMARY_COLS)


@query("exact_bootstrap_ranks", """
    WITH un AS (SELECT integration_method, list_sort(list(DISTINCT dataset)) AS u FROM core_ranked WHERE core_rank IS NOT NULL GROUP BY 1),
    sl AS (SELECT integration_method, draw, u[1 + (draw // pow(len(u), k)::BIGINT) % len(u)] AS dataset FROM (SELECT integration_method, u, draw, unnest(range(len(u))) AS k
             FROM (SELECT integration_method, u, unnest(range(pow(len(u), len(u))::BIGINT)) AS draw FROM un))),
    wt AS (SELECT integration_method, draw, dataset, count(*) AS weight FROM sl GROUP BY 1, 2, 3),""" + RANK_DRAWS + SUMMARY)
def _(spark, path):
    return r5(J.exact_bootstrap_ranks(core_scores(spark, path)), *SUMMARY_COLS)


@query("leave_one_out_ranks", """
    WITH un AS (SELECT DISTINCT integration_method, dataset AS omitted FROM core_ranked WHERE core_rank IS NOT NULL),
    m AS (SELECT c.integration_method, omitted, fs_method, round(avg(core_rank), 9) AS m FROM core_ranked c JOIN un ON un.integration_method = c.integration_method AND omitted <> dataset WHERE core_rank IS NOT NULL GROUP BY 1, 2, 3),
    g AS (SELECT *, rank() OVER (PARTITION BY integration_method, omitted ORDER BY m) + (count(*) OVER (PARTITION BY integration_method, omitted, m) - 1) / 2.0::DOUBLE AS r FROM m)
    SELECT integration_method, fs_method, min(r) AS min_rank, max(r) AS max_rank, count(*) AS n_left_out FROM g GROUP BY 1, 2""")
def _(spark, path):
    return J.leave_one_out_ranks(core_scores(spark, path))


def _u(i: int) -> str:
    return f"(0.4::DOUBLE + 0.2::DOUBLE * (('0x' || substr(md5('2|' || draw || '|{i}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))"


@query("weight_perturbation", "WITH " + ALT + f""", pw AS ({core_sql('scaled')}), dw AS (SELECT draw, {_u(0)} AS wa, {_u(1)} AS wb, {_u(2)} AS wc FROM (SELECT unnest(range(2000)) AS draw)),
    p1 AS (SELECT *, (coalesce(bm * wa, 0) + coalesce(bc * (1 - wa), 0)) / nullif(CASE WHEN bm IS NOT NULL THEN wa ELSE 0 END + CASE WHEN bc IS NOT NULL THEN 1 - wa ELSE 0 END, 0) AS i1,
                  (coalesce(li * wb, 0) + coalesce(la * (1 - wb), 0)) / nullif(CASE WHEN li IS NOT NULL THEN wb ELSE 0 END + CASE WHEN la IS NOT NULL THEN 1 - wb ELSE 0 END, 0) AS c1 FROM pw, dw),
    p2 AS (SELECT *, round((coalesce(i1 * wc, 0) + coalesce(c1 * (1 - wc), 0)) / nullif(CASE WHEN i1 IS NOT NULL THEN wc ELSE 0 END + CASE WHEN c1 IS NOT NULL THEN 1 - wc ELSE 0 END, 0), 9) AS k FROM p1),
    dr AS (SELECT *, CASE WHEN k IS NOT NULL THEN rank() OVER (PARTITION BY draw, integration_method, dataset ORDER BY k DESC NULLS LAST) + (count(*) OVER (PARTITION BY draw, integration_method, dataset, k) - 1) / 2.0::DOUBLE END AS r FROM p2),
    gm AS (SELECT draw, integration_method, fs_method, round(avg(r), 9) AS m FROM dr GROUP BY 1, 2, 3),
    rk AS (SELECT *, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY draw, integration_method ORDER BY m NULLS LAST) + (count(*) OVER (PARTITION BY draw, integration_method, m) - 1) / 2.0::DOUBLE END AS rank FROM gm)""" + SUMMARY)
def _(spark, path):
    return r5(J.weight_perturbation(scaled(spark, path), 2000, 2), *SUMMARY_COLS)


BUDGET = "SELECT dataset, integration_method, CASE WHEN effective_n_features <= 4 THEN '500' WHEN effective_n_features <= 7 THEN '1000' ELSE '2000' END AS n_features, metric_value AS v FROM records"


def _budget(spark, path):
    e = F.col("effective_n_features")
    return fx.records(spark, path).withColumn("n_features", F.when(e <= 4, "500").when(e <= 7, "1000").otherwise("2000"))


@query("budget_curves", f"WITH m AS (SELECT integration_method, n_features, dataset, avg(v) AS v FROM ({BUDGET}) GROUP BY 1, 2, 3), " + draws_sql("SELECT * FROM m", "integration_method", "dataset", 5000, 4) + """,
    b AS (SELECT integration_method, n_features, draw, sum(v * weight) / sum(weight) FILTER (v IS NOT NULL) AS b FROM m JOIN wt USING (integration_method, dataset) GROUP BY 1, 2, 3),
    ci AS (SELECT integration_method, n_features, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM b GROUP BY 1, 2)
    SELECT integration_method, n_features, round(avg(v), 6) + 0 AS mean, round(stddev_samp(v), 6) + 0 AS sd, count(v) AS n_datasets, round(any_value(lo), 6) + 0 AS lower, round(any_value(hi), 6) + 0 AS upper
    FROM m JOIN ci USING (integration_method, n_features) GROUP BY 1, 2""")
def _(spark, path):
    out = J.budget_curves(_budget(spark, path), 5000, 4, "metric_value")
    return out.withColumns({c: r6(c) for c in ("mean", "sd", "lower", "upper")})


@query("budget_contrasts", f"""WITH m AS (SELECT integration_method, n_features, dataset, avg(v) AS v FROM ({BUDGET}) GROUP BY 1, 2, 3),
    d AS (SELECT a.integration_method, a.dataset, f AS n_from, t AS n_to, b.v - a.v AS d FROM (VALUES ('500', '1000'), ('500', '2000')) p(f, t) JOIN m a ON a.n_features = f JOIN m b ON b.n_features = t AND a.integration_method = b.integration_method AND a.dataset = b.dataset),
    """ + draws_sql("SELECT * FROM d", "integration_method", "dataset", 5000, 4) + """,
    b AS (SELECT integration_method, n_from, n_to, draw, sum(d * weight) / sum(weight) AS b FROM d JOIN wt USING (integration_method, dataset) GROUP BY 1, 2, 3, 4),
    ci AS (SELECT integration_method, n_from, n_to, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM b GROUP BY 1, 2, 3)
    SELECT integration_method, n_from, n_to, round(avg(d), 6) + 0 AS mean_difference, count(*) AS n_datasets, round(any_value(lo), 6) + 0 AS lower, round(any_value(hi), 6) + 0 AS upper FROM d JOIN ci USING (integration_method, n_from, n_to) GROUP BY 1, 2, 3""")
def _(spark, path):
    out = J.budget_contrasts(_budget(spark, path), [("500", "1000"), ("500", "2000")], 5000, 4, "metric_value")
    return out.withColumns({c: r6(c) for c in ("mean_difference", "lower", "upper")})


@query("metric_correlations", "WITH " + spearman_sql(f"""SELECT a.metric_name AS first, b.metric_name AS second, round(a.scaled, 12) AS x, round(b.scaled, 12) AS y
    FROM setting_scaled a JOIN setting_scaled b USING ({SETQ}) WHERE a.metric_name < b.metric_name""", "first, second") + " SELECT first, second, round(rho, 4) AS rho, n FROM so")
def _(spark, path):
    _, setting, ranges, _ = tables(spark, path)
    out = J.metric_correlations(S.apply_ranges(setting, ranges, "oriented_mean"), "scaled")
    return out.withColumn("rho", F.round(r6("rho"), 4))


@query("metric_property_correlations", "WITH " + spearman_sql("SELECT metric_name, round(oriented_mean, 12) AS x, effective_max AS y FROM setting", "metric_name") + " SELECT * FROM so")
def _(spark, path):
    return J.metric_property_correlations(tables(spark, path)[1], "oriented_mean", "effective_max").withColumn("rho", r6("rho"))


@query("seed_agreement", "WITH " + spearman_sql("""SELECT a.metric_name, a.integration_method, CASE WHEN a.dataset = b.dataset THEN 'within_arm' ELSE 'same_seed' END AS comparison, a.dataset AS arm_a, b.dataset AS arm_b, a.random_seed AS seed_a,
      b.random_seed AS seed_b, a.v AS x, b.v AS y FROM se a JOIN se b USING (metric_name, integration_method, fs_method) WHERE (a.dataset < b.dataset AND a.random_seed = b.random_seed) OR (a.dataset = b.dataset AND a.random_seed < b.random_seed)""",
    "metric_name, integration_method, comparison, arm_a, arm_b, seed_a, seed_b").replace("sp AS", """se AS (SELECT metric_name, integration_method, fs_method, dataset, random_seed, metric_value AS v FROM records WHERE metric_value IS NOT NULL),
    sp AS""", 1) + " SELECT * FROM so")
def _(spark, path):
    return J.seed_agreement(fx.records(spark, path), "metric_value", "dataset", ["metric_name", "integration_method"]).withColumn("rho", r6("rho"))


STRATA = """
    WITH sv AS (SELECT dataset, fs_method, integration_method, CASE WHEN dataset < 'FURNITURE' THEN 'p1' ELSE 'p2' END AS platform, round(avg(BatchMixing), 9) AS a, round(avg(Clustering), 9) AS b FROM seed_scores GROUP BY ALL),
    lo AS (SELECT platform, dataset, integration_method, fs_method, 'BatchMixingMean' AS component, a AS s FROM sv UNION ALL SELECT platform, dataset, integration_method, fs_method, 'ClusteringMean', b FROM sv),
    ra AS (SELECT *, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY dataset, integration_method, component ORDER BY s DESC NULLS LAST) + (count(*) OVER (PARTITION BY dataset, integration_method, component, s) - 1) / 2.0::DOUBLE END AS r FROM lo),
    mr AS (SELECT platform, integration_method, component, fs_method, round(avg(r), 9) AS mean_rank FROM ra GROUP BY 1, 2, 3, 4 HAVING avg(r) IS NOT NULL),
    sr AS (SELECT *, rank() OVER (PARTITION BY platform, integration_method, component ORDER BY mean_rank) + (count(*) OVER (PARTITION BY platform, integration_method, component, mean_rank) - 1) / 2.0::DOUBLE AS stratum_rank FROM mr)"""


def _strata(spark, path):
    s = core_scores(spark, path).withColumn("platform", F.when(F.col("dataset") < "FURNITURE", "p1").otherwise("p2"))
    return J.stratified_ranks(s, "platform", ["BatchMixingMean", "ClusteringMean"])


@query("stratified_ranks", STRATA + " SELECT platform, integration_method, component, fs_method, round(mean_rank, 5) + 0 AS mean_rank, stratum_rank FROM sr")
def _(spark, path):
    return r5(_strata(spark, path), "mean_rank")


@query("stratum_spearman", STRATA + "," + spearman_sql("""SELECT a.integration_method, a.component, a.platform AS first, b.platform AS second, a.stratum_rank AS x, b.stratum_rank AS y
    FROM sr a JOIN sr b USING (integration_method, component, fs_method) WHERE a.platform < b.platform""", "integration_method, component, first, second") + " SELECT * FROM so")
def _(spark, path):
    return J.stratum_spearman(_strata(spark, path), "platform").withColumn("rho", r6("rho"))


@query("runtime_summary", """
    WITH d AS (SELECT dataset, fs_method, n_features, integration_method, random_seed, task, max(runtime) AS r, max(memory_usage) AS m FROM records GROUP BY ALL)
    SELECT fs_method, count(*) AS n_runs, round(quantile_cont(r, 0.5), 6) + 0 AS median_runtime, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) + 0 AS iqr_runtime,
           round(max(r), 6) + 0 AS max_runtime, round(max(m) / 1024, 6) + 0 AS max_memory_gib FROM d GROUP BY 1""")
def _(spark, path):
    out = J.runtime_summary(fx.records(spark, path), ["fs_method"])
    return out.withColumns({c: r6(c) for c in ("median_runtime", "iqr_runtime", "max_runtime", "max_memory_gib")})
