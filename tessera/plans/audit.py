"""Queries over set comparisons, coverage and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import audit as K
from tessera.operators import scoring as S
from tessera.operators import spatial as SP
from tessera.plans import fixtures as fx
from tessera.plans.ranking import MORAN
from tessera.plans.registry import query
from tessera.plans.scoring import core_scores, tables
from tessera.sources.records import METRIC_KEY

KEYQ = "dataset, fs_method, n_features, integration_method, task, metric_name, random_seed"
LABELLED = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
TOP = "SELECT dataset, method, gene FROM rankings WHERE rank <= 50"


def top(spark, path, n=50):
    return fx.rankings(spark, path).filter(F.col("rank") <= n).select("dataset", "method", "gene")


@query("set_overlap", f"""
    WITH s AS ({TOP}), z AS (SELECT dataset, method, count(*) AS n FROM s GROUP BY 1, 2),
    b AS (SELECT a.dataset, a.method AS first, b.method AS second, count(*) AS n_both FROM s a JOIN s b USING (dataset, gene) WHERE a.method < b.method GROUP BY 1, 2, 3)
    SELECT p.dataset, p.method AS first, p.n AS n_first, q.method AS second, q.n AS n_second, coalesce(n_both, 0) AS n_both, p.n + q.n - coalesce(n_both, 0) AS n_either,
           round(coalesce(n_both, 0) / (p.n + q.n - coalesce(n_both, 0)), 6) + 0 AS jaccard, round(coalesce(n_both, 0) / least(p.n, q.n), 6) + 0 AS proportion
    FROM z p JOIN z q ON p.dataset = q.dataset AND p.method < q.method LEFT JOIN b ON b.dataset = p.dataset AND b.first = p.method AND b.second = q.method""")
def _(spark, path):
    return K.set_overlap(top(spark, path), "method", ["dataset"]).withColumns({c: r6(c) for c in ("jaccard", "proportion")})


@query("method_overlap", f"""
    WITH s AS ({TOP}), z AS (SELECT dataset, method, count(*) AS n FROM s GROUP BY 1, 2),
    b AS (SELECT a.dataset, a.method AS first, b.method AS second, count(*) AS n_both FROM s a JOIN s b USING (dataset, gene) WHERE a.method < b.method GROUP BY 1, 2, 3),
    o AS (SELECT p.method AS first, q.method AS second, coalesce(n_both, 0) AS nb, p.n + q.n - coalesce(n_both, 0) AS ne, least(p.n, q.n) AS lo
          FROM z p JOIN z q ON p.dataset = q.dataset AND p.method < q.method LEFT JOIN b ON b.dataset = p.dataset AND b.first = p.method AND b.second = q.method)
    SELECT first, second, round(avg(nb), 6) + 0 AS mean_both, round(avg(nb / ne), 6) + 0 AS mean_jaccard, round(stddev_samp(nb / ne), 6) + 0 AS sd_jaccard, round(avg(nb / lo), 6) + 0 AS mean_proportion, count(*) AS n_datasets
    FROM o GROUP BY 1, 2""")
def _(spark, path):
    out = K.method_overlap(top(spark, path))
    return out.withColumns({c: r6(c) for c in ("mean_both", "mean_jaccard", "sd_jaccard", "mean_proportion")})


@query("selection_consensus", f"""
    WITH c AS (SELECT dataset, gene, count(*) AS m FROM ({TOP}) GROUP BY 1, 2), h AS (SELECT dataset, m, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT dataset, m, n, sum(n) OVER (PARTITION BY dataset ORDER BY m DESC)::BIGINT AS n_at_least FROM h""")
def _(spark, path):
    return K.selection_consensus(top(spark, path))


@query("selected_counts", "SELECT dataset, method, count(DISTINCT gene) AS n_selected FROM rankings GROUP BY 1, 2")
def _(spark, path):
    return K.selected_counts(fx.rankings(spark, path))


@query("common_methods", """
    WITH r AS (SELECT * FROM rankings WHERE NOT (dataset = 'BUILDING' AND method IN ('Brand#4', 'Brand#8')))
    SELECT method FROM r GROUP BY 1 HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM r)""")
def _(spark, path):
    return K.common_methods(fx.rankings(spark, path).filter(~((F.col("dataset") == "BUILDING") & F.col("method").isin("Brand#4", "Brand#8"))))


@query("context_overlap", """
    WITH s AS (SELECT * FROM rankings WHERE rank <= 50), f AS (SELECT DISTINCT method, gene FROM s WHERE dataset = 'BUILDING'), nf AS (SELECT method, count(*) AS n_full FROM f GROUP BY 1),
    p AS (SELECT DISTINCT method, dataset AS lineage, gene FROM s WHERE dataset <> 'BUILDING'),
    j AS (SELECT p.method, lineage, count(*) AS n_context, count(f.gene) AS n_both FROM p LEFT JOIN f USING (method, gene) GROUP BY 1, 2)
    SELECT method, lineage, n_context, n_both, n_full, round(n_both / (n_context + n_full - n_both), 6) + 0 AS jaccard FROM j JOIN nf USING (method)""")
def _(spark, path):
    r = top(spark, path).withColumn("lineage", F.col("dataset"))
    return K.context_overlap(r, "dataset", "BUILDING").withColumn("jaccard", r6("jaccard"))


@query("marker_proportion", """
    WITH s AS (SELECT dataset, method, gene FROM rankings WHERE rank <= 50), mk AS (SELECT split_part(gene, '-', 1) AS cell_type, gene FROM genes), z AS (SELECT cell_type, count(*) AS n FROM mk GROUP BY 1),
    g AS (SELECT d.dataset, d.method, z.cell_type, z.n, (SELECT count(*) FROM s JOIN mk USING (gene) WHERE s.dataset = d.dataset AND s.method = d.method AND mk.cell_type = z.cell_type) AS hit FROM (SELECT DISTINCT dataset, method FROM s) d CROSS JOIN z)
    SELECT dataset, method, round(avg(hit / n), 6) + 0 AS mean, round(stddev_pop(hit / n), 6) + 0 AS sd, count(*) AS n FROM g GROUP BY 1, 2""")
def _(spark, path):
    markers = fx.genes(spark, path).select(F.split("gene", "-")[0].alias("cell_type"), "gene")
    p = K.marker_proportion(top(spark, path), markers, ["dataset", "method"])
    return K.marker_summary(p, ["dataset", "method"]).withColumns({c: r6(c) for c in ("mean", "sd")})


@query("paired_overlap", """
    WITH s AS (SELECT * FROM rankings WHERE rank <= 50), a AS (SELECT DISTINCT method, gene FROM s WHERE dataset = 'BUILDING'), b AS (SELECT DISTINCT method, gene FROM s WHERE dataset = 'FURNITURE')
    SELECT coalesce(a.method, b.method) AS method, count(a.gene) AS n_first, count(b.gene) AS n_second, count(*) FILTER (a.gene IS NOT NULL AND b.gene IS NOT NULL) AS n_both, count(*) AS n_either,
           round(count(*) FILTER (a.gene IS NOT NULL AND b.gene IS NOT NULL) / count(*), 6) + 0 AS jaccard FROM a FULL JOIN b ON a.method = b.method AND a.gene = b.gene GROUP BY 1""")
def _(spark, path):
    return K.paired_overlap(top(spark, path), "dataset", "BUILDING", "FURNITURE", ["method"]).withColumn("jaccard", r6("jaccard"))


@query("reference_mismatch", """
    WITH s AS (SELECT * FROM rankings WHERE rank <= 50), x AS (SELECT method, gene, count(DISTINCT dataset) AS c FROM s WHERE dataset IN ('BUILDING', 'FURNITURE') AND method IN ('Brand#1', 'Brand#2') GROUP BY 1, 2)
    SELECT method, count(*) FILTER (c = 2) AS n_both, count(*) AS n_either FROM x GROUP BY 1 HAVING count(*) <> count(*) FILTER (c = 2)""")
def _(spark, path):
    o = K.paired_overlap(top(spark, path), "dataset", "BUILDING", "FURNITURE", ["method"])
    return K.reference_mismatch(o, ["Brand#1", "Brand#2"]).select("method", "n_both", "n_either")


@query("coverage", "SELECT dataset, task, metric_name, count(metric_value) AS available, count(*) AS total, round(count(metric_value) / count(*), 6) + 0 AS ratio FROM records GROUP BY 1, 2, 3")
def _(spark, path):
    return K.coverage(fx.records(spark, path), ["dataset", "task", "metric_name"]).withColumn("ratio", r6("ratio"))


EXPECTED = """
    ex AS (SELECT d.dataset, 'Brand#' || b AS fs_method, CASE WHEN b = 1 THEN 'all' ELSE '2000' END AS n_features, i.i AS integration_method, task_group AS task, metric_name, s.s AS random_seed, d.dataset = 'MACHINERY' AND needs_label AS expected_null
           FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) d(dataset), (SELECT unnest(range(1, 25)) AS b), (VALUES ('F'), ('O'), ('X')) i(i), (SELECT unnest(range(3)) AS s) s, metric_meta)"""


def expected(spark):
    methods = {f"Brand#{b}": ["all" if b == 1 else "2000"] for b in range(1, 25)}
    return K.expected_keys(spark, {d: d != "MACHINERY" for d in [*LABELLED, "MACHINERY"]}, methods, ["F", "O", "X"], [0, 1, 2])


@query("expected_keys", "WITH " + EXPECTED + """, k AS (SELECT DISTINCT dataset FROM records)
    SELECT dataset, task, count(*) AS n, count(*) FILTER (expected_null) AS n_null FROM ex JOIN k USING (dataset) GROUP BY 1, 2""")
def _(spark, path):
    seen = fx.records(spark, path).select("dataset").distinct()
    return expected(spark).join(seen, "dataset").groupBy("dataset", "task").agg(F.count("*").alias("n"), F.count_if("expected_null").alias("n_null"))


@query("key_coverage", "WITH " + EXPECTED + f""", o AS (SELECT DISTINCT {KEYQ}, 1 AS f FROM records), e AS (SELECT *, 1 AS g FROM ex)
    SELECT {KEYQ}, CASE WHEN g IS NULL THEN 'unexpected' WHEN f IS NULL THEN 'missing' ELSE 'present' END AS status FROM e FULL JOIN o USING ({KEYQ})""")
def _(spark, path):
    return K.key_coverage(fx.records(spark, path), expected(spark))


@query("key_quality", "WITH " + EXPECTED + f""",
    r2 AS (SELECT {KEYQ}, CASE WHEN random_seed = 0 AND metric_name = 'PAS' THEN NULL WHEN random_seed = 1 AND metric_name = 'ari' THEN 0.5 ELSE metric_value END AS v FROM records UNION ALL SELECT {KEYQ}, metric_value FROM records WHERE fs_method = 'Brand#6'),
    d AS (SELECT count(*) AS n FROM (SELECT 1 FROM r2 GROUP BY {KEYQ} HAVING count(*) > 1)), j AS (SELECT v, expected_null FROM r2 JOIN ex USING ({KEYQ}))
    SELECT 'duplicate_keys' AS "check", n FROM d UNION ALL SELECT 'unexpected_null', count(*) FILTER (NOT expected_null AND v IS NULL) FROM j UNION ALL SELECT 'expected_null_but_finite', count(*) FILTER (expected_null AND v IS NOT NULL) FROM j""")
def _(spark, path):
    r = fx.records(spark, path)
    v = F.when((F.col("random_seed") == 0) & (F.col("metric_name") == "PAS"), F.lit(None)).when(
        (F.col("random_seed") == 1) & (F.col("metric_name") == "ari"), 0.5).otherwise(F.col("metric_value"))
    damaged = r.withColumn("metric_value", v).unionByName(r.filter("fs_method = 'Brand#6'"))
    return K.key_quality(damaged, expected(spark))


def selections(spark, path):
    """Stored selections with a damaged hash (Brand#3), a wrong count (Brand#4) and a repeated gene (Brand#5)."""
    entry = F.sort_array(F.collect_list(F.struct("rank", "gene", "gene_index", "score")))
    g = fx.rankings(spark, path).filter("rank <= 30").groupBy("dataset", "method").agg(entry.alias("g"))
    names = F.transform("g", lambda e: e["gene"])
    names = F.when(F.col("method") == "Brand#5", F.concat(names, F.slice(names, 1, 1))).otherwise(names)
    digest = F.when(F.col("method") == "Brand#3", F.md5("dataset")).otherwise(F.md5(F.array_join("feature_names", "\n")))
    count = F.when(F.col("method") == "Brand#4", F.lit(7)).otherwise(F.size("feature_names"))
    return g.withColumn("feature_names", names).select(
        "dataset", F.col("method").alias("method_name"), "feature_names",
        F.create_map(F.lit("feature_hash"), digest, F.lit("effective_n_features"), count.cast("string")).alias("metadata"))


@query("selection_integrity", """
    SELECT dataset, method AS method_name, method <> 'Brand#3' AS hash_ok, NOT (method = 'Brand#4' AND count(*) <> 7) AS count_ok, method <> 'Brand#5' AS unique_ok FROM rankings WHERE rank <= 30 GROUP BY 1, 2""")
def _(spark, path):
    return K.selection_integrity(selections(spark, path)).select("dataset", "method_name", "hash_ok", "count_ok", "unique_ok")


@query("lineage_audit", """
    WITH t AS (SELECT l_orderkey % 40 AS task_id, 'e' || (l_orderkey % 40) AS embedding_signature FROM lineitem GROUP BY 1, 2)
    SELECT task_id, embedding_signature, CASE WHEN task_id % 10 = 9 THEN 'embedding_missing' WHEN task_id % 7 = 3 THEN 'selection_missing' ELSE 'ok' END AS status FROM t""")
def _(spark, path):
    k = F.col("l_orderkey") % 40
    t = fx.table(spark, path, "lineitem").select(k.alias("task_id"), F.concat(F.lit("e"), k.cast("string")).alias("embedding_signature")).distinct()
    e = t.filter("task_id % 10 <> 9").select("embedding_signature", F.concat(F.lit("h"), F.col("task_id").cast("string")).alias("feature_hash"))
    s = t.filter("task_id % 7 <> 3").select(F.concat(F.lit("h"), F.col("task_id").cast("string")).alias("feature_hash"))
    return K.lineage_audit(s, e, t)


def _key_sql(name: str, table: str, columns: str) -> str:
    return f"SELECT '{name}' AS table_name, 'key' AS rule, '{columns}' AS subject, coalesce(sum(k), 0) AS n_rows, count(*) FILTER (k > 1) AS n_bad FROM (SELECT count(*) AS k FROM {table} GROUP BY {columns})"


def _rule_sql(name: str, table: str, rule: str, subject: str, bad: str) -> str:
    return f"SELECT '{name}', '{rule}', '{subject}', count(*), count(*) FILTER ({bad}) FROM {table}"


def _covers_sql(name: str, table: str, other: str, source: str, columns: str) -> str:
    return f"""SELECT '{name}', 'covers', '{other}:{columns}', count(*), count(*) FILTER (h IS NULL)
        FROM (SELECT DISTINCT {columns} FROM {source}) LEFT JOIN (SELECT DISTINCT {columns}, 1 AS h FROM {table}) USING ({columns})"""


@query("score_audit", """
    WITH chosen AS (SELECT DISTINCT dataset, fs_method, n_features FROM records WHERE fs_method <> 'Brand#7'),
    picked AS (SELECT * FROM core_scores SEMI JOIN chosen USING (dataset, fs_method, n_features)),
    parts AS (SELECT dataset, fs_method, n_features, integration_method, avg(Alignment) AS a FROM seed_scores GROUP BY ALL), d AS (
    """ + " UNION ALL ".join([
    _key_sql("picked", "picked", "dataset,fs_method,integration_method"), _covers_sql("picked", "picked", "chosen", "chosen", "dataset,fs_method,n_features"),
    _key_sql("ranges", "ranges", "dataset,task,metric_name"), _covers_sql("ranges", "ranges", "records", "records", "dataset,task,metric_name"),
    _rule_sql("ranges", "ranges", "among", "status", "status NOT IN ('ok')"),
    _key_sql("records", "records", "dataset,fs_method,n_features,integration_method,task,metric_name,random_seed"),
    _rule_sql("records", "records", "among", "metric_name", "false"), _rule_sql("records", "records", "between", "runtime", "NOT runtime BETWEEN 0 AND 1e9"),
    _rule_sql("scaled", "setting_scaled", "between", "scaled", "NOT scaled BETWEEN -1e-10 AND 1 + 1e-10"),
    _rule_sql("scores", "parts", "only_where", "AlignmentMean", "a IS NOT NULL AND dataset NOT IN ('BUILDING', 'FURNITURE')"),
    _rule_sql("scores", "core_scores", "filled", "CoreOverallMean", "CoreOverallMean IS NULL")]) + """)
    SELECT table_name, rule, subject, n_rows::BIGINT AS n_rows, n_bad::BIGINT AS n_bad, n_bad = 0 AS passed FROM d""")
def _(spark, path):
    o, setting, ranges, seeds = tables(spark, path)
    scores = S.setting_scores(seeds)
    chosen = o.filter("fs_method <> 'Brand#7'").select("dataset", "fs_method", "n_features").distinct()
    return K.audit_tables({
        "picked": K.Expect(S.representative(scores, chosen), key=["dataset", "fs_method", "integration_method"], covers={"chosen": (chosen, ["dataset", "fs_method", "n_features"])}),
        "ranges": K.Expect(ranges, key=S.RANGE_KEY, covers={"records": (o, S.RANGE_KEY)}, among={"status": ["ok"]}),
        "records": K.Expect(o, key=METRIC_KEY, among={"metric_name": list(S.METRICS)}, between={"runtime": (0, 1e9)}),
        "scaled": K.Expect(S.apply_ranges(setting, ranges, "oriented_mean"), between={"scaled": (-1e-10, 1 + 1e-10)}),
        "scores": K.Expect(scores, filled=["CoreOverallMean"], only_where={"AlignmentMean": "dataset IN ('BUILDING', 'FURNITURE')"})})


BUDGET = """
    WITH c AS (SELECT dataset, fs_method, CASE WHEN fs_method = 'Brand#1' THEN 'all' ELSE (2 + l % 3)::VARCHAR END AS n_features, least(effective_n_features, 2 + l % 3) AS e
               FROM (SELECT *, hash_k AS l FROM (SELECT *, length(dataset) AS hash_k FROM records))),
    b AS (SELECT dataset, fs_method, n_features, min(e) AS actual_min, max(e) AS actual_max, coalesce(min(e) = TRY_CAST(n_features AS BIGINT) AND max(e) = TRY_CAST(n_features AS BIGINT), false) AS exact FROM c GROUP BY 1, 2, 3)"""


def budgets(spark, path):
    want = 2 + F.length("dataset") % 3
    r = fx.records(spark, path)
    return K.budget_audit(r.select("dataset", "fs_method", F.when(F.col("fs_method") == "Brand#1", "all").otherwise(want.cast("string")).alias("n_features"),
                                   F.least("effective_n_features", want.cast("bigint")).alias("effective_n_features")))


@query("budget_audit", BUDGET + " SELECT * FROM b")
def _(spark, path):
    return budgets(spark, path)


@query("budget_panels", BUDGET + " SELECT fs_method, bool_and(exact) AS exact_everywhere, count(*) FILTER (NOT exact) AS n_inexact, count(*) AS n_settings FROM b GROUP BY 1")
def _(spark, path):
    return K.budget_panels(budgets(spark, path))


@query("grid_status", BUDGET + """,
    g AS (SELECT d.dataset, m.m AS fs_method, n.n AS n_features FROM (SELECT DISTINCT dataset FROM records) d, (VALUES ('Brand#1'), ('Brand#2'), ('wilcoxon'), ('all_features')) m(m), (VALUES ('2'), ('3'), ('4'), ('all')) n(n))
    SELECT g.dataset, g.fs_method, g.n_features, CASE WHEN actual_min IS NOT NULL THEN 'evaluated' WHEN g.fs_method = 'wilcoxon' AND g.dataset = 'MACHINERY' THEN 'not_applicable_no_labels'
      WHEN g.fs_method = 'all_features' OR g.n_features = 'all' THEN 'not_applicable_budget' ELSE 'not_run' END AS status FROM g LEFT JOIN b USING (dataset, fs_method, n_features)""")
def _(spark, path):
    methods, ns = (F.array(*[F.lit(v) for v in vs]) for vs in (["Brand#1", "Brand#2", "wilcoxon", "all_features"], ["2", "3", "4", "all"]))
    grid = fx.records(spark, path).select("dataset").distinct().withColumn("fs_method", F.explode(methods)).withColumn("n_features", F.explode(ns))
    return K.grid_status(grid, budgets(spark, path), ["wilcoxon"], LABELLED).select("dataset", "fs_method", "n_features", "status")


@query("metric_weights", """
    WITH h AS (SELECT dataset, metric_name, count(scaled) AS n_finite, count(*) AS n_rows FROM setting_scaled GROUP BY 1, 2), k AS (SELECT component, count(*) AS k FROM metric_meta GROUP BY 1),
    g AS (SELECT d.dataset, component, metric_name, k, component IN ('BatchMixing', 'LabelIndependentClustering') OR d.dataset <> 'MACHINERY' AS eligible, d.dataset <> 'MACHINERY' AS lab FROM (SELECT DISTINCT dataset FROM records) d, metric_meta JOIN k USING (component))
    SELECT dataset, component, metric_name, eligible, coalesce(n_finite, 0) AS n_finite, coalesce(n_rows, 0) AS n_rows, round(CASE WHEN eligible THEN 1 / k ELSE 0 END, 6) + 0 AS component_weight,
           round(CASE WHEN NOT eligible OR component = 'Alignment' THEN 0 WHEN lab THEN 0.25 / k ELSE 0.5 / k END, 6) + 0 AS core_weight FROM g LEFT JOIN h USING (dataset, metric_name)""")
def _(spark, path):
    _, setting, ranges, _ = tables(spark, path)
    out = K.metric_weights(S.apply_ranges(setting, ranges, "oriented_mean"), LABELLED)
    return out.withColumns({c: r6(c) for c in ("component_weight", "core_weight")})


REQUIRED = ["bASW", "iLISI", "silhouette", "CHAOS", "PAS"]
RUN = ["dataset", "fs_method", "integration_method", "random_seed"]
RUNS = """SELECT dataset, fs_method, integration_method, random_seed, coalesce(n, 0) AS n_present
    FROM (SELECT DISTINCT dataset FROM records) CROSS JOIN (SELECT DISTINCT fs_method FROM records) CROSS JOIN (SELECT DISTINCT integration_method FROM records)
    CROSS JOIN (SELECT DISTINCT random_seed FROM records)
    LEFT JOIN (SELECT dataset, fs_method, integration_method, random_seed, count(DISTINCT metric_name) FILTER (metric_value IS NOT NULL) AS n
               FROM records WHERE metric_name IN ('bASW', 'iLISI', 'silhouette', 'CHAOS', 'PAS') GROUP BY 1, 2, 3, 4) USING (dataset, fs_method, integration_method, random_seed)"""


def run_grid(records):
    """Every run of the job grid, from the values of each axis."""
    grid = records.agg(*[F.collect_set(c).alias(c) for c in RUN])
    for c in RUN:
        grid = grid.withColumn(c, F.explode(c))
    return grid


def runs(spark, path):
    records = fx.records(spark, path)
    return K.run_coverage(records, REQUIRED, RUN, run_grid(records))


@query("run_coverage", f"SELECT *, n_present = 5 AS complete FROM ({RUNS})")
def _(spark, path):
    return runs(spark, path)


@query("complete_methods", f"SELECT fs_method, bool_and(n_present = 5) AS complete, count(*) AS n_runs FROM ({RUNS}) GROUP BY 1")
def _(spark, path):
    return K.complete_methods(runs(spark, path))


@query("pending_jobs", f"""
    WITH j AS (SELECT DISTINCT dataset, fs_method, n_features, random_seed FROM records)
    SELECT dataset, fs_method, n_features, random_seed, md5('{{"dataset":"' || dataset || '","fs_method":"' || fs_method || '","n_features":"' || n_features || '","random_seed":' || random_seed || '}}') AS signature
    FROM j WHERE random_seed <> 1 OR fs_method = 'Brand#2'""")
def _(spark, path):
    jobs = fx.records(spark, path).select("dataset", "fs_method", "n_features", "random_seed").distinct()
    cols = ["dataset", "fs_method", "n_features", "random_seed"]
    done = K.with_signature(jobs.filter("random_seed = 1 AND fs_method <> 'Brand#2'"), cols)
    return K.pending(K.with_signature(jobs, cols), done)


SENS = MORAN + """,
    ms AS (SELECT slice, gene, CASE WHEN md5(slice || gene) < '6' THEN NULL ELSE score END AS score FROM mi),
    pc AS (SELECT gene, (rank() OVER (PARTITION BY slice ORDER BY round(score, 12)) + (count(*) OVER (PARTITION BY slice, round(score, 12)) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY slice) AS p FROM ms WHERE score IS NOT NULL),
    sc AS (SELECT gene, gene_index, round(sum(p) / 5, 9) AS z, round(avg(p), 9) AS e FROM pc JOIN genes USING (gene) GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (ORDER BY z DESC, gene_index DESC) AS rz, row_number() OVER (ORDER BY e DESC, gene_index DESC) AS re FROM sc)"""


def _missing(spark, path):
    ds = fx.dataset(spark, path)
    s = SP.morans_i_scores(ds).withColumn("score", F.when(F.md5(F.concat("slice", "gene")) >= "6", F.col("score")))
    return ds, s


@query("missing_rank_sensitivity", SENS + """
    SELECT count(*) FILTER (rz <= 60) AS n_first, count(*) FILTER (re <= 60) AS n_second, count(*) FILTER (rz <= 60 AND re <= 60) AS n_both, count(*) FILTER (rz <= 60 OR re <= 60) AS n_either,
           round(count(*) FILTER (rz <= 60 AND re <= 60) / count(*) FILTER (rz <= 60 OR re <= 60), 6) + 0 AS jaccard FROM rk""")
def _(spark, path):
    ds, s = _missing(spark, path)
    return K.missing_rank_sensitivity(s, ds.genes, F.lit(5), 60).withColumn("jaccard", r6("jaccard"))


@query("ranked_counts", SENS + " SELECT slice, count(score) AS n_ranked, (SELECT count(*) FROM genes) - count(score) AS n_unranked FROM ms GROUP BY 1")
def _(spark, path):
    ds, s = _missing(spark, path)
    return K.ranked_counts(s, ds.genes)


@query("metric_profile", """
    SELECT dataset, task, metric_name, count(*) AS n, count(metric_value) AS n_finite, count(*) - count(metric_value) AS n_missing, count(*) FILTER (metric_value = 0) AS n_zero, round(min(metric_value), 6) + 0 AS min,
           round(max(metric_value), 6) + 0 AS max, round(avg(metric_value), 6) + 0 AS mean FROM records GROUP BY 1, 2, 3""")
def _(spark, path):
    return K.metric_profile(fx.records(spark, path)).withColumns({c: r6(c) for c in ("min", "max", "mean")})


@query("context_marker_difference", """
    WITH s AS (SELECT method, dataset AS context, gene_index % 3 AS seed, gene FROM rankings WHERE rank <= 90),
    p AS (SELECT method, context, seed, count(*) FILTER (gene LIKE 'PROMO-%') AS n FROM s GROUP BY 1, 2, 3),
    m AS (SELECT method, context, avg(n) AS a, stddev_samp(n) AS sd, count(*) AS k FROM p GROUP BY 1, 2)
    SELECT m.method, m.context, round(m.a, 6) + 0 AS mean_markers, round(m.sd, 6) + 0 AS sd_markers, m.k AS n_seeds, round(b.a, 6) + 0 AS full_markers, round(m.a - b.a, 6) + 0 AS difference
    FROM m JOIN m b ON b.method = m.method AND b.context = 'BUILDING'""")
def _(spark, path):
    r = fx.rankings(spark, path).filter("rank <= 90").select("method", F.col("dataset").alias("context"), (F.col("gene_index") % 3).alias("seed"), "gene")
    markers = fx.genes(spark, path).filter(F.col("gene").startswith("PROMO-"))
    out = K.context_marker_difference(r, markers, "BUILDING")
    return out.withColumns({c: r6(c) for c in ("mean_markers", "sd_markers", "full_markers", "difference")})
