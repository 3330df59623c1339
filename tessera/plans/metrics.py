"""Queries over metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import metrics as M
from tessera.operators.scoring import mean_rank, within_task_rank
from tessera.plans import fixtures as fx
from tessera.plans.graphs import location
from tessera.plans.registry import query


def value(df):
    return df.withColumn("value", r6("value"))


@query("slice_mixing_entropy", """
    WITH c AS (SELECT src, dst_slice, count(*) AS c FROM emb_knn15 GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY src) AS p FROM c),
    h AS (SELECT src, -sum(p * ln(p + 1e-12)) AS h, count(*) AS m FROM p GROUP BY 1)
    SELECT round(avg(CASE WHEN m > 1 THEN h / ln(m) ELSE h END), 6) + 0 AS value FROM h""")
def _(spark, path):
    return value(M.slice_mixing_entropy(fx.embedding(spark, path)))


def _sil_sql(col: str) -> str:
    return f"""
    WITH sz AS (SELECT {col} AS k, count(*) AS n FROM embedding GROUP BY 1),
    su AS (SELECT src, src_{col} AS c, dst_{col} AS k, sum(sqrt(dist2)) AS t FROM emb_pairs GROUP BY 1, 2, 3),
    ab AS (SELECT src, c, max(n) FILTER (c = k) AS own, max(CASE WHEN n > 1 THEN t / (n - 1) END) FILTER (c = k) AS a, min(t / n) FILTER (c <> k) AS b FROM su JOIN sz USING (k) GROUP BY 1, 2),
    sv AS (SELECT src, c, CASE WHEN own IS NULL OR own = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab)"""


@query("silhouette", _sil_sql("label") + " SELECT c AS label, count(*) AS n, round(avg(s), 6) + 0 AS value FROM sv GROUP BY 1")
def _(spark, path):
    s = M.silhouette_values(fx.embedding(spark, path), "label")
    return s.groupBy(F.col("c").alias("label")).agg(F.count("*").alias("n"), r6(F.avg("silhouette")).alias("value"))


@query("squared_silhouette", _sil_sql("label").replace("sum(sqrt(dist2))", "sum(dist2)") + " SELECT src AS spot_id, c AS label, round(s, 6) + 0 AS silhouette FROM sv")
def _(spark, path):
    s = M.squared_silhouette_values(fx.embedding(spark, path), "label")
    return s.select("spot_id", F.col("c").alias("label"), r6("silhouette").alias("silhouette"))


@query("inverse_slice_silhouette", _sil_sql("slice") + " SELECT round(1 - (avg(s) + 1) / 2, 6) + 0 AS value FROM sv")
def _(spark, path):
    return value(M.inverse_slice_silhouette(fx.embedding(spark, path)))


@query("dasw", _sil_sql("label") + " SELECT round((avg(s) + 1) / 2, 6) + 0 AS value FROM sv")
def _(spark, path):
    return value(M.dasw(fx.embedding(spark, path)))


@query("basw", """
    WITH sz AS (SELECT label, slice AS k, count(*) AS n FROM embedding GROUP BY 1, 2),
    su AS (SELECT src, src_label AS label, src_slice AS c, dst_slice AS k, sum(sqrt(dist2)) AS t FROM emb_pairs WHERE src_label = dst_label GROUP BY ALL),
    ab AS (SELECT src, label, c, max(n) FILTER (c = k) AS own, max(CASE WHEN n > 1 THEN t / (n - 1) END) FILTER (c = k) AS a, min(t / n) FILTER (c <> k) AS b
           FROM su JOIN sz USING (label, k) GROUP BY 1, 2, 3),
    sv AS (SELECT label, c, CASE WHEN own IS NULL OR own = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab),
    la AS (SELECT label, avg(s) AS s FROM sv GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT c) >= 2)
    SELECT round(avg(1 - abs(s)), 6) + 0 AS value FROM la""")
def _(spark, path):
    return value(M.basw(fx.embedding(spark, path)))


@query("basw_unlabelled", _sil_sql("slice") + " SELECT round(1 - abs(avg(s)), 6) + 0 AS value FROM sv")
def _(spark, path):
    return value(M.basw(fx.embedding(spark, path), label_col=None))


def _lisi_sql(col: str, mode: str) -> str:
    v = "(s - 1) / (n - 1)" if mode == "batch" else "1 - (s - 1) / (n - 1)"
    return f"""
    WITH c AS (SELECT src, dst_{col} AS v, count(*) AS c FROM emb_knn15 GROUP BY 1, 2), s AS (SELECT src, pow(sum(c), 2) / sum(c * c) AS s FROM c GROUP BY 1)
    SELECT round(least(greatest(avg({v}), 0), 1), 6) + 0 AS value FROM s, (SELECT count(DISTINCT {col}) AS n FROM embedding)"""


@query("ilisi", _lisi_sql("slice", "batch"))
def _(spark, path):
    return value(M.lisi(fx.embedding(spark, path), "slice", 15, "batch"))


@query("dlisi", _lisi_sql("label", "label"))
def _(spark, path):
    return value(M.lisi(fx.embedding(spark, path), "label", 15, "label"))


@query("isolated_label_f1", """
    WITH sp AS (SELECT label, count(DISTINCT slice) AS m, count(*) AS n FROM embedding GROUP BY 1),
    t AS (SELECT * FROM sp WHERE m = 1 OR (SELECT count(*) FROM sp WHERE m = 1) = 0),
    p AS (SELECT DISTINCT src, src_label, dst_label FROM emb_knn15),
    h AS (SELECT label, n, count(*) FILTER (src_label = label) AS tp, count(*) FILTER (src_label <> label) AS fp FROM t LEFT JOIN p ON dst_label = label GROUP BY 1, 2),
    f AS (SELECT tp / (tp + fp + 1e-12) AS pr, tp / (n + 1e-12) AS re FROM h)
    SELECT round(avg(2 * pr * re / (pr + re + 1e-12)), 6) + 0 AS value FROM f""")
def _(spark, path):
    return value(M.isolated_label_f1(fx.embedding(spark, path)))


@query("graph_connectivity", """
    WITH RECURSIVE e AS (SELECT src, dst FROM emb_knn15 WHERE src_label = dst_label), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r(node, reach) AS (SELECT spot_id, spot_id FROM embedding UNION SELECT r.node, b.dst FROM r JOIN b ON r.reach = b.src),
    c AS (SELECT node, min(reach) AS comp FROM r GROUP BY 1),
    s AS (SELECT label, comp, count(*) AS n FROM c JOIN embedding ON spot_id = node GROUP BY 1, 2)
    SELECT round(avg(v), 6) + 0 AS value FROM (SELECT max(n) / sum(n) AS v FROM s GROUP BY label)""")
def _(spark, path):
    return value(M.graph_connectivity(fx.embedding(spark, path)))


@query("neighbor_overlap", """
    WITH q AS (SELECT a.spot_id AS src, b.spot_id AS dst, list_sum(list_transform(list_zip(a.emb[1:16], b.emb[1:16]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
               FROM embedding a JOIN embedding b ON a.spot_id <> b.spot_id),
    k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM q) WHERE r BETWEEN 2 AND 16),
    j AS (SELECT coalesce(a.src, k.src) AS src, count(*) FILTER (a.src IS NOT NULL AND k.src IS NOT NULL) / count(*) AS j
          FROM emb_knn15 a FULL JOIN k ON a.src = k.src AND a.dst = k.dst GROUP BY 1)
    SELECT round(avg(j), 6) + 0 AS value FROM j""")
def _(spark, path):
    emb = fx.embedding(spark, path)
    return value(M.neighbor_overlap(emb, emb.withColumn("emb", F.slice("emb", 1, 16))))


@query("label_purity", """
    SELECT round(avg(p), 6) + 0 AS value FROM (SELECT src, avg((src_label = dst_label)::INT) AS p FROM emb_knn15 GROUP BY 1)""")
def _(spark, path):
    return value(M.label_purity(fx.embedding(spark, path)))


CT = """
    WITH c AS (SELECT slice, label AS t, CASE WHEN x < 20 THEN label ELSE 'far' END AS p, count(*)::DOUBLE AS n FROM spots GROUP BY ALL),
    ct AS (SELECT slice, t, sum(n) AS n FROM c GROUP BY 1, 2), cp AS (SELECT slice, p, sum(n) AS n FROM c GROUP BY 1, 2), tt AS (SELECT slice, sum(n) AS n FROM c GROUP BY 1)"""


def _predicted(spark, path):
    return fx.spots(spark, path).withColumn("p", F.when(F.col("x") < 20, F.col("label")).otherwise("far"))


@query("ari", CT + """,
    a AS (SELECT slice, sum(n*(n-1)/2) AS a FROM ct GROUP BY 1), b AS (SELECT slice, sum(n*(n-1)/2) AS b FROM cp GROUP BY 1), s AS (SELECT slice, sum(n*(n-1)/2) AS s FROM c GROUP BY 1)
    SELECT slice, round((s - a*b/(n*(n-1)/2)) / ((a+b)/2 - a*b/(n*(n-1)/2)), 6) + 0 AS value FROM s JOIN a USING (slice) JOIN b USING (slice) JOIN tt USING (slice)""")
def _(spark, path):
    return value(M.ari(_predicted(spark, path), "label", "p", ["slice"]))


@query("nmi", CT + """,
    mi AS (SELECT slice, sum(c.n / tt.n * ln(c.n * tt.n / (ct.n * cp.n))) AS mi FROM c JOIN ct USING (slice, t) JOIN cp USING (slice, p) JOIN tt USING (slice) GROUP BY 1),
    ht AS (SELECT slice, -sum(ct.n / tt.n * ln(ct.n / tt.n)) AS ht FROM ct JOIN tt USING (slice) GROUP BY 1), hp AS (SELECT slice, -sum(cp.n / tt.n * ln(cp.n / tt.n)) AS hp FROM cp JOIN tt USING (slice) GROUP BY 1)
    SELECT slice, round(mi / ((ht + hp) / 2), 6) + 0 AS value FROM mi JOIN ht USING (slice) JOIN hp USING (slice)""")
def _(spark, path):
    return value(M.nmi(_predicted(spark, path), "label", "p", ["slice"]))


@query("ari_nmi_whole", """
    WITH c AS (SELECT label AS t, spot_id % 10 AS p, count(*)::DOUBLE AS n FROM embedding GROUP BY ALL), ct AS (SELECT t, sum(n) AS n FROM c GROUP BY 1), cp AS (SELECT p, sum(n) AS n FROM c GROUP BY 1),
    k AS (SELECT sum(n) AS n FROM c), a AS (SELECT sum(n*(n-1)/2) AS a FROM ct), b AS (SELECT sum(n*(n-1)/2) AS b FROM cp), s AS (SELECT sum(n*(n-1)/2) AS s FROM c),
    mi AS (SELECT sum(c.n / k.n * ln(c.n * k.n / (ct.n * cp.n))) AS mi FROM c JOIN ct USING (t) JOIN cp USING (p), k),
    ht AS (SELECT -sum(ct.n / k.n * ln(ct.n / k.n)) AS ht FROM ct, k), hp AS (SELECT -sum(cp.n / k.n * ln(cp.n / k.n)) AS hp FROM cp, k)
    SELECT 'ari' AS metric, round((s - a*b/(n*(n-1)/2)) / ((a+b)/2 - a*b/(n*(n-1)/2)), 6) + 0 AS value FROM s, a, b, k
    UNION ALL SELECT 'nmi', round(mi / ((ht + hp) / 2), 6) + 0 FROM mi, ht, hp""")
def _(spark, path):
    e = fx.embedding(spark, path).withColumn("p", F.col("spot_id") % 10)
    out = M.ari(e, "label", "p").withColumn("metric", F.lit("ari")).unionByName(M.nmi(e, "label", "p").withColumn("metric", F.lit("nmi")))
    return value(out)


@query("chaos", """
    WITH m AS (SELECT *, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS sx, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-12) AS sy,
                      count(*) OVER (PARTITION BY slice, label) AS c, count(*) OVER w AS n FROM spots WINDOW w AS (PARTITION BY slice)),
    d AS (SELECT a.slice, a.n, a.spot_id, min(sqrt(pow(a.sx - b.sx, 2) + pow(a.sy - b.sy, 2))) AS d FROM m a JOIN m b ON a.slice = b.slice AND a.label = b.label AND a.spot_id <> b.spot_id
          WHERE a.c > 2 GROUP BY 1, 2, 3)
    SELECT slice, round(coalesce(sum(d), 0) / n, 6) + 0 AS value FROM d GROUP BY slice, n""")
def _(spark, path):
    return value(M.chaos(fx.spots(spark, path), "label"))


@query("pas", """
    WITH k AS (SELECT * FROM (SELECT a.slice, a.spot_id AS src, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.spot_id
                 ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot_id) AS r FROM spots a JOIN spots b ON a.slice = b.slice AND a.spot_id <> b.spot_id) WHERE r BETWEEN 2 AND 11),
    d AS (SELECT slice, src, (count(*) FILTER (la <> lb) > count(*) / 2)::INT AS d FROM k GROUP BY 1, 2)
    SELECT slice, round(sum(d) / any_value(n_spots), 6) + 0 AS value FROM d JOIN slice_sizes USING (slice) GROUP BY 1""")
def _(spark, path):
    return value(M.pas(fx.spots(spark, path), "label"))


@query("spatial_coherence", """
    SELECT round(avg((a.label = b.label)::INT), 6) + 0 AS value FROM knn8 JOIN spots a ON a.spot_id = src JOIN spots b ON b.spot_id = dst""")
def _(spark, path):
    return value(M.spatial_coherence(fx.spots(spark, path)))


@query("morans_i_column", """
    WITH t AS (SELECT spot_id, y + x * (spot_id % 3) AS v FROM spots), z AS (SELECT spot_id, v - (SELECT avg(v) FROM t) AS z FROM t)
    SELECT round((SELECT count(*) FROM z) / count(*) * sum(a.z * b.z) / (SELECT sum(z * z) FROM z), 6) + 0 AS value FROM knn8 JOIN z a ON a.spot_id = src JOIN z b ON b.spot_id = dst""")
def _(spark, path):
    s = fx.spots(spark, path).withColumn("v", F.col("y") + F.col("x") * (F.col("spot_id") % 3))
    return value(M.morans_i_column(s, "v"))


@query("alignment_scores", """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist2, dst) AS r FROM emb_pairs
               WHERE (src_slice = 's0' AND dst_slice = 's1') OR (src_slice = 's1' AND dst_slice = 's0')),
    d AS (SELECT src_slice, avg((src_label = dst_label)::INT) AS acc, count(DISTINCT dst) AS t FROM p WHERE r = 1 GROUP BY 1),
    n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM embedding WHERE slice IN ('s0', 's1') GROUP BY slice))
    SELECT round(avg(acc), 6) + 0 AS accuracy, round(avg(abs(log2(n / t))), 6) + 0 AS ratio FROM d, n""")
def _(spark, path):
    s = M.alignment_scores(fx.embedding(spark, path), fx.PAIRS)
    return s.select(r6("accuracy").alias("accuracy"), r6("ratio").alias("ratio"))


WTR = """
    SELECT *, CASE WHEN metric_value IS NOT NULL THEN rank() OVER (PARTITION BY dataset, integration_method, task, metric_name, random_seed ORDER BY metric_value DESC NULLS LAST)
      + (count(*) OVER (PARTITION BY dataset, integration_method, task, metric_name, random_seed, metric_value) - 1) / 2.0::DOUBLE END AS rk FROM records"""


@query("within_task_rank", f"WITH r AS ({WTR}) SELECT dataset, fs_method, integration_method, task, metric_name, random_seed, rk AS rank FROM r")
def _(spark, path):
    return within_task_rank(fx.records(spark, path)).select(
        "dataset", "fs_method", "integration_method", "task", "metric_name", "random_seed", "rank")


@query("mean_rank", f"WITH r AS ({WTR}) SELECT fs_method, round(avg(rk), 6) + 0 AS mean_rank, count(rk) AS n FROM r GROUP BY 1")
def _(spark, path):
    return mean_rank(fx.records(spark, path)).withColumn("mean_rank", r6("mean_rank"))


@query("kmeans_embed")
def _(spark, path):
    out = M.kmeans_embed(fx.embedding(spark, path), 10, n_init=3)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"))


AB = "WITH ab AS (SELECT slice, label AS domain, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY slice) AS share FROM spots GROUP BY 1, 2)"


@query("slice_abundance", AB + " SELECT slice, domain, n, round(share, 6) + 0 AS share FROM ab")
def _(spark, path):
    return M.slice_abundance(fx.spots(spark, path)).withColumn("share", r6("share"))


@query("slice_distance_mean", AB + """,
    g AS (SELECT s.slice, d.domain, coalesce(share, 0) AS v FROM (SELECT DISTINCT slice FROM ab) s CROSS JOIN (SELECT DISTINCT domain FROM ab) d LEFT JOIN ab USING (slice, domain)),
    p AS (SELECT a.slice AS u, b.slice AS v, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM g a JOIN g b ON a.domain = b.domain AND a.slice < b.slice GROUP BY 1, 2)
    SELECT round(avg(d), 6) + 0 AS value FROM p""")
def _(spark, path):
    return value(M.slice_distance_mean(M.slice_abundance(fx.spots(spark, path))))


@query("slice_clusters")
def _(spark, path):
    return M.slice_clusters(M.slice_abundance(fx.spots(spark, path)), 2)


@query("slice_representation")
def _(spark, path):
    return M.slice_representation(fx.spots(spark, path, True), 2)


@query("eval_integration")
def _(spark, path):
    return M.to_records(M.eval_integration(fx.embedding(spark, path)), dataset="embedding", platform="grid", random_seed=0)


@query("eval_clustering")
def _(spark, path):
    spots = fx.spots(spark, path)
    emb = M.kmeans_embed(location(spots.select("spot_id", "slice", "label", "x", "y")), 5, n_init=1)
    return M.to_records(M.eval_clustering(spots, emb), dataset="spots", platform="grid", random_seed=0)


@query("eval_alignment")
def _(spark, path):
    return M.to_records(M.eval_alignment(fx.embedding(spark, path), fx.PAIRS), dataset="embedding", platform="grid", random_seed=0)


@query("eval_slices")
def _(spark, path):
    return M.to_records(M.eval_slices(fx.spots(spark, path, True), 2), dataset="spots", platform="grid", random_seed=0)
