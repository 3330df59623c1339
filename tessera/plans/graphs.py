"""Queries over neighbour joins and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import graph as G
from tessera.plans import fixtures as fx
from tessera.plans.registry import query


@query("knn_join", "SELECT slice, src, dst, round(dist2, 6) + 0 AS dist2, rank FROM knn8")
def _(spark, path):
    return G.knn_join(fx.spots(spark, path), 8).select("slice", "src", "dst", r6("dist2").alias("dist2"), F.col("rank").cast("bigint").alias("rank"))


@query("symmetrize", """
    WITH e AS (SELECT slice, src, dst FROM pairs8) SELECT slice, src, dst FROM e UNION ALL SELECT slice, dst, src FROM e""")
def _(spark, path):
    return G.symmetrize(G.knn_join(fx.spots(spark, path), 8))


@query("slice_graph", """
    WITH d AS (SELECT slice, src, dst FROM knn8 WHERE rank <= 3), s AS (SELECT slice, src, dst FROM d UNION SELECT slice, dst, src FROM d)
    SELECT slice, count(*) AS n_directed, (SELECT count(*) FROM s WHERE s.slice = d.slice) AS n_symmetric FROM d GROUP BY 1""")
def _(spark, path):
    directed, both = G.slice_graph(fx.spots(spark, path), 3)
    return directed.groupBy("slice").agg(F.count("*").alias("n_directed")).join(
        both.groupBy("slice").agg(F.count("*").alias("n_symmetric")), "slice")


@query("metric_knn", "SELECT src, dst, round(dist2, 6) + 0 AS dist2, rank FROM emb_knn15")
def _(spark, path):
    return G.metric_knn(fx.embedding(spark, path), 15).select("src", "dst", r6("dist2").alias("dist2"), F.col("rank").cast("bigint").alias("rank"))


RADIUS = """
    SELECT a.slice, a.spot_id, count(b.spot_id) AS degree FROM spots a LEFT JOIN spots b ON a.slice = b.slice AND a.spot_id <> b.spot_id
     AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {r2} GROUP BY 1, 2"""


@query("radius_degree", RADIUS.format(r2=36.0))
def _(spark, path):
    return G.radius_degree(fx.spots(spark, path), 6.0)


@query("radius_degree_wide", RADIUS.format(r2=225.0))
def _(spark, path):
    return G.radius_degree(fx.spots(spark, path), 15.0)


@query("knn_distance_summary", """
    SELECT slice, round(quantile_cont(sqrt(dist2), 0.5) FILTER (rank = 1), 6) + 0 AS nn1_median,
           round(quantile_cont(sqrt(dist2), 0.5) FILTER (rank = 3), 6) + 0 AS nn3_median,
           round(quantile_cont(sqrt(dist2), 0.5) FILTER (rank = 8), 6) + 0 AS nn8_median FROM knn8 GROUP BY 1""")
def _(spark, path):
    out = G.knn_distance_summary(fx.spots(spark, path))
    return out.select("slice", *[r6(f"nn{r}_median").alias(f"nn{r}_median") for r in (1, 3, 8)])


@query("edge_length_summary", """
    WITH u AS (SELECT slice, least(src, dst) a, greatest(src, dst) b, min(sqrt(dist2)) AS len FROM knn8 GROUP BY ALL)
    SELECT slice, count(*) AS n_edges, round(max(len), 6) + 0 AS max_length, round(quantile_cont(len, 0.5), 6) + 0 AS median_length,
           round(quantile_cont(len, 0.95), 6) + 0 AS p95_length FROM u GROUP BY 1""")
def _(spark, path):
    out = G.edge_length_summary(G.knn_join(fx.spots(spark, path), 8))
    return out.withColumns({c: r6(c) for c in ("max_length", "median_length", "p95_length")})


def location(df):
    """Coordinates as a two-element vector, for operators that take any embedding."""
    return df.withColumn("emb", F.array("x", "y"))


@query("aggregate_neighbours", """
    WITH b AS (SELECT slice, src, dst FROM pairs8 UNION SELECT slice, dst, src FROM pairs8),
    two AS (SELECT DISTINCT p.src, q.dst FROM b p JOIN b q ON p.dst = q.src WHERE p.src <> q.dst
            AND (p.src, q.dst) NOT IN (SELECT (src, dst) FROM b)),
    m1 AS (SELECT b.src, avg(x) AS x1, avg(y) AS y1 FROM b JOIN spots ON spot_id = dst GROUP BY 1),
    m2 AS (SELECT two.src, avg(x) AS x2, avg(y) AS y2 FROM two JOIN spots ON spot_id = dst GROUP BY 1)
    SELECT spot_id, slice, round(x, 6) + 0 AS f0, round(y, 6) + 0 AS f1, round(coalesce(x1, 0), 6) + 0 AS f2, round(coalesce(y1, 0), 6) + 0 AS f3,
           round(coalesce(x2, 0), 6) + 0 AS f4, round(coalesce(y2, 0), 6) + 0 AS f5
    FROM spots LEFT JOIN m1 ON m1.src = spot_id LEFT JOIN m2 ON m2.src = spot_id""")
def _(spark, path):
    spots = fx.spots(spark, path)
    out = G.aggregate_neighbours(location(spots), G.symmetrize(G.knn_join(spots, 8)), 2)
    return out.select("spot_id", "slice", *[r6(F.get("features", F.lit(i))).alias(f"f{i}") for i in range(6)])


COMPONENTS = """
    WITH RECURSIVE e AS (SELECT k.src, k.dst FROM knn8 k JOIN spots a ON a.spot_id = src JOIN spots b ON b.spot_id = dst
                         WHERE a.label = b.label AND rank <= 2),
    b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r(node, reach) AS (SELECT spot_id, spot_id FROM spots UNION SELECT r.node, b.dst FROM r JOIN b ON r.reach = b.src)
    SELECT node, min(reach) AS component FROM r GROUP BY 1"""


@query("connected_components", COMPONENTS)
def _(spark, path):
    spots = fx.spots(spark, path)
    label = spots.select("spot_id", "label")
    e = G.knn_join(spots, 2).join(label.toDF("src", "la"), "src").join(label.toDF("dst", "lb"), "dst").filter("la = lb")
    return G.connected_components(e, spots.select(F.col("spot_id").alias("node")))


MNN = """
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY src, dst_slice ORDER BY dist2, dst) AS rk FROM emb_pairs WHERE src_slice IN ('s0', 's1') AND dst_slice IN ('s0', 's1') AND src_slice <> dst_slice),
    n AS (SELECT * FROM x WHERE rk <= 5),
    m AS (SELECT a.src, a.dst, a.dist2 FROM n a JOIN n b ON a.src = b.dst AND a.dst = b.src WHERE a.src_slice = 's0')"""


@query("mnn_pairs", MNN + " SELECT 's0' AS \"left\", 's1' AS \"right\", src, dst, round(dist2, 6) + 0 AS dist2 FROM m")
def _(spark, path):
    return G.mnn_pairs(fx.embedding(spark, path), 5, fx.PAIRS).withColumn("dist2", r6("dist2"))


@query("mnn_correct", MNN + """,
    v AS (SELECT spot_id, unnest(emb) AS v, generate_subscripts(emb, 1) AS i FROM embedding),
    d AS (SELECT p.i, avg(p.v - q.v) AS d FROM m JOIN v p ON p.spot_id = src JOIN v q ON q.spot_id = dst AND q.i = p.i GROUP BY 1)
    SELECT slice, v.i - 1 AS pos, round(sum(v.v + CASE WHEN slice = 's1' THEN d.d ELSE 0 END), 5) + 0 AS total
    FROM v JOIN embedding USING (spot_id) JOIN d ON d.i = v.i GROUP BY 1, 2""")
def _(spark, path):
    out = G.mnn_correct(fx.embedding(spark, path), 5, fx.PAIRS)
    return out.select("slice", F.posexplode("emb").alias("pos", "v")).groupBy("slice", F.col("pos").cast("bigint").alias("pos")).agg(
        (F.round(F.sum("v"), 5) + F.lit(0.0)).alias("total"))
