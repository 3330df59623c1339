"""Queries over embeddings. Decompositions have no SQL twin; they report order-free scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.operators import embed as E
from tessera.operators import variable as V
from tessera.operators.ranking import top_features
from tessera.plans import fixtures as fx
from tessera.plans.registry import query


def _features(ds, n=60):
    return top_features(V.hvg_seurat(ds), n).select("gene")


def _spread(emb):
    """Sum of variances per component: independent of the sign of components."""
    long = emb.select("slice", F.posexplode("emb").alias("component", "v"))
    return long.groupBy("slice", "component").agg(F.var_pop("v").alias("variance"), F.count("*").alias("n"))


@query("pca_embed")
def _(spark, path):
    ds = fx.dataset(spark, path)
    emb, _ = E.pca_embed(ds, _features(ds), 10)
    return _spread(emb)


@query("svd_embed")
def _(spark, path):
    ds = fx.dataset(spark, path)
    return _spread(E.svd_embed(ds, _features(ds), 10))


@query("scale_pca")
def _(spark, path):
    ds = fx.dataset(spark, path)
    return _spread(E.scale_pca(ds, _features(ds), 10))


@query("combat", """
    WITH grid AS (SELECT slice, gene, n_spots::DOUBLE AS nb FROM slice_sizes CROSS JOIN genes),
    m AS (SELECT slice, gene, nb, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM grid LEFT JOIN
          (SELECT slice, gene, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY 1, 2) USING (slice, gene)),
    w AS (SELECT *, sum(s) OVER g / n AS grand, sqrt(sum(greatest(q - s * s / nb, 0)) OVER g / n) AS sd, greatest(q - s * s / nb, 0) AS ss
          FROM m, (SELECT count(*)::DOUBLE AS n FROM spots) WINDOW g AS (PARTITION BY gene)),
    h AS (SELECT *, (s / nb - grand) / sd AS gh, greatest(coalesce(ss / nullif((nb - 1) * sd * sd, 0), NULL), 1e-6) AS dh FROM w WHERE sd > 1e-12),
    pr AS (SELECT slice, avg(gh) AS gb, var_samp(gh) AS t2, avg(dh) AS dm, var_samp(dh) AS dv FROM h GROUP BY 1),
    p AS (SELECT h.*, gb, t2, (2 * dv + dm * dm) / dv AS a, (dm * dv + dm * dm * dm) / dv AS b FROM h JOIN pr USING (slice)),
    it AS (SELECT *, list_reduce([[gh, dh]] || list_transform(range(30), lambda i: [gh, dh]), lambda acc, e:
             [(t2 * nb * gh + acc[2] * gb) / (t2 * nb + acc[2]),
              (0.5 * (dh * (nb - 1) + nb * pow(gh - (t2 * nb * gh + acc[2] * gb) / (t2 * nb + acc[2]), 2)) + b) / (nb / 2 + a - 1)]) AS st FROM p)
    SELECT slice, gene, round(1 / sqrt(st[2]), 5) + 0 AS scale, round(grand - grand / sqrt(st[2]) - sd * st[1] / sqrt(st[2]), 5) + 0 AS zero_value FROM it""")
def _(spark, path):
    ds = fx.dataset(spark, path)
    _, maps = E.combat(ds)
    return maps.select("slice", "gene", (F.round("scale", 5) + F.lit(0.0)).alias("scale"), (F.round("zero_value", 5) + F.lit(0.0)).alias("zero_value"))


@query("combat_pca")
def _(spark, path):
    ds = fx.dataset(spark, path)
    return _spread(E.combat_pca(ds, _features(ds), 10)[0])


@query("harmony")
def _(spark, path):
    return _spread(E.harmony(fx.embedding(spark, path), clusters=10, rounds=2, inner=2))


@query("slice_embedding", """
    SELECT slice, i - 1 AS pos, round(avg(v), 6) + 0 AS mean FROM (SELECT slice, unnest(emb) AS v, generate_subscripts(emb, 1) AS i FROM embedding) GROUP BY 1, 2""")
def _(spark, path):
    return E.slice_embedding(fx.embedding(spark, path)).select("slice", F.posexplode("emb").alias("pos", "v")).select(
        "slice", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("mean"))


@query("align_embedding", """
    SELECT doc_id AS spot_id, round(list_sum(emb), 5) + 0 AS total FROM labels LEFT JOIN embedding ON spot_id = doc_id""")
def _(spark, path):
    spots = fx.table(spark, path, "labels").select(F.col("doc_id").alias("spot_id"))
    out = E.align_embedding(fx.embedding(spark, path), spots, check=False)
    return out.select("spot_id", (F.round(F.aggregate("emb", F.lit(0.0), lambda a, v: a + v), 5) + F.lit(0.0)).alias("total"))
