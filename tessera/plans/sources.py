"""Queries over sources, sinks and result tables. File round trips go through a folder of their own."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import scratch
from tessera.plans.registry import query
from tessera.sources import records as R
from tessera.sources import tables as T


@query("load_dataset", """
    SELECT slice, label, gene, sum(count)::DOUBLE AS total, count(*) AS n, round(sum(value), 5) + 0 AS value FROM expr JOIN spots USING (spot_id, slice) GROUP BY 1, 2, 3""")
def _(spark, path):
    ds = fx.dataset(spark, path)
    base = scratch(spark)
    T.save_dataset(ds, base)
    back = T.load_dataset(spark, base)
    return back.expr.join(back.spots.select("spot_id", "label"), "spot_id").groupBy("slice", "label", "gene").agg(
        F.sum("count").alias("total"), F.count("*").alias("n"), (F.round(F.sum("value"), 5) + F.lit(0.0)).alias("value"))


WIDE = "SELECT gene, slice AS spot_id, sum(count)::DOUBLE AS count FROM counts GROUP BY 1, 2"


def _wide(spark, path):
    slices = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return fx.counts(spark, path).groupBy("gene").pivot("slice", slices).agg(F.sum("count")).na.fill(0.0)


@query("melt_wide", WIDE)
def _(spark, path):
    return T.melt_wide(_wide(spark, path)).select("gene", "spot_id", "count")


@query("read_wide_matrix", WIDE)
def _(spark, path):
    out = os.path.join(scratch(spark), "wide")
    _wide(spark, path).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(out)
    return T.read_wide_matrix(spark, out).select("gene", "spot_id", "count")


@query("coords_by_position", """
    WITH n AS (SELECT c_custkey AS spot_id, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), c AS (SELECT o_orderkey % (SELECT count(*) FROM customer) AS pos, max(o_totalprice) AS x FROM orders GROUP BY 1)
    SELECT spot_id, n.pos, round(x, 6) + 0 AS x FROM n JOIN c USING (pos)""")
def _(spark, path):
    # customer keys are dense, so the key is the position
    customer = fx.table(spark, path, "customer")
    names = customer.select(F.col("c_custkey").alias("spot_id"), F.col("c_custkey").alias("pos"))
    n = customer.select(F.count("*")).scalar()
    coords = fx.table(spark, path, "orders").select((F.col("o_orderkey") % n).alias("pos"), "o_totalprice").groupBy("pos").agg(F.max("o_totalprice").alias("x"))
    return T.attach_coords_by_position(names, coords).select("spot_id", "pos", r6("x").alias("x"))


@query("attach_obs", "SELECT s.slice, s.label, count(*) AS n, sum(count)::DOUBLE AS total FROM counts JOIN spots s USING (spot_id) GROUP BY 1, 2")
def _(spark, path):
    obs = fx.spots(spark, path).select("spot_id", "label")
    return T.attach_obs(fx.counts(spark, path), obs).groupBy("slice", "label").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query("matrix_market", "SELECT gene, slice AS spot_id, sum(count)::DOUBLE AS count FROM counts GROUP BY 1, 2")
def _(spark, path):
    base = scratch(spark)
    x = fx.counts(spark, path).groupBy("gene", F.col("slice").alias("spot_id")).agg(F.sum("count").alias("count"))
    genes = fx.genes(spark, path)
    names = x.agg(F.sort_array(F.collect_set("spot_id")).alias("s"))
    spots = names.select(F.posexplode("s").alias("spot_index", "spot_id"))
    T.write_matrix_market(x, genes, spots, os.path.join(base, "m"))
    # name files: one line per name, in index order
    for name, df, key in (("genes", genes, "gene"), ("spots", spots, "spot_id")):
        df.agg(F.sort_array(F.collect_list(key)).alias("n")).select(F.array_join("n", "\n").alias("value")).write.text(os.path.join(base, name))
    return T.read_matrix_market(spark, os.path.join(base, "m", "body"), os.path.join(base, "genes"), os.path.join(base, "spots"), size_line=False)


@query("read_gene_list", "SELECT CASE WHEN p_brand = 'Brand#3' THEN 'Human' ELSE 'Mouse' END AS \"Species\", p_type || '-' || p_size AS \"Gene\", 'ENS' || p_partkey AS \"ENSEMBL\" FROM part")
def _(spark, path):
    out = os.path.join(scratch(spark), "list")
    fx.table(spark, path, "part").select(
        F.when(F.col("p_brand") == "Brand#3", "Human").otherwise("Mouse").alias("Species"), fx.gene_name().alias("Gene"),
        F.concat(F.lit("ENS"), F.col("p_partkey").cast("string")).alias("ENSEMBL")).write.option("sep", "\t").option("header", True).csv(out)
    return T.read_gene_list(spark, out)


@query("selection_json", """
    SELECT method AS method_name, count(*) AS n, md5(string_agg(gene, chr(10) ORDER BY rank)) AS feature_hash, min(gene) FILTER (rank = 1) AS first_gene, round(sum(score), 6) + 0 AS total FROM rankings WHERE rank <= 25 GROUP BY dataset, method""")
def _(spark, path):
    out = os.path.join(scratch(spark), "selections")
    R.write_selection(fx.rankings(spark, path).filter("rank <= 25"), ["dataset", "method"], out)
    back = R.read_selection(spark, out)
    return back.select("method_name", F.col("metadata")["effective_n_features"].cast("bigint").alias("n"), F.col("metadata")["feature_hash"].alias("feature_hash"),
                       F.element_at("feature_names", 1).alias("first_gene"), r6(F.aggregate("scores", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("record_files", """
    SELECT dataset, task, metric_name, count(*) AS n, count(metric_value) AS n_finite, round(sum(metric_value), 5) + 0 AS total FROM records GROUP BY 1, 2, 3""")
def _(spark, path):
    out = os.path.join(scratch(spark), "records")
    R.write_records(fx.records(spark, path), out)
    return R.read_records(spark, out).groupBy("dataset", "task", "metric_name").agg(
        F.count("*").alias("n"), F.count("metric_value").alias("n_finite"), (F.round(F.sum("metric_value"), 5) + F.lit(0.0)).alias("total"))


@query("rebuild_results", """
    SELECT m AS fs_method, CASE WHEN m = 'all_features' THEN 'all' ELSE n END AS n_features, count(*) AS n FROM (
      SELECT CASE WHEN fs_method = 'Brand#1' THEN 'all_features' ELSE fs_method END AS m, CASE WHEN fs_method = 'Brand#1' THEN '1' ELSE '2000' END AS n FROM records) GROUP BY 1, 2""")
def _(spark, path):
    base = scratch(spark)
    r = fx.records(spark, path).withColumns({
        "n_features": F.when(F.col("fs_method") == "Brand#1", "1").otherwise("2000.0"),
        "fs_method": F.when(F.col("fs_method") == "Brand#1", "all_features").otherwise(F.col("fs_method"))})
    for i in (0, 1):
        R.write_records(r.filter(F.col("random_seed") % 2 == i), os.path.join(base, f"run{i}"))
    return R.rebuild_results(spark, os.path.join(base, "run*")).groupBy("fs_method", "n_features").agg(F.count("*").alias("n"))


@query("merge_results", "SELECT dataset, count(*) AS n, count(CASE WHEN integration_method = 'F' THEN runtime END) AS n_runtime FROM records GROUP BY 1")
def _(spark, path):
    r = fx.records(spark, path)
    out = R.merge_results(r.filter("integration_method = 'F'"), r.filter("integration_method = 'O'").drop("runtime"))
    return out.groupBy("dataset").agg(F.count("*").alias("n"), F.count("runtime").alias("n_runtime"))


@query("write_tables", """
    SELECT 'records' AS table_name, (SELECT count(*) FROM records) AS n_rows, true AS same_hash UNION ALL SELECT 'rankings', (SELECT count(*) FROM rankings), true""")
def _(spark, path):
    base = scratch(spark)
    t = {"records": fx.records(spark, path).select("dataset", "fs_method", "metric_name", "random_seed"), "rankings": fx.rankings(spark, path)}
    manifest = R.write_tables(t, base, "parquet")
    back = [R.table_digest(spark.read.parquet(os.path.join(base, n))).select(F.lit(n).alias("table_name"), F.col("sha256").alias("again")) for n in t]
    return manifest.join(back[0].unionByName(back[1]), "table_name").select("table_name", "n_rows", (F.col("sha256") == F.col("again")).alias("same_hash"))


@query("make_unique", """
    SELECT p_partkey, CASE WHEN k = 0 THEN g ELSE g || '-' || k END AS gene FROM (SELECT p_partkey, p_type || '/' || p_size AS g, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) - 1 AS k FROM part)""")
def _(spark, path):
    p = fx.table(spark, path, "part").select("p_partkey", F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("gene"))
    return T.make_unique(p, "gene", "p_partkey")


@query("replace_rows", """
    SELECT dataset, task, count(*) AS n, round(sum(CASE WHEN task = 'Alignment' AND dataset <> 'HOUSEHOLD' THEN 1 ELSE metric_value END), 5) + 0 AS total FROM records GROUP BY 1, 2""")
def _(spark, path):
    r = fx.records(spark, path)
    new = r.filter("task = 'Alignment' AND dataset <> 'HOUSEHOLD'").withColumn("metric_value", F.lit(1.0))
    return R.replace_rows(r, new, R.METRIC_KEY).groupBy("dataset", "task").agg(F.count("*").alias("n"), (F.round(F.sum("metric_value"), 5) + F.lit(0.0)).alias("total"))


@query("curate", """
    SELECT fs_method, n, CASE WHEN fs_method = 'Brand#2' THEN 0 ELSE f END AS n_finite, CASE WHEN fs_method = 'Brand#2' THEN 'seed ' || 1 || ' | invalid' ELSE 'seed 1' END AS note
    FROM (SELECT fs_method, count(*) AS n, count(metric_value) AS f FROM records GROUP BY 1)""")
def _(spark, path):
    r = fx.records(spark, path).withColumn("notes", F.lit("seed 1"))
    invalid = r.filter("fs_method = 'Brand#2'").select("fs_method", F.lit("invalid").alias("reason")).distinct()
    return R.curate(r, invalid).groupBy("fs_method").agg(F.count("*").alias("n"), F.count("metric_value").alias("n_finite"), F.max("notes").alias("note"))


@query("with_effective", """
    SELECT dataset, fs_method, max(CASE WHEN fs_method = 'Brand#1' THEN 0 WHEN fs_method < 'Brand#2' THEN 150 ELSE 2000 END)::BIGINT AS effective FROM records GROUP BY 1, 2""")
def _(spark, path):
    r = fx.records(spark, path).drop("effective_n_features")
    meta = r.filter("fs_method < 'Brand#2' AND fs_method <> 'Brand#1'").select("dataset", "fs_method").distinct().withColumn("effective_n_features", F.lit(150).cast("bigint"))
    return R.with_effective(r, meta, ["dataset", "fs_method"]).groupBy("dataset", "fs_method").agg(F.coalesce(F.max("effective_n_features"), F.lit(0)).alias("effective"))
