"""Spatial datasets, embeddings, records and rankings derived from the warehouse tables.

Each fixture exists twice: as DataFrames here, and as SQL common table expressions in
`tessera.plans.fixture_sql`, built by the same rules.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.model import SpatialData
from tessera.operators.prepare import annotate_slice_class, log1p, normalize_total
from tessera.operators.scoring import metric_metadata
from tessera.session import spread_rows
from tessera.sources.tables import save_dataset

PAIRS = (("s0", "s1"),)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def gene_name() -> "F.Column":
    return F.concat_ws("-", "p_type", F.col("p_size").cast("string"))


def spots(spark: SparkSession, path: str, with_class: bool = False) -> DataFrame:
    region = table(spark, path, "nation").join(
        table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = table(spark, path, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("spot_id"), F.col("c_mktsegment").alias("slice"),
        (F.col("c_custkey") % 40).cast("double").alias("x"),
        F.floor(F.col("c_custkey") / 40).cast("double").alias("y"), F.col("r_name").alias("label"))
    return annotate_slice_class(base, {"A": 3, "B": 2}, strict=False) if with_class else base


def genes(spark: SparkSession, path: str) -> DataFrame:
    names = table(spark, path, "part").select(gene_name().alias("gene")).distinct()
    # the gene dictionary is small by nature: its index is the position in one sorted array
    return names.agg(F.sort_array(F.collect_set("gene")).alias("g")).select(
        F.posexplode("g").alias("gene_index", "gene")).select("gene", F.col("gene_index").cast("bigint"))


def customers(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "customer").select(F.col("c_custkey").alias("spot_id"), F.col("c_mktsegment").alias("slice"))


def sales(spark: SparkSession, path: str, placed: DataFrame) -> tuple[DataFrame, int]:
    """Lines by part, with the columns of their order in `placed`, and the number of lines, which the files of the table tell. A shuffle of
    lines has as many partitions as they need."""
    lines = table(spark, path, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    n = lines.count()
    joined = spread_rows(lines, n, "l_orderkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    return spread_rows(joined, n, "l_partkey"), n


def counts(spark: SparkSession, path: str) -> DataFrame:
    lines, n = sales(spark, path, table(spark, path, "orders").select("o_orderkey", F.col("o_custkey").alias("spot_id")))
    part = table(spark, path, "part").select("p_partkey", gene_name().alias("gene"))
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("spot_id", "gene", "l_quantity")
    # segments join where the lines of a spot lie together, so no other shuffle carries them
    return spread_rows(named, n, "spot_id").join(customers(spark, path), "spot_id").groupBy("slice", "spot_id", "gene").agg(
        F.sum("l_quantity").alias("count"))


def expr(spark: SparkSession, path: str) -> DataFrame:
    return log1p(normalize_total(counts(spark, path)))


_STORED: dict[tuple[str, str], tuple[str, int]] = {}


def dataset(spark: SparkSession, path: str) -> SpatialData:
    """The dataset as a stored bundle: derived from the tables once per session, then read with column
    pruning by every operator, as a user keeps a prepared dataset and ranks it many times."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _STORED:
        base = scratch(spark)
        lines = table(spark, path, "lineitem").count()
        save_dataset(SpatialData(spots(spark, path), genes(spark, path), expr(spark, path), entries=lines), base)
        _STORED[key] = base, spark.read.parquet(f"{base}/expr").count()
    base, entries = _STORED[key]
    return replace(read_dataset(spark, base), entries=entries)


def read_dataset(spark: SparkSession, base: str) -> SpatialData:
    return SpatialData(*[spark.read.parquet(f"{base}/{name}") for name in ("spots", "genes", "expr")])


def scratch(spark: SparkSession) -> str:
    """A fresh folder: in the shared checkpoint folder of a cluster, else a local temporary one (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return f"{shared.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def embedding(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "embeddings").select(
        F.col("vec_id").alias("spot_id"),
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("slice"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("emb"))


def records(spark: SparkSession, path: str) -> DataFrame:
    lines = table(spark, path, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, path, "part").select("p_partkey", F.col("p_brand").alias("fs_method"))
    customer = table(spark, path, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    meta = metric_metadata(spark).select("metric_number", "metric_name", F.col("task_group").alias("task"), "needs_label")
    base = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("metric_number", (F.col("l_suppkey") % 13).cast("int"))
            .groupBy("dataset", "fs_method", F.col("l_linestatus").alias("integration_method"), "metric_number",
                     (F.col("l_orderkey") % 3).alias("random_seed"))
            .agg(F.avg(F.col("l_discount") + F.col("l_tax")).alias("raw_value"),
                 F.avg("l_quantity").alias("runtime"), F.avg("l_extendedprice").alias("memory_usage"),
                 F.count("*").alias("effective_n_features")))
    # rounded once, so both engines rank and compare the same stored value
    value = F.round("raw_value", 9)
    unlabelled = (F.col("dataset") == "MACHINERY") & F.col("needs_label")
    return base.join(F.broadcast(meta), "metric_number").select(
        "dataset", F.lit("grid").alias("platform"), F.lit(1).cast("bigint").alias("n_slices"), "fs_method",
        F.when(F.col("fs_method") == "Brand#1", "all").otherwise("2000").alias("n_features"),
        "integration_method", "task", "metric_name", F.when(~unlabelled, value).alias("metric_value"),
        "random_seed", "runtime", "memory_usage", "effective_n_features", F.lit("").alias("notes"))


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, method, gene, gene_index, score, rank): genes of each segment and brand by total quantity."""
    from tessera.operators.ranking import top_features

    orders = table(spark, path, "orders")
    placed = spread_rows(orders.select("o_orderkey", F.col("o_custkey").alias("spot_id")), orders.count(), "spot_id").join(
        customers(spark, path), "spot_id").select("o_orderkey", F.col("slice").alias("dataset"))
    lines, _ = sales(spark, path, placed)
    part = table(spark, path, "part").select("p_partkey", F.col("p_brand").alias("method"), gene_name().alias("gene"))
    # lines of a part are added up before they meet its names
    sold = lines.groupBy("dataset", "l_partkey").agg(F.sum("l_quantity").alias("sold"))
    scores = (sold.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy("dataset", "method", "gene").agg(F.sum("sold").alias("score")))
    return top_features(scores.join(genes(spark, path), "gene"), None, by=["dataset", "method"])


def gene_sums(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, method, gene, score, entries): total quantity of a gene in each segment and brand, and its stored entries (spots that have it).
    A gene of several brands counts its entry with the first of them, so the entries of a gene add up to its rows in `expr`.
    Both come from one pass over the lines, for queries that need the sums only and no stored dataset."""
    lines, n = sales(spark, path, table(spark, path, "orders").select("o_orderkey", F.col("o_custkey").alias("spot_id")))
    names = genes(spark, path).select("gene", F.col("gene_index").cast("int").alias("g"))
    part = table(spark, path, "part").select("p_partkey", F.col("p_brand").alias("method"), gene_name().alias("gene")).join(names, "gene")
    # a line carries the number of its gene, not the name
    named = lines.join(part.drop("gene"), F.col("l_partkey") == F.col("p_partkey")).select("spot_id", "g", "method", "l_quantity")
    placed = spread_rows(named, n, "spot_id").join(customers(spark, path), "spot_id")
    sold = placed.groupBy("spot_id", "slice", "g", "method").agg(F.sum("l_quantity").alias("_q"))
    # a spot has at most a few rows per gene
    first = F.min("method").over(Window.partitionBy("spot_id", "slice", "g"))
    sums = sold.withColumn("_first", first).groupBy(F.col("slice").alias("dataset"), "method", "g").agg(
        F.sum("_q").alias("score"), F.count_if(F.col("method").eqNullSafe(F.col("_first"))).alias("entries"))
    return sums.join(names, "g").drop("g")
