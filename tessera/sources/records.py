"""Metric records, selections and result tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.checks import nan_to_null
from tessera.model import RECORD_SCHEMA, SELECTION_SCHEMA

METRIC_KEY = ["dataset", "fs_method", "n_features", "integration_method", "task", "metric_name", "random_seed"]


def write_records(records: DataFrame, path: str) -> None:
    records.select(*RECORD_SCHEMA.names).write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.schema(RECORD_SCHEMA).json(path), "metric_value")


def canonical_features(method: Column | str = "fs_method", n: Column | str = "n_features") -> Column:
    """`all_features` stored with n = 1 is shown as `all`; whole numbers lose their decimals."""
    method, n = F.col(method) if isinstance(method, str) else method, F.col(n) if isinstance(n, str) else n
    text = n.cast("string")
    return (F.when(F.lower(text) == "all", "all")
            .when((method == "all_features") & (text.try_cast("double") == 1), "all")
            .otherwise(F.regexp_replace(text, r"\.0+$", "")))


def rebuild_results(spark: SparkSession, glob: str) -> DataFrame:
    return relabel_results(read_records(spark, glob))


def relabel_results(records: DataFrame) -> DataFrame:
    return records.withColumn("n_features", canonical_features())


def merge_results(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def selection_json(ranking: DataFrame, by: Sequence[str], method: str = "method") -> DataFrame:
    """One JSON selection per group: ordered names, indices, scores and metadata."""
    entry = F.struct("rank", "gene", "gene_index", "score")
    ordered = F.sort_array(F.collect_list(entry))
    body = ranking.groupBy(*by).agg(ordered.alias("_g"))
    names = F.transform("_g", lambda e: e["gene"])
    payload = F.struct(
        F.col(method).alias("method_name"), names.alias("feature_names"),
        F.transform("_g", lambda e: e["gene_index"]).alias("feature_indices"),
        F.transform("_g", lambda e: e["score"]).alias("scores"),
        F.create_map(F.lit("effective_n_features"), F.size("_g").cast("string"),
                     F.lit("feature_hash"), F.md5(F.array_join(names, "\n"))).alias("metadata"))
    return body.select(*by, F.to_json(payload).alias("selection"))


def write_selection(ranking: DataFrame, by: Sequence[str], path: str) -> None:
    selection_json(ranking, by).select("selection").write.mode("overwrite").text(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTION_SCHEMA).json(path)


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash: each row's sha256 is cut to 60 bits and summed
    as decimal, so it needs one partial aggregate and no sort."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("sha256"))


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> DataFrame:
    """Write every table and a manifest of row counts and content hashes."""
    manifest = None
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        target = os.path.join(path, name)
        writer.option("header", True).option("sep", "\t").csv(target) if fmt == "csv" else writer.parquet(target)
        row = table_digest(df).select(F.lit(name).alias("table_name"), "n_rows", "sha256")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").json(os.path.join(path, "manifest"))
    return manifest


def replace_rows(results: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `results` whose key appears in `new` give way to the new rows."""
    kept = results.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).sort(*[k for k in METRIC_KEY if k in results.columns])


def curate(results: DataFrame, invalid: DataFrame, keys: Sequence[str] = ("fs_method",)) -> DataFrame:
    """Set values of known-invalid settings to NULL and append the reason to the notes."""
    joined = results.join(invalid.select(*keys, "reason"), list(keys), "left")
    bad = F.col("reason").isNotNull()
    return joined.withColumns({
        "metric_value": F.when(~bad, F.col("metric_value")),
        "notes": F.when(bad, F.concat_ws(" | ", F.nullif("notes", F.lit("")), "reason")).otherwise(F.col("notes")),
    }).drop("reason")


def with_effective(results: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effective feature count from selection metadata, else the requested number."""
    looked_up = meta.select(*keys, F.col("effective_n_features").alias("_eff"))
    asked = F.col("n_features").try_cast("bigint")
    return results.join(looked_up, list(keys), "left").withColumn(
        "effective_n_features", F.coalesce("_eff", asked)).drop("_eff")
