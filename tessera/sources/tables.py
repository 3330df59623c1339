"""Dataset and matrix sources: parquet bundles, wide text matrices, coordinate-format matrices, gene lists."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.checks import assert_empty
from tessera.model import SpatialData
from tessera.session import cut_lineage, spread_rows

SPOTS = "spot_id string, slice string, label string, slice_class string, x double, y double"
GENES = "gene string, gene_index bigint"
EXPR = "slice string, spot_id string, gene string, count double, value double"


def load_dataset(spark: SparkSession, path: str, keys: dict[str, str] | None = None) -> SpatialData:
    """Read a spots/genes/expr parquet bundle. `keys` maps model names (slice, label, ...) to the
    column names used in the files; label columns that are absent become NULL."""
    keys = keys or {}

    def read(name: str, schema: str) -> DataFrame:
        df = spark.read.parquet(os.path.join(path, name))
        fields = T.StructType.fromDDL(schema)
        out = []
        for f in fields:
            source = keys.get(f.name, f.name)
            if source in df.columns:
                out.append(F.col(source).cast(f.dataType).alias(f.name))
            elif f.name in ("label", "slice_class", "value"):
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                raise ValueError(f"{name}: column {source} is missing")
        return df.select(*out)

    return SpatialData(read("spots", SPOTS), read("genes", GENES), read("expr", EXPR))


def save_dataset(ds: SpatialData, path: str) -> None:
    """Write the bundle; `expr` is partitioned by slice (filters prune folders) and all entries of a
    (slice, gene) pair lie together in one sorted file, so per-gene sums combine before any shuffle."""
    ds.spots.write.mode("overwrite").parquet(os.path.join(path, "spots"))
    ds.genes.write.mode("overwrite").parquet(os.path.join(path, "genes"))
    by_gene = spread_rows(ds.expr, ds.entries, "slice", "gene")
    by_gene = ds.expr.repartition("slice", "gene") if by_gene is ds.expr else by_gene
    (by_gene.sortWithinPartitions("slice", "gene")
     .write.mode("overwrite").partitionBy("slice").parquet(os.path.join(path, "expr")))


def melt_wide(wide: DataFrame, gene_col: str = "gene") -> DataFrame:
    """Gene x spot wide table to non-zero triples (column position kept for coordinate joins)."""
    spots = [c for c in wide.columns if c != gene_col]
    # one posexplode over an array keeps the plan small for tens of thousands of columns
    entries = F.array(*[F.struct(F.lit(c).alias("spot_id"), F.col(f"`{c}`").cast("double").alias("count"))
                        for c in spots])
    return (wide.select(F.col(gene_col).alias("gene"), F.posexplode(entries).alias("pos", "e"))
            .select("gene", "pos", F.col("e.spot_id"), F.col("e.count")).filter("count <> 0"))


def read_wide_matrix(spark: SparkSession, path: str, sep: str = "\t", gene_col: str | None = None) -> DataFrame:
    """Text matrix with a header of spot names and genes in the first column (gz accepted)."""
    lines = spark.read.text(path)
    header = spark.read.option("sep", sep).option("header", True).csv(path).columns
    names = F.array(*[F.lit(c) for c in header[1:]])
    parts = F.split("value", sep)
    first = F.lit(gene_col or header[0])
    return (lines.select(F.element_at(parts, 1).alias("gene"),
                         F.posexplode(F.slice(parts, 2, len(header) - 1)).alias("pos", "text"))
            .filter(F.col("gene") != first)
            .select("gene", "pos", F.element_at(names, F.col("pos") + 1).alias("spot_id"),
                    F.col("text").cast("double").alias("count"))
            .filter("count <> 0"))


def attach_coords_by_position(names: DataFrame, coords: DataFrame, pos: str = "pos") -> DataFrame:
    """The i-th coordinate row belongs to the i-th spot column. Both sides carry an explicit `pos`;
    a position found on one side only is an error."""
    assert_empty(names.join(coords, pos, "left_anti").select(pos), "spot without a coordinate row")
    assert_empty(coords.join(names, pos, "left_anti").select(pos), "coordinate row without a spot")
    return names.join(coords, pos)


def attach_obs(expr_spots: DataFrame, obs: DataFrame, key: str = "spot_id") -> DataFrame:
    """Keyed metadata join; a spot without metadata is an error."""
    assert_empty(expr_spots.join(obs, key, "left_anti").select(key), "spot without metadata")
    return expr_spots.join(obs, key, "left")


def parse_matrix_market(lines: DataFrame) -> DataFrame:
    """Coordinate-format lines (column `value`) to (row, col, count), 1-based; comments dropped."""
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    return body.select("line", f[0].cast("bigint").alias("row"), f[1].cast("bigint").alias("col"),
                       f[2].cast("double").alias("count"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of text files with their 1-based numbers, files one after the other by name.

    Files are read in splits. A line's number is its place in its split plus the lines of all splits before it, so no file
    is one row or one task; only counts per split are ordered."""
    split = ["file", "start"]
    # stored, so that ids and counts come from one reading
    rows = cut_lineage(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                                    F.monotonically_increasing_id().alias("id")))
    sizes = rows.groupBy(*split).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("before", before), split).select("value", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"))


def read_matrix_market(spark: SparkSession, matrix: str, genes: str, spots: str, size_line: bool = True) -> DataFrame:
    """Matrix-Market triples with one-name-per-line gene and spot files. A single file holds a size line as
    its first line after the comments; the `body` folder of `write_matrix_market` has none."""
    lines = spark.read.text(matrix)
    if size_line:
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        lines = lines.withColumn("line", place)
    else:
        lines = lines.withColumn("line", F.lit(0))
    body = parse_matrix_market(lines)
    if size_line:
        body = body.filter(F.col("line") != body.select(F.min("line")).scalar())

    def indexed(path: str, name: str, index: str) -> DataFrame:
        return numbered_lines(spark, path).select(F.col("line").alias(index), F.trim(F.rtrim("value")).alias(name))

    return (body.join(indexed(genes, "gene", "row"), "row").join(indexed(spots, "spot_id", "col"), "col")
            .select("gene", "spot_id", "count"))


def to_matrix_market(expr: DataFrame, genes: DataFrame, spots: DataFrame) -> DataFrame:
    """Matrix-Market text lines `row col value`, ordered, from indexed gene and spot tables."""
    return (expr.join(genes, "gene").join(spots, "spot_id")
            .select((F.col("gene_index") + 1).alias("row"), (F.col("spot_index") + 1).alias("col"), "count")
            .select("row", "col", F.concat_ws(" ", "row", "col", F.col("count").cast("bigint")).alias("line")))


def write_matrix_market(expr: DataFrame, genes: DataFrame, spots: DataFrame, path: str) -> None:
    """Part files of triples under `path/body`, and the header with the size line under `path/header`."""
    lines = to_matrix_market(expr, genes, spots)
    size = lines.agg(F.count("*").alias("nnz"))
    head = size.select(F.concat(
        F.lit("%%MatrixMarket matrix coordinate integer general\n"),
        F.concat_ws(" ", genes.select(F.count("*")).scalar(), spots.select(F.count("*")).scalar(), "nnz")).alias("line"))
    head.write.mode("overwrite").text(os.path.join(path, "header"))
    lines.sort("col", "row").select("line").write.mode("overwrite").text(os.path.join(path, "body"))


def read_gene_list(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Transcription-factor lists (Species, Gene, ENSEMBL) and marker tables: header, all strings."""
    return spark.read.option("sep", sep).option("header", True).csv(path)


def make_unique(df: DataFrame, name: str = "gene", index: str = "gene_index", sep: str = "-") -> DataFrame:
    """Repeated names get `-1`, `-2`, ... in index order; the first keeps its name."""
    seen = F.row_number().over(Window.partitionBy(name).orderBy(index)) - 1
    return df.withColumn("_seen", seen).withColumn(
        name, F.when(F.col("_seen") == 0, F.col(name)).otherwise(F.concat_ws(sep, name, F.col("_seen")))).drop("_seen")


