"""The data model: long DataFrames with implicit zeros."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: spots(spot_id, slice, label, slice_class, x, y); genes(gene, gene_index);
#: expr(slice, spot_id, gene, count, value) holds the non-zero entries only.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("n_slices", T.LongType()),
        T.StructField("fs_method", T.StringType()),
        T.StructField("n_features", T.StringType()),
        T.StructField("integration_method", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("random_seed", T.LongType()),
        T.StructField("runtime", T.DoubleType()),
        T.StructField("memory_usage", T.DoubleType()),
        T.StructField("effective_n_features", T.LongType()),
        T.StructField("notes", T.StringType()),
    ]
)

SELECTION_SCHEMA = T.StructType(
    [
        T.StructField("method_name", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("feature_indices", T.ArrayType(T.LongType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class SpatialData:
    """One dataset: spots, genes and non-zero expression triples, all lazy."""

    spots: DataFrame
    genes: DataFrame
    expr: DataFrame
    pairs: tuple[tuple[str, str], ...] = field(default=())
    entries: int | None = None  # rows of a stored expr, which size the shuffles of its entries

    def with_expr(self, expr: DataFrame) -> "SpatialData":
        return replace(self, expr=expr)

    def slice_sizes(self) -> DataFrame:
        """Spots per slice, the `n` of every zero-aware moment."""
        return self.spots.groupBy("slice").agg(F.count("*").alias("n_spots"))
