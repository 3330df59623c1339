"""Assertions on joins and tables. Each one runs a small aggregate and raises on failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "key") -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"duplicate {what}: {', '.join(keys)} is not unique")


def assert_empty(df: DataFrame, message: str) -> None:
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}; first row: {row[0].asDict()}")


def validate_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                  validate: str = "many_to_one") -> DataFrame:
    """Join with the cardinality checked on the sides that must be unique."""
    if validate in ("many_to_one", "one_to_one"):
        assert_unique(right, on, "right join key")
    if validate in ("one_to_many", "one_to_one"):
        assert_unique(left, on, "left join key")
    return left.join(right, list(on), how)


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN sorts above every number in Spark, so metric tables carry NULL instead."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
