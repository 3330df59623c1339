"""Ranks with average ties, Spearman and Benjamini-Hochberg."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def avg_rank(column: str, by: Sequence[str] = (), ascending: bool = True) -> Column:
    """Average-tie rank inside `by`; NULL stays NULL. For groups bounded by a dictionary
    (genes of a slice, methods of a dataset); `spread_rank` is for groups of data rows."""
    value = F.col(column)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    ordered = Window.partitionBy(*by).orderBy(order)
    ties = Window.partitionBy(*by, column)
    return F.when(value.isNotNull(), F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2)


def _ordered_values(df: DataFrame, column: str, by: list[str], rows_per_range: int = 100_000) -> DataFrame:
    """Distinct values of each group with their count and first 0-based row position.

    Equal values are counted first. A group with many distinct values is cut into ranges (at most 256) from
    an approximate quantile sketch; the ranges are ordered apart and shifted by the number of rows in lower
    ranges, so no task sorts a whole large group and positions stay exact."""
    parts = 256
    probs = [i / parts for i in range(1, parts)]
    ties = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_ties"))
    sketch = ties.groupBy(*by).agg(F.percentile_approx(column, probs, 2000).alias("_q"), F.count("*").alias("_d"))
    k = F.least(F.ceil(F.col("_d") / rows_per_range).cast("int"), F.lit(parts))
    picked = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: F.element_at("_q", (i * parts / k).cast("int")))
    cuts = sketch.select(*by, F.when(k > 1, picked).alias("_cuts"))
    inside_cuts = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
    ranged = ties.join(cuts, by).withColumn(
        "_range", F.when(F.col("_cuts").isNull(), 0).otherwise(inside_cuts)).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy(*by, "_range").agg(F.sum("_ties").alias("_n")).select(
        *by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    inside = Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(shift, [*by, "_range"]).select(
        *by, column, "_ties", "_size",
        (F.col("_shift") + F.sum("_ties").over(inside) - F.col("_ties")).alias("_first"))


def spread_rank(df: DataFrame, column: str, by: Sequence[str], name: str, rows_per_range: int = 100_000) -> DataFrame:
    """Average-tie rank of groups of data rows, without sorting a group in one task."""
    by = list(by)
    ranks = _ordered_values(df, column, by, rows_per_range).select(
        *by, column, (F.col("_first") + (F.col("_ties") + 1) / 2).alias(name))
    return df.join(ranks, [*by, column], "left")


def exact_quantiles(df: DataFrame, column: str, by: Sequence[str], probs: dict[str, float],
                    rows_per_range: int = 100_000) -> DataFrame:
    """Linear-interpolation quantiles of groups of data rows (one output column per name).
    `percentile` would hold all distinct values of a group in one task; this does not."""
    by, keys = list(by), list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(1))
    values = _ordered_values(df.select(*keys, column), column, keys, rows_per_range)
    last = F.col("_first") + F.col("_ties") - 1

    def at(position: "F.Column") -> "F.Column":
        return F.max(F.when((F.col("_first") <= position) & (position <= last), F.col(column)))

    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_size") - 1)
        low, frac = F.floor(h), h - F.floor(h)
        aggs += [at(low).alias(f"{name}_lo"), at(F.ceil(h)).alias(f"{name}_hi"), F.max(frac).alias(f"{name}_fr")]
    out = values.groupBy(*keys).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_fr")).alias(n) for n in probs])


def percentile_scores(column: str, by: Sequence[str]) -> Column:
    """Average rank over the number of finite values; anything else scores 0."""
    finite = Window.partitionBy(*by)
    return F.coalesce(avg_rank(column, by) / F.count(column).over(finite), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), name: str = "spearman") -> DataFrame:
    """Pearson correlation of average ranks over complete pairs; NULL where a side is constant."""
    by = list(by)
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = complete.select(*by, avg_rank(x, by).alias("_rx"), avg_rank(y, by).alias("_ry"))
    return ranked.groupBy(*by).agg(pearson("_rx", "_ry").alias(name), F.count("*").alias("n"))


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate; NULL instead of NaN for a constant side or one row."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.corr(x, y))


def bh_adjust(df: DataFrame, p: str, by: Sequence[str], name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg over each group of tests (one row per gene)."""
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    down = Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_first()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy(*by, p)
    largest = F.rank().over(up) + F.count("*").over(tied) - 1
    df = df.withColumn("_bh", F.col(p) * F.count(p).over(Window.partitionBy(*by)) / largest)
    return df.withColumn(name, F.least(F.min("_bh").over(down), F.lit(1.0))).drop("_bh")
