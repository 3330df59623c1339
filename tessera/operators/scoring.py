"""Frozen-range scaling, component scores, dataset and global ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.checks import assert_empty, nan_to_null, assert_unique
from tessera.functions.numeric import mean_if_complete, mean_of_present, ratio
from tessera.functions.ranks import avg_rank

# fixed values: metric -> (task group, component, higher is better)
METRICS = {
    "bASW": ("Integration", "BatchMixing", True),
    "iLISI": ("Integration", "BatchMixing", True),
    "dASW": ("Integration", "BiologicalConservation", True),
    "dLISI": ("Integration", "BiologicalConservation", True),
    "ILL": ("Integration", "BiologicalConservation", True),
    "GC": ("Integration", "BiologicalConservation", True),
    "silhouette": ("Clustering", "LabelIndependentClustering", True),
    "CHAOS": ("Clustering", "LabelIndependentClustering", False),
    "PAS": ("Clustering", "LabelIndependentClustering", False),
    "ari": ("Clustering", "LabelAgreement", True),
    "nmi": ("Clustering", "LabelAgreement", True),
    "Accuracy": ("Alignment", "Alignment", True),
    "Ratio": ("Alignment", "Alignment", False),
}
LABEL_COMPONENTS = ("BiologicalConservation", "LabelAgreement", "Alignment")

# fixed values: method groups
SPATIAL_METHODS = ["morans_i", "sparkx", "nnsvg", "spatialde", "somde"]
CONTROL_METHODS = ["all_features", "random", "TFs", "scsegindex"]
LABEL_METHODS = ["wilcoxon"]

SETTING = ["dataset", "fs_method", "n_features", "integration_method"]
RANGE_KEY = ["dataset", "task", "metric_name"]
COMPONENTS = ["BatchMixing", "BiologicalConservation", "LabelIndependentClustering", "LabelAgreement"]
SCORES = ["BatchMixing", "BiologicalConservation", "Integration", "LabelIndependentClustering", "LabelAgreement",
          "Clustering", "Alignment", "CoreOverall", "AlignmentEligibleOverall"]
OVERALL = ["Integration", "Clustering", "Alignment", "CoreOverall", "AlignmentEligibleOverall"]


def metric_metadata(spark: SparkSession) -> DataFrame:
    rows = [(i, name, group, part, higher, 1 if higher else -1, part in LABEL_COMPONENTS)
            for i, (name, (group, part, higher)) in enumerate(METRICS.items())]
    return spark.createDataFrame(
        rows, "metric_number int, metric_name string, task_group string, component string, "
              "higher_better boolean, direction int, needs_label boolean")


def orient(results: DataFrame, meta: DataFrame | None = None, check: bool = False) -> DataFrame:
    """Multiply by the metric direction, so more is better. Unknown metrics are an error when checked."""
    meta = metric_metadata(results.sparkSession) if meta is None else meta
    if check:
        assert_empty(results.join(meta, "metric_name", "left_anti").select("metric_name"), "unknown metric")
    side = F.broadcast(meta.select("metric_name", "component", "direction"))  # 13 rows
    return nan_to_null(results, "metric_value").join(side, "metric_name").withColumn("oriented", F.col("metric_value") * F.col("direction"))


def seed_average(oriented: DataFrame) -> DataFrame:
    return oriented.groupBy(*SETTING, "task", "metric_name").agg(
        F.avg("metric_value").alias("value_mean"), F.stddev_samp("metric_value").alias("value_sd"),
        F.avg("oriented").alias("oriented_mean"), F.stddev_samp("oriented").alias("oriented_sd"),
        F.count_distinct("random_seed").alias("n_seeds"),
        F.min("effective_n_features").alias("effective_min"), F.max("effective_n_features").alias("effective_max"),
        F.avg("runtime").alias("runtime_mean"))


def frozen_ranges(setting: DataFrame, value: str = "oriented_mean") -> DataFrame:
    r = setting.groupBy(*RANGE_KEY).agg(
        F.min(value).alias("lower"), F.max(value).alias("upper"), F.count(value).alias("n_finite"))
    width = F.col("upper") - F.col("lower")
    status = F.when(F.col("n_finite") == 0, "unavailable").when(width == 0, "constant").otherwise("ok")
    return r.withColumns({"range": width, "status": status}).withColumn(
        "denominator", F.when(F.col("status") == "ok", F.col("range")))


def apply_ranges(df: DataFrame, ranges: DataFrame, value: str, check: bool = False) -> DataFrame:
    """Scale with stored ranges, without clipping."""
    if check:
        assert_unique(ranges, RANGE_KEY, "frozen range")
    side = ranges.select(*RANGE_KEY, "lower", "upper", "status", "denominator")
    return df.join(side, RANGE_KEY, "left").withColumn(
        "scaled", (F.col(value) - F.col("lower")) / F.col("denominator"))


def with_components(wide: DataFrame) -> DataFrame:
    def part(name: str) -> Column:
        return mean_if_complete(*[F.col(m) for m, (_, p, _) in METRICS.items() if p == name])

    wide = wide.withColumns({p: part(p) for p in [*COMPONENTS, "Alignment"]})
    wide = wide.withColumns({
        "Integration": mean_of_present(F.col("BatchMixing"), F.col("BiologicalConservation")),
        "Clustering": mean_of_present(F.col("LabelIndependentClustering"), F.col("LabelAgreement"))})
    return wide.withColumns({
        "CoreOverall": mean_if_complete(F.col("Integration"), F.col("Clustering")),
        "AlignmentEligibleOverall": mean_if_complete(F.col("Integration"), F.col("Clustering"), F.col("Alignment"))})


def pivot_metrics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Metrics to columns with a fixed value list (no pass over the data to find it)."""
    return df.groupBy(*keys).pivot("metric_name", list(METRICS)).agg(F.max(value))


def seed_task_scores(scaled: DataFrame) -> DataFrame:
    wide = with_components(pivot_metrics(scaled, [*SETTING, "random_seed"], "scaled"))
    return wide.select(*SETTING, "random_seed", *SCORES, method_group().alias("method_group"))


def method_group(column: str = "fs_method") -> Column:
    c = F.col(column)
    return (F.when(c.isin(SPATIAL_METHODS), "spatially_informed").when(c.isin(CONTROL_METHODS), "control")
            .when(c.isin(LABEL_METHODS), "label_informed").otherwise("expression_driven"))


def setting_scores(seed_scores: DataFrame) -> DataFrame:
    aggs = []
    for s in SCORES:
        aggs += [F.avg(s).alias(f"{s}Mean"), F.stddev_samp(s).alias(f"{s}SD"), F.count(s).alias(f"{s}NSeeds")]
    return seed_scores.groupBy(*SETTING).agg(*aggs).withColumn("method_group", method_group())


def check_settings(settings: DataFrame) -> None:
    clash = settings.groupBy("dataset", "fs_method").agg(F.count_distinct("n_features").alias("n")).filter("n > 1")
    assert_empty(clash, "conflicting representative settings")


def representative(scores: DataFrame, settings: DataFrame, check: bool = False) -> DataFrame:
    if check:
        check_settings(settings)
    keys = ["dataset", "fs_method", "n_features"]
    return scores.join(settings.select(*keys).distinct(), keys, "left_semi")


def dataset_ranks(scores: DataFrame, columns: Sequence[str] = SCORES, suffix: str = "Mean") -> DataFrame:
    by = ["dataset", "integration_method"]
    return scores.withColumns({f"{s}Rank": avg_rank(f"{s}{suffix}", by, ascending=False) for s in columns})


def global_ranks(ranked: DataFrame, columns: Sequence[str] = OVERALL) -> DataFrame:
    aggs = []
    for s in columns:
        aggs += [F.avg(f"{s}Mean").alias(f"Mean{s}Score"), F.stddev_samp(f"{s}Mean").alias(f"SD{s}Score"),
                 F.avg(f"{s}Rank").alias(f"Mean{s}Rank"), F.stddev_samp(f"{s}Rank").alias(f"SD{s}Rank"),
                 F.count(f"{s}Rank").alias(f"N{s}Datasets")]
    out = ranked.groupBy("fs_method", "integration_method", "method_group").agg(*aggs)
    # mean ranks that are equal as fractions must tie, whatever order they were summed in
    out = out.withColumn("MeanCoreOverallRank", F.round("MeanCoreOverallRank", 9))
    return out.withColumn("GlobalCoreOverallRank", avg_rank("MeanCoreOverallRank", ["integration_method"]))


def competitive(scores: DataFrame) -> DataFrame:
    """Drop controls and label-informed methods before ranking."""
    return scores.filter(F.col("method_group").isin("expression_driven", "spatially_informed"))


def baseline_overall(long: DataFrame, weights: dict[str, float], required: Sequence[str],
                     baselines: Sequence[str]) -> DataFrame:
    """Scale by the range of baseline methods, clip to [0, 1] (zero range gives 1), mean per metric type,
    and a weighted mean of types; NULL when a required type is missing."""
    base = long.filter(F.col("fs_method").isin(list(baselines))).groupBy("dataset", "metric_name").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    z = F.when(F.col("value").isNotNull() & (F.col("hi") == F.col("lo")), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")))))
    scaled = long.join(base, ["dataset", "metric_name"]).withColumn("z", F.when(F.col("value").isNotNull(), z))
    keys = ["dataset", "fs_method", "integration_method"]
    types = scaled.groupBy(*keys, "metric_type").agg(F.avg("z").alias("type_mean"))
    wide = types.groupBy(*keys).pivot("metric_type", list(weights)).agg(F.max("type_mean"))
    total = sum((F.when(F.col(t).isNotNull(), F.col(t) * w).otherwise(0.0) for t, w in weights.items()), F.lit(0.0))
    present = sum((F.when(F.col(t).isNotNull(), F.lit(float(w))).otherwise(0.0) for t, w in weights.items()), F.lit(0.0))
    complete = F.lit(True)
    for t in required:
        complete = complete & F.col(t).isNotNull()
    return wide.withColumn("overall", F.when(complete, ratio(total, present)))


def adapt_long(results: DataFrame) -> DataFrame:
    """Plot-ready rows: a method-budget key, a display label, the oriented value and its metric type."""
    o = orient(results)
    return o.select(
        "dataset", "integration_method", "random_seed", "metric_name", F.col("component").alias("metric_type"),
        F.concat_ws("-", "fs_method", F.concat(F.lit("N"), "n_features")).alias("method_key"),
        F.initcap(F.regexp_replace("fs_method", "_", " ")).alias("method_label"), F.col("oriented").alias("value"))


def performance_matrix(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Methods x (integrator|task|metric) means, with the given column keys."""
    key = F.concat_ws("|", "integration_method", "task", "metric_name")
    return results.withColumn("cell", key).groupBy("fs_method").pivot("cell", list(columns)).agg(F.avg("metric_value"))


def within_task_rank(results: DataFrame, value: str = "metric_value",
                     by: Sequence[str] = ("dataset", "integration_method", "task", "metric_name", "random_seed")) -> DataFrame:
    return results.withColumn("rank", avg_rank(value, list(by), ascending=False))


def mean_rank(results: DataFrame) -> DataFrame:
    return within_task_rank(results).groupBy("fs_method").agg(F.avg("rank").alias("mean_rank"), F.count("rank").alias("n"))


def budget_profile(scores: DataFrame, value: str, by: Sequence[str], budget: str = "n_features") -> DataFrame:
    """Standardize inside each profile (ddof 1, constant profiles give NULL), then mean per budget."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    z = (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd)
    return scores.withColumn("z", z).groupBy(budget).agg(
        F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"), F.count("z").alias("n"))


def best_setting(df: DataFrame, by: Sequence[str], column: str, ties: bool = True, largest: bool = True,
                 tie_break: Sequence[str] = ()) -> DataFrame:
    order = F.col(column).desc_nulls_last() if largest else F.col(column).asc_nulls_last()
    w = Window.partitionBy(*by).orderBy(order, *([] if ties else list(tie_break)))
    place = F.rank() if ties else F.row_number()
    return df.filter(F.col(column).isNotNull()).withColumn("_p", place.over(w)).filter("_p = 1").drop("_p")


def difference_from(df: DataFrame, keys: Sequence[str], column: str, baseline: str, value: str) -> DataFrame:
    """Value minus the value of the same key at the baseline level of `column`."""
    base = df.filter(F.col(column) == baseline).select(*keys, F.col(value).alias("baseline_value"))
    return df.filter(F.col(column) != baseline).join(base, list(keys)).withColumn(
        "difference", F.col(value) - F.col("baseline_value"))


def diff_from_best_parent(df: DataFrame, keys: Sequence[str], child: str, parents: Sequence[str], value: str) -> DataFrame:
    best = df.filter(F.col("fs_method").isin(list(parents))).groupBy(*keys).agg(F.max(value).alias("best_parent"))
    return df.filter(F.col("fs_method") == child).join(best, list(keys)).select(
        *keys, F.col(value).alias("child_value"), "best_parent", (F.col(value) - F.col("best_parent")).alias("difference"))


def control_position(scores: DataFrame, controls: Sequence[str], value: str,
                     by: Sequence[str] = ("dataset", "integration_method")) -> DataFrame:
    """Where controls stand among competitors: place, mid-percentile, distance to the median."""
    by = list(by)
    is_control = F.col("fs_method").isin(list(controls))
    rivals = scores.filter(~is_control & F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    median = rivals.groupBy(*by).agg(F.percentile("v", 0.5).alias("median"))
    own = scores.filter(is_control).select(*by, "fs_method", F.col(value).alias("control_value"))
    met = own.join(rivals, by).groupBy(*by, "fs_method", "control_value").agg(
        F.count("v").alias("n_competitors"), F.count_if(F.col("v") > F.col("control_value")).alias("_above"),
        F.count_if(F.col("v") < F.col("control_value")).alias("_below"),
        F.count_if(F.col("v") == F.col("control_value")).alias("_same"))
    known = F.col("control_value").isNotNull()
    return met.join(median, by).select(
        *by, "fs_method", "control_value", "n_competitors",
        F.when(known, 1 + F.col("_above")).alias("position"),
        F.when(known, (F.col("_below") + 0.5 * F.col("_same")) / F.col("n_competitors")).alias("mid_percentile"),
        (F.col("control_value") - F.col("median")).alias("difference_vs_median"))


def seed_variability(seed_scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard deviation over seeds of each setting, then its median and 90 % quantile per dataset and task."""
    long = seed_scores.unpivot([*SETTING, "random_seed"], list(columns), "task", "score")
    sd = long.groupBy(*SETTING, "task").agg(F.stddev_samp("score").alias("sd")).filter("sd IS NOT NULL")
    return sd.groupBy("dataset", "task").agg(
        F.count("sd").alias("n_settings"), F.percentile("sd", 0.5).alias("median_sd"), F.percentile("sd", 0.9).alias("q90_sd"))


def endpoint_ranks(df: DataFrame, value: str, by: Sequence[str], lower_better: Sequence[str]) -> DataFrame:
    """Rank inside each endpoint with the direction of its metric."""
    signed = df.withColumn("_s", F.when(F.col("metric_name").isin(list(lower_better)), -F.col(value)).otherwise(F.col(value)))
    return signed.withColumn("rank", avg_rank("_s", list(by), ascending=False)).drop("_s")


def arm_comparisons(ranked: DataFrame, arm: str, by: Sequence[str], top: int = 5) -> DataFrame:
    """Every two arms (first < second) of endpoint ranks: Spearman, median absolute shift, tie-inclusive top overlap."""
    from tessera.functions.ranks import pearson

    keys = [*by, "first", "second"]
    side = ranked.groupBy(*by, "fs_method", arm).agg(F.max("rank").alias("rank")).filter("rank IS NOT NULL")
    a, b = side.toDF(*by, "fs_method", "first", "a"), side.toDF(*by, "fs_method", "second", "b")
    wide = a.join(b, [*by, "fs_method"]).filter("first < second")
    place_a, place_b = (F.rank().over(Window.partitionBy(*keys).orderBy(c)) for c in ("a", "b"))
    placed = wide.select(*keys, "a", "b", avg_rank("a", keys).alias("ra"), avg_rank("b", keys).alias("rb"),
                         (place_a <= top).alias("top_a"), (place_b <= top).alias("top_b"))
    return placed.groupBy(*keys).agg(
        F.count("*").alias("n_methods"), pearson("ra", "rb").alias("rank_rho"),
        F.percentile(F.abs(F.col("b") - F.col("a")), 0.5).alias("median_abs_shift"),
        F.count_if(F.col("top_a") & F.col("top_b")).alias("top_overlap"),
        F.count_if("top_a").alias("top_first"), F.count_if("top_b").alias("top_second"))


def arm_comparison(ranked: DataFrame, arm: str, first: str, second: str, by: Sequence[str], top: int = 5) -> DataFrame:
    """`arm_comparisons` of two named arms, in the order given."""
    named = ranked.filter(F.col(arm).isin(first, second)).withColumn(arm, F.when(F.col(arm) == first, "1").otherwise("2"))
    return arm_comparisons(named, arm, by, top).drop("first", "second")


def summarize_results(results: DataFrame) -> DataFrame:
    return results.groupBy(*SETTING, "task", "metric_name").agg(
        F.avg("metric_value").alias("mean"), F.stddev_samp("metric_value").alias("sd"), F.count("metric_value").alias("n"))


def contrast_pick(results: DataFrame, dataset: str | None = None) -> DataFrame:
    """Per dataset the integrator and budget with the best mean oriented value, and its best and worst method."""
    o = orient(results)
    o = o if dataset is None else o.filter(F.col("dataset") == dataset)
    method = o.groupBy("dataset", "integration_method", "n_features", "fs_method").agg(
        F.round(F.avg("oriented"), 9).alias("score")).filter("score IS NOT NULL")
    combo = method.groupBy("dataset", "integration_method", "n_features").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    pick = best_setting(combo, ["dataset"], "mean_score", ties=False, tie_break=["integration_method", "n_features"])
    best = F.max(F.struct("score", "fs_method"))
    worst = F.min(F.struct("score", "fs_method"))
    return method.join(pick, ["dataset", "integration_method", "n_features"]).groupBy(
        "dataset", "integration_method", "n_features", "mean_score").agg(
        best["fs_method"].alias("best_method"), best["score"].alias("best_score"),
        worst["fs_method"].alias("worst_method"), worst["score"].alias("worst_score"))


def rerank_with(base: DataFrame, recomputed: DataFrame, value: str = "CoreOverallMean") -> DataFrame:
    """Replace recomputed settings in a score table and report global ranks before and after."""
    new = recomputed.select(*SETTING, F.col(value).alias("_new"))
    swapped = base.join(new, SETTING, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")

    def ranks(df: DataFrame, name: str) -> DataFrame:
        r = df.withColumn("_r", avg_rank(value, ["dataset", "integration_method"], False))
        m = r.groupBy("fs_method", "integration_method").agg(F.round(F.avg("_r"), 9).alias(f"{name}_mean_rank"))
        return m.withColumn(f"{name}_rank", avg_rank(f"{name}_mean_rank", ["integration_method"]))

    return ranks(base, "before").join(ranks(swapped, "after"), ["fs_method", "integration_method"]).withColumn(
        "rank_change", F.col("after_rank") - F.col("before_rank"))
