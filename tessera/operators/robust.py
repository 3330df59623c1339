"""Alternative scalings, scenario ranks, concordance and bootstrap intervals of ranks.

Rank tables are small by nature (methods x datasets). The randomness of a draw is a hash of (seed, draw, slot), so every
retry and every engine sees the same resamples; where draws meet many rows they are weight vectors over the units."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import hash_uniform, mean_if_complete, ratio
from tessera.functions.ranks import avg_rank, spearman
from tessera.operators.scoring import METRICS, RANGE_KEY, SETTING, pivot_metrics

SCENARIOS = {"range": ("scaled", (0.5, 0.5, 0.5), False), "percentile": ("rank_scaled", (0.5, 0.5, 0.5), False),
             "zscore": ("z_scaled", (0.5, 0.5, 0.5), False), "weight_0.6": ("scaled", (0.6, 0.6, 0.6), False),
             "weight_0.4": ("scaled", (0.4, 0.4, 0.4), False), "labelled_only": ("scaled", (0.5, 0.5, 0.5), True)}

DRAWS_AT_ONCE = 500


def alt_scaling(metrics: DataFrame, value: str = "oriented_mean") -> DataFrame:
    """Rank scaling (rank - 1) / (n - 1) and z scaling with population deviation, per dataset, task and metric."""
    w = Window.partitionBy(*RANGE_KEY)
    n, sd = F.count(value).over(w), F.stddev_pop(value).over(w)
    m = metrics.withColumn("_r", F.round(value, 12))
    return m.withColumns({
        "rank_scaled": (avg_rank("_r", RANGE_KEY) - 1) / F.greatest(n - 1, F.lit(1)),
        "z_scaled": (F.col(value) - F.avg(value).over(w)) / F.when(sd > 1e-12, sd)}).drop("_r")


def weighted_available(a: Column, b: Column, w: Column | float) -> Column:
    """Weighted mean over the parts that are present."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    top = F.coalesce(a * w, F.lit(0.0)) + F.coalesce(b * (1 - w), F.lit(0.0))
    bottom = F.when(a.isNotNull(), w).otherwise(0.0) + F.when(b.isNotNull(), 1 - w).otherwise(0.0)
    return F.when(bottom > 0, ratio(top, bottom))


def _parts(wide: DataFrame) -> DataFrame:
    names = ["BatchMixing", "BiologicalConservation", "LabelIndependentClustering", "LabelAgreement"]
    return wide.withColumns({p: mean_if_complete(*[F.col(m) for m, (_, q, _) in METRICS.items() if q == p]) for p in names})


def weighted_core(wide: DataFrame, w: Sequence[Column | float]) -> DataFrame:
    wide = wide.withColumns({
        "Integration": weighted_available(F.col("BatchMixing"), F.col("BiologicalConservation"), w[0]),
        "Clustering": weighted_available(F.col("LabelIndependentClustering"), F.col("LabelAgreement"), w[1])})
    return wide.withColumn("CoreOverall", F.round(weighted_available(F.col("Integration"), F.col("Clustering"), w[2]), 9))


def task_scores(metrics: DataFrame, value: str, weights: Sequence[float] = (0.5, 0.5, 0.5)) -> DataFrame:
    return weighted_core(_parts(pivot_metrics(metrics, SETTING, value)), weights)


def rank_globally(scores: DataFrame, by: Sequence[str], value: str = "CoreOverall") -> DataFrame:
    """Rank inside each dataset, mean over datasets, rank of the mean; `by` separates scenarios and integrators."""
    by = list(by)
    r = scores.withColumn("_r", avg_rank(value, [*by, "dataset"], ascending=False))
    g = r.groupBy(*by, "fs_method").agg(F.round(F.avg("_r"), 9).alias("mean_dataset_rank"), F.avg(value).alias("mean_score"),
                                        F.count_distinct("dataset").alias("n_datasets"))
    return g.withColumn("global_rank", avg_rank("mean_dataset_rank", by))


def scenario_ranks(metrics: DataFrame, labelled: Sequence[str], scenarios: dict = SCENARIOS) -> DataFrame:
    """Global ranks under every scenario. `metrics` carries scaled, rank_scaled and z_scaled."""
    out = None
    for name, (value, weights, only_labelled) in scenarios.items():
        s = task_scores(metrics, value, weights)
        s = s.filter(F.col("dataset").isin(list(labelled))) if only_labelled else s
        s = s.select(F.lit(name).alias("scenario"), "dataset", "fs_method", "integration_method", "CoreOverall")
        out = s if out is None else out.unionByName(s)
    return rank_globally(out, ["scenario", "integration_method"])


def complete_items(ranks: DataFrame, rater: str, item: str, rank: str, by: Sequence[str]) -> DataFrame:
    """Rows of items that every rater of the group ranked."""
    by = list(by)
    r = ranks.filter(F.col(rank).isNotNull())
    raters = ranks.groupBy(*by).agg(F.count_distinct(rater).alias("_m"))
    full = r.groupBy(*by, item).agg(F.count_distinct(rater).alias("_k")).join(raters, by).filter("_k = _m")
    return r.join(full.select(*by, item), [*by, item], "left_semi")


def kendalls_w(ranks: DataFrame, rater: str, item: str, rank: str, by: Sequence[str]) -> DataFrame:
    """Agreement of raters with tie correction, over items ranked by all."""
    by = list(by)
    c = complete_items(ranks, rater, item, rank, by)
    sums = c.groupBy(*by, item).agg(F.sum(rank).alias("s"), F.count("*").alias("m"))
    s = sums.groupBy(*by).agg((F.var_pop("s") * F.count("*")).alias("ss"), F.count("*").cast("double").alias("n"), F.max("m").cast("double").alias("m"))
    ties = c.groupBy(*by, rater, rank).agg(F.count("*").cast("double").alias("t")).groupBy(*by).agg(
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n, m = F.col("n"), F.col("m")
    den = m * m * (n * n * n - n) - m * F.col("ties")
    return s.join(ties, by).select(*by, F.col("m").cast("bigint").alias("n_raters"), F.col("n").cast("bigint").alias("n_items"),
                                   ratio(12 * F.col("ss"), F.when(den > 0, den)).alias("kendalls_w"))


def concordance(ranks: DataFrame, rater: str, item: str, rank: str, by: Sequence[str]) -> DataFrame:
    """Spearman of every two raters over items ranked by all."""
    by = list(by)
    c = complete_items(ranks, rater, item, rank, by).select(*by, item, F.col(rater).alias("_k"), F.col(rank).alias("_v"))
    a, b = c.toDF(*by, item, "first", "x"), c.toDF(*by, item, "second", "y")
    return spearman(a.join(b, [*by, item]).filter("first < second"), "x", "y", [*by, "first", "second"], "rho")


def _draw_units(df: DataFrame, unit: str, by: list[str], draws: int, seed: int) -> DataFrame:
    """(by, draw, unit, weight): each draw takes as many units as there are, with replacement."""
    units = df.groupBy(*by).agg(F.sort_array(F.collect_set(unit)).alias("_u"))
    slots = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.size("_u") - 1)))
    pick = F.floor(hash_uniform(seed, "draw", "_k") * F.size("_u")).cast("int")
    return slots.select(*by, "draw", F.get("_u", pick).alias(unit)).groupBy(*by, "draw", unit).agg(F.count("*").alias("weight"))


@functools.lru_cache(4)
def _slot_uniforms(seed: int, first: int, draws: int, slots: int) -> np.ndarray:
    """The numbers of `hash_uniform(seed, draw, slot)` for a run of draws."""
    return np.array([[int(hashlib.md5(f"{seed}|{d}|{k}".encode()).hexdigest()[:13], 16) for k in range(slots)] for d in range(first, first + draws)]).reshape(draws, slots) / 2.0 ** 52


def draw_weights(seed: int, first: int, draws: int, units: int) -> np.ndarray:
    """(draws, units): how often each unit is drawn, the same resamples as `_draw_units`."""
    pick = np.floor(_slot_uniforms(seed, first, draws, units) * units).astype(np.int64)
    return np.bincount((pick + units * np.arange(draws)[:, None]).ravel(), minlength=draws * units).reshape(draws, units)


def _weighted_ranks(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Average-tie ranks of the values in every draw, a row counting as often as its weight."""
    levels, code = np.unique(values, return_inverse=True)
    order = np.argsort(code, kind="stable")
    here = np.add.reduceat(weight[:, order], np.searchsorted(code[order], np.arange(len(levels))), axis=1)
    return (np.cumsum(here, axis=1) - here / 2 + 0.5)[:, code]


def in_draws(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame, int, int], pd.DataFrame], draws: int, schema: str) -> DataFrame:
    """Runs `work(group, first draw, number of draws)` on runs of DRAWS_AT_ONCE draws, each a task of its own that holds one
    group: a dictionary-sized table whose resamples are weight vectors, so no resample is ever a set of rows."""
    dealt = df.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_AT_ONCE))))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        first = int(f["_run"].iloc[0]) * DRAWS_AT_ONCE
        out = work(f, first, min(DRAWS_AT_ONCE, draws - first))
        for c in by:
            out[c] = f[c].iloc[0]
        return out

    keys = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return dealt.groupBy(*by, "_run").applyInPandas(run, f"{schema}, {keys}")


def bootstrap_spearman(df: DataFrame, x: str, y: str, cluster: str, draws: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of Spearman over resampled clusters (use a row key to resample rows).

    A cluster drawn w times counts w times: ranks of a draw come from weighted running counts, so repeated
    rows are weights and not copies. Draws with a constant side are skipped."""
    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(cluster).alias("_c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if not by:
        d = d.withColumn("_g", F.lit(0))
    keys = by or ["_g"]
    observed = spearman(d, "x", "y", keys, "rho")

    def work(f: pd.DataFrame, first: int, size: int) -> pd.DataFrame:
        units, unit = np.unique(f["_c"].to_numpy(), return_inverse=True)
        w = draw_weights(seed, first, size, len(units))[:, unit]
        rx, ry = (_weighted_ranks(f[c].to_numpy(), w) for c in "xy")
        n = w.sum(1)
        sx, sy = (w * rx).sum(1), (w * ry).sum(1)
        vx, vy = (w * rx * rx).sum(1) - sx * sx / n, (w * ry * ry).sum(1) - sy * sy / n
        ok = (vx > 1e-9) & (vy > 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = ((w * rx * ry).sum(1) - sx * sy / n) / np.sqrt(vx * vy)
        return pd.DataFrame({"r": r[ok]})

    ci = in_draws(d, keys, work, draws, "r double").groupBy(*keys).agg(
        F.percentile("r", 0.025).alias("lower"), F.percentile("r", 0.975).alias("upper"), F.count("r").alias("n_draws"))
    return observed.join(ci, keys, "left").select(*by, "n", "rho", "lower", "upper", "n_draws")


def _summaries(draws: DataFrame, by: list[str]) -> DataFrame:
    return draws.groupBy(*by, "fs_method").agg(
        F.percentile("rank", 0.5).alias("median_rank"), F.percentile("rank", 0.25).alias("q25_rank"), F.percentile("rank", 0.75).alias("q75_rank"),
        F.percentile("rank", 0.025).alias("lower_rank"), F.percentile("rank", 0.975).alias("upper_rank"),
        F.avg((F.col("rank") <= 5).cast("double")).alias("top5_probability"))


def _ranked(scores: DataFrame, value: str) -> DataFrame:
    return scores.withColumn("_r", avg_rank(value, ["dataset", "integration_method"], ascending=False)).filter("_r IS NOT NULL").select(
        "integration_method", "dataset", "fs_method", "_r")


def _rank_draws(ranked: DataFrame, draws: DataFrame) -> DataFrame:
    """Global rank of each method in each draw of weighted datasets."""
    m = ranked.join(draws, ["integration_method", "dataset"]).groupBy("integration_method", "draw", "fs_method").agg(
        F.round(F.sum(F.col("_r") * F.col("weight")) / F.sum("weight"), 9).alias("_m"))
    return m.withColumn("rank", avg_rank("_m", ["integration_method", "draw"]))


def bootstrap_ranks(scores: DataFrame, draws: int = 5000, seed: int = 0, value: str = "CoreOverallMean") -> DataFrame:
    """Global ranks under resampled datasets. A run of draws is one product of weights and ranks per integrator."""
    def work(f: pd.DataFrame, first: int, size: int) -> pd.DataFrame:
        datasets, d = np.unique(f["dataset"].to_numpy(), return_inverse=True)
        methods, m = np.unique(f["fs_method"].to_numpy(), return_inverse=True)
        rank, known = np.zeros((len(datasets), len(methods))), np.zeros((len(datasets), len(methods)))
        rank[d, m], known[d, m] = f["_r"].to_numpy(), 1
        w = draw_weights(seed, first, size, len(datasets))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.round((w @ rank) / (w @ known), 9)  # NaN where a draw has no dataset of the method
        below = (mean[:, None, :] < mean[:, :, None]).sum(2) + ((mean[:, None, :] == mean[:, :, None]).sum(2) + 1) / 2
        at, col = np.nonzero(~np.isnan(mean))
        return pd.DataFrame({"fs_method": methods[col], "draw": first + at, "rank": below[at, col]})

    return _summaries(in_draws(_ranked(scores, value), ["integration_method"], work, draws, "fs_method string, draw long, rank double"), ["integration_method"])


def exact_bootstrap_ranks(scores: DataFrame, value: str = "CoreOverallMean", most: int = 6) -> DataFrame:
    """All n^n ordered resamples of n datasets: draw number in base n. More than `most` datasets are an error, not left out:
    raise `most` knowingly, or use `bootstrap_ranks`."""
    r = _ranked(scores, value)
    units = r.groupBy("integration_method").agg(F.sort_array(F.collect_set("dataset")).alias("_u"))
    largest = units.agg(F.max(F.size("_u"))).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} datasets have {largest}^{largest} resamples; `most` is {most}")
    n = F.size("_u").cast("bigint")
    d = units.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(n, n).cast("bigint") - 1))).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.size("_u") - 1)))
    digit = (F.floor(F.col("draw") / F.pow(n.cast("double"), F.col("_k"))) % n).cast("int")
    w = d.select("integration_method", "draw", F.get("_u", digit).alias("dataset")).groupBy("integration_method", "draw", "dataset").agg(
        F.count("*").alias("weight"))
    return _summaries(_rank_draws(r, w), ["integration_method"])


def leave_one_out_ranks(scores: DataFrame, value: str = "CoreOverallMean") -> DataFrame:
    """Global rank with each dataset left out in turn, and its range per method."""
    r = _ranked(scores, value)
    units = r.groupBy("integration_method").agg(F.collect_set("dataset").alias("_u"))
    d = r.join(units, "integration_method").withColumn("omitted", F.explode("_u")).filter("omitted <> dataset")
    m = d.groupBy("integration_method", "omitted", "fs_method").agg(F.round(F.avg("_r"), 9).alias("_m"))
    g = m.withColumn("rank", avg_rank("_m", ["integration_method", "omitted"]))
    return g.groupBy("integration_method", "fs_method").agg(F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
                                                            F.count("*").alias("n_left_out"))


def weight_perturbation(metrics: DataFrame, draws: int = 2000, seed: int = 0, value: str = "scaled") -> DataFrame:
    """Global ranks when the three component weights are drawn from [0.4, 0.6]."""
    wide = _parts(pivot_metrics(metrics, SETTING, value)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = [0.4 + 0.2 * hash_uniform(seed, "draw", F.lit(i)) for i in range(3)]
    s = weighted_core(wide.withColumns({f"_w{i}": w[i] for i in range(3)}), [F.col(f"_w{i}") for i in range(3)])
    return _summaries(rank_globally(s, ["draw", "integration_method"]).withColumnRenamed("global_rank", "rank"), ["integration_method"])


def budget_curves(scores: DataFrame, draws: int = 5000, seed: int = 0, value: str = "CoreOverallMean") -> DataFrame:
    """Mean score per budget with a dataset bootstrap interval; means of datasets come first."""
    m = scores.groupBy("integration_method", "n_features", "dataset").agg(F.avg(value).alias("v"))
    d = _draw_units(m, "dataset", ["integration_method"], draws, seed)
    b = m.join(d, ["integration_method", "dataset"]).groupBy("integration_method", "n_features", "draw").agg(
        (F.sum(F.col("v") * F.col("weight")) / F.sum(F.when(F.col("v").isNotNull(), F.col("weight")))).alias("b"))
    ci = b.groupBy("integration_method", "n_features").agg(F.percentile("b", 0.025).alias("lower"), F.percentile("b", 0.975).alias("upper"))
    base = m.groupBy("integration_method", "n_features").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n_datasets"))
    return base.join(ci, ["integration_method", "n_features"])


def budget_contrasts(scores: DataFrame, pairs: Sequence[tuple[str, str]], draws: int = 5000, seed: int = 0,
                     value: str = "CoreOverallMean") -> DataFrame:
    """Difference between two budgets with the same resample on both sides."""
    m = scores.groupBy("integration_method", "n_features", "dataset").agg(F.avg(value).alias("v"))
    wanted = F.array(*[F.struct(F.lit(a).alias("n_from"), F.lit(b).alias("n_to")) for a, b in pairs])
    p = m.withColumn("_p", F.explode(wanted)).select("integration_method", "dataset", "_p.n_from", "_p.n_to", "n_features", "v")
    diff = p.groupBy("integration_method", "dataset", "n_from", "n_to").agg(
        (F.max(F.when(F.col("n_features") == F.col("n_to"), F.col("v"))) - F.max(F.when(F.col("n_features") == F.col("n_from"), F.col("v")))).alias("d")).filter("d IS NOT NULL")
    units = _draw_units(diff, "dataset", ["integration_method"], draws, seed)
    b = diff.join(units, ["integration_method", "dataset"]).groupBy("integration_method", "n_from", "n_to", "draw").agg(
        (F.sum(F.col("d") * F.col("weight")) / F.sum("weight")).alias("b"))
    ci = b.groupBy("integration_method", "n_from", "n_to").agg(F.percentile("b", 0.025).alias("lower"), F.percentile("b", 0.975).alias("upper"))
    return diff.groupBy("integration_method", "n_from", "n_to").agg(F.avg("d").alias("mean_difference"), F.count("*").alias("n_datasets")).join(
        ci, ["integration_method", "n_from", "n_to"])


def metric_correlations(scaled: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman of every two metrics over settings with both."""
    keys = [*SETTING]
    c = scaled.filter(F.col(value).isNotNull()).select(*keys, "metric_name", F.round(value, 12).alias("_v"))
    a, b = c.toDF(*keys, "first", "x"), c.toDF(*keys, "second", "y")
    return spearman(a.join(b, keys).filter("first < second"), "x", "y", [*by, "first", "second"], "rho")


def metric_property_correlations(scaled: DataFrame, value: str, prop: str) -> DataFrame:
    """Spearman of each metric with a numeric property of its setting (feature count, dataset size)."""
    return spearman(scaled.withColumn("_v", F.round(value, 12)), "_v", prop, ["metric_name"], "rho")


def seed_agreement(df: DataFrame, value: str, arm: str, by: Sequence[str]) -> DataFrame:
    """Spearman of method ranks: the same seed across arms, and seed pairs inside an arm."""
    by = list(by)
    r = df.filter(F.col(value).isNotNull()).select(*by, "fs_method", F.col(arm).alias("arm"), F.col("random_seed").alias("seed"), F.col(value).alias("v"))
    a = r.toDF(*by, "fs_method", "arm_a", "seed_a", "x")
    b = r.toDF(*by, "fs_method", "arm_b", "seed_b", "y")
    j = a.join(b, [*by, "fs_method"]).filter(
        "(arm_a < arm_b AND seed_a = seed_b) OR (arm_a = arm_b AND seed_a < seed_b)").withColumn(
        "comparison", F.when(F.col("arm_a") == F.col("arm_b"), "within_arm").otherwise("same_seed"))
    return spearman(j, "x", "y", [*by, "comparison", "arm_a", "arm_b", "seed_a", "seed_b"], "rho")


def stratified_ranks(scores: DataFrame, stratum: str, columns: Sequence[str]) -> DataFrame:
    """Mean component rank per stratum (platform), from ranks inside each dataset."""
    long = scores.unpivot([stratum, "dataset", "integration_method", "fs_method"], list(columns), "component", "score")
    r = long.withColumn("_s", F.round("score", 9)).withColumn("_r", avg_rank("_s", ["dataset", "integration_method", "component"], ascending=False))
    m = r.groupBy(stratum, "integration_method", "component", "fs_method").agg(F.round(F.avg("_r"), 9).alias("mean_rank"))
    return m.filter("mean_rank IS NOT NULL").withColumn("stratum_rank", avg_rank("mean_rank", [stratum, "integration_method", "component"]))


def stratum_spearman(ranks: DataFrame, stratum: str) -> DataFrame:
    keys = ["integration_method", "component", "fs_method"]
    c = ranks.select(*keys, F.col(stratum).alias("_s"), "stratum_rank")
    a, b = c.toDF(*keys, "first", "x"), c.toDF(*keys, "second", "y")
    return spearman(a.join(b, keys).filter("first < second"), "x", "y", ["integration_method", "component", "first", "second"], "rho")


def runtime_summary(records: DataFrame, by: Sequence[str], memory_to_gib: float = 1.0 / 1024) -> DataFrame:
    """Runtime and memory of distinct runs: count, median, quartile range, maximum."""
    run = ["dataset", "fs_method", "n_features", "integration_method", "random_seed", "task"]
    d = records.select(*run, "runtime", "memory_usage").groupBy(*run).agg(F.max("runtime").alias("runtime"), F.max("memory_usage").alias("memory_usage"))
    return d.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.percentile("runtime", 0.5).alias("median_runtime"),
        (F.percentile("runtime", 0.75) - F.percentile("runtime", 0.25)).alias("iqr_runtime"), F.max("runtime").alias("max_runtime"),
        (F.max("memory_usage") * memory_to_gib).alias("max_memory_gib"))
