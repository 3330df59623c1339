"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The selector queries mirror the published selector profile. `dataset_build` is the first query, which also
derives and stores the dataset; the others read it. Results are fully computed with a no-op write."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = ["statistic_mean", "statistic_variance", "tf_list", "all_features", "random_features", "hvg_seurat", "hvg_seurat_batch",
            "hvg_cell_ranger", "hvg_cell_ranger_batch", "hvg_seurat_v3", "hvg_seurat_v3_batch", "hvg_pearson", "hvg_pearson_batch", "morans_i",
            "wilcoxon", "brennecke", "bio_variance", "dropout_excess", "hvg_seurat_vst", "hvg_seurat_mvp", "hvg_seurat_disp", "deviance",
            "kernel_ranking", "local_autocorrelation", "knn_localization", "anticorrelation", "grid_kl", "knn_join", "metric_knn",
            "silhouette", "global_ranks", "scenario_ranks", "method_overlap"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, name="bench")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    start = time.time()
    queries["statistic_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # derives and stores the dataset
    times["dataset_build"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
