"""Registered queries against their SQL twins on the smallest tables, and the driver contract."""

import os

import pytest

import oracle
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["normalize_total", "scale", "quantile_crop", "knn_join", "radius_degree", "metric_knn", "hvg_seurat_batch", "hvg_seurat_v3_batch",
          "hvg_pearson", "wilcoxon", "morans_i", "kernel_projection_test", "deviance", "balanced_union", "combat", "dasw", "ilisi", "ari", "score_ranking",
          "seed_task_scores", "global_ranks", "exact_bootstrap_ranks", "bootstrap_spearman", "key_coverage", "score_audit", "record_stream", "stream_sliding"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    status, rows, _, _ = oracle.run(spark, con, SF, name)
    assert status == "ok" and rows > 0


def test_contract(spark):
    import __spark_entry__ as entry

    top = entry.entry(spark)
    assert top.columns == ["gene", "gene_index", "score", "rank"] and top.count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 180
