"""Shuffles of lines and of stored entries have as many partitions as their rows need."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators.prepare import normalize_total
from tessera.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entries_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    whole = fx.counts(spark, SF)
    parts = whole.rdd.getNumPartitions()
    assert parts == -(-lines // 200) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in whole.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) <= 3 * 200
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10**9)
    assert sorted(whole.collect()) == sorted(fx.counts(spark, SF).collect())
    ranked = fx.rankings(spark, SF).collect()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    assert sorted(fx.rankings(spark, SF).collect()) == sorted(ranked)
    entries = whole.count()
    norm = normalize_total(whole, entries=entries)
    assert norm.rdd.getNumPartitions() == -(-entries // 200)
    assert sorted(norm.collect()) == sorted(normalize_total(whole).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_the_stored_dataset_knows_its_entries(spark):
    ds = fx.dataset(spark, SF)
    assert ds.entries == ds.expr.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_matched_queries_read_the_lines_once(spark, monkeypatch):
    """Sums of genes come from one pass over the lines and no stored dataset; they are those of the stored entries and of the rankings."""
    from tessera.plans import validation

    sums = fx.gene_sums(spark, SF)
    entries = fx.counts(spark, SF).groupBy("gene").agg(F.sum("count").alias("count"), F.count("*").alias("n"))
    assert sorted(sums.groupBy("gene").agg(F.sum("score"), F.sum("entries")).collect()) == sorted(entries.collect())
    ranked = fx.rankings(spark, SF)
    assert sorted(sums.select("dataset", "method", "gene", "score").collect()) == sorted(ranked.select("dataset", "method", "gene", "score").collect())
    read, table = [], fx.table
    monkeypatch.setattr(fx, "dataset", lambda *a: pytest.fail("the stored dataset is not needed"))
    monkeypatch.setattr(fx, "table", lambda s, p, name: read.append(name) or table(s, p, name))
    validation._stats(spark, SF)
    assert read.count("lineitem") == 1
