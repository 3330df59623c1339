"""The Kneser-Ney model counts and scores in rounds: little stays on disk, and common words do not meet in one shard."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import folders, kneser_ney, lm_score


def skewed(r, n):
    return " ".join(f"w{min(int(r.paretovariate(0.7)), 400)}" if r.random() < 0.7 else "a b" for _ in range(n))


def size(spark):
    root = folders.shared_root(spark).removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_files_are_fewer_than_the_texts(spark):
    """Stored n-gram tables and their answers took several times the bytes of the texts."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, skewed(r, 80), "x") for i in range(3000)], "doc_id long, text string, lang string").cache()
    texts, before = docs.agg(F.sum(F.length("text"))).first()[0], size(spark)
    assert kneser_ney.classify(docs, docs.select("doc_id")).count() == 3000
    assert size(spark) - before < texts


@pytest.mark.parametrize("shard_tokens", [600, 3000])
def test_common_words_and_pairs(spark, shard_tokens):
    r = random.Random(6)
    rows = [(i, skewed(r, r.randrange(0, 70)) if i % 13 else None) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).repartition(3)
    chunks = folders.stored(lm_score.tokens(docs.select(F.col("doc_id").alias("key"), "text", (F.col("doc_id") % 3 > 0).alias("target")), 800), "kn-test")
    total = chunks.agg(F.sum("n")).first()[0]
    common = kneser_ney.common_keys(chunks, total, shard_tokens / 24)
    assert len(common.words) > 2 and len(common.pairs) > 2 and len(common.words) < 300
    got = {x.key: x.log_perplexity for x in kneser_ney.perplexities(chunks, shard_tokens, 3).collect()}
    model = kneser_ney.fit(docs.filter("doc_id % 3 > 0").select("text"))
    for i, t in rows:
        h, first = lm_score.text_words(pa.array([t], pa.string()))
        assert got[i] == (pytest.approx(-np.log(kneser_ney.token_probabilities(model, h, first)).mean(), rel=1e-9) if len(h) else None)


def test_a_sample_trains_the_same_model(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(i, skewed(r, 40), "x") for i in range(60)], "doc_id long, text string, lang string")
    whole = kneser_ney.classify(docs, docs.select("doc_id")).orderBy("key").collect()
    assert kneser_ney.classify(docs, docs.select("doc_id"), train_docs=1000, train_tokens=100_000).orderBy("key").collect() == whole
