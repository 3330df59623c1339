"""The Kneser-Ney model is fitted on all trusted texts, and its shards answer like the model in one place."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney, lm_score


def text(r, n):
    return " ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(n))


@pytest.mark.parametrize("sizes", [{}, {"chunk_tokens": 500, "shard_tokens": 700}])
def test_scores_of_shards(spark, sizes):
    r = random.Random(3)
    rows = [(i, text(r, r.randrange(0, 60)) if i % 11 else None, "ab"[i % 2]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.filter("doc_id % 3 = 0").select("doc_id")
    got = {x.doc_id: (x.lang, x.n_tokens, x.perplexity) for x in kneser_ney.classify(docs, trusted, **sizes).withColumnRenamed("key", "doc_id").collect()}
    kept = trusted.withColumnRenamed("doc_id", "key").filter(f"not {kneser_ney.HELD_OUT}").select(F.col("key").alias("doc_id"))
    model = kneser_ney.fit(docs.join(kept, "doc_id").select("text"))
    assert len(got) == len(rows)
    for i, t, lang in rows:
        h, first = lm_score.text_words(pa.array([t], pa.string()))
        want = np.exp(-np.log(kneser_ney.token_probabilities(model, h, first)).mean()) if len(h) else None
        assert got[i][:2] == (lang, len(h)) and (got[i][2] == pytest.approx(want, rel=1e-9) if len(h) else got[i][2] is None)


def test_every_trusted_text_is_trained_on(spark):
    """Words that one trusted text alone has are known to the model, however many trusted texts there are."""
    docs = spark.createDataFrame([(i, f"only{i} here{i} now{i}", "x") for i in range(4000)], "doc_id long, text string, lang string")
    rows = kneser_ney.classify(docs, docs.select("doc_id"))
    fitted = rows.filter(f"not {kneser_ney.HELD_OUT}").agg(F.max("perplexity"), F.count("*")).first()
    held = rows.filter(kneser_ney.HELD_OUT).agg(F.min("perplexity")).first()
    assert fitted[1] > 3000 and fitted[0] < held[0]
