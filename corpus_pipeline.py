"""Cleans and encodes `documents` in stages; each stage works on all that the one before it kept.

Every stage is written as Parquet in the shared folder and read again, so a lost executor repeats one stage at most. All stages but the
last return the columns of `documents`; the last returns the token counts and digests of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, folders, jaccard_join, pii, quality_rules


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the current quality policy accepts."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies."""
    return jaccard_join.one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not contaminated by a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks identifiers; the length follows the text."""
    masked = pii.masked_documents(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).withColumnRenamed("key", "doc_id")


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("personal data", personal_data),
          ("byte bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = folders.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The tokenizer has no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None
