"""Streams over metric records and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.model import RECORD_SCHEMA
from tessera.operators.scoring import RANGE_KEY
from tessera.sources.records import METRIC_KEY

STREAM_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("ingest_ts", T.TimestampType())])


def record_stream(spark: SparkSession, path: str, delay: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """Metric records from growing JSON folders, one row per metric key. The watermark on the ingest time
    bounds the state of the de-duplication: a key is remembered for `delay` past the newest ingest time."""
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.json(path)
    value = F.when(~F.isnan("metric_value"), F.col("metric_value"))
    return raw.withColumn("metric_value", value).withWatermark("ingest_ts", delay).dropDuplicatesWithinWatermark(METRIC_KEY)


def progress(records: DataFrame, expected: DataFrame, by: Sequence[str] = ("dataset", "integration_method")) -> DataFrame:
    """Done against expected counts (stream-static join; update mode)."""
    by = list(by)
    done = records.groupBy(*by).agg(F.count("*").alias("n_done"))
    return done.join(expected, by, "left").withColumn("share", F.col("n_done") / F.col("n_expected"))


def running_ranges(records: DataFrame) -> DataFrame:
    """Running range and mean per dataset, task and metric (update mode)."""
    v = F.col("metric_value")
    return records.groupBy(*RANGE_KEY).agg(F.min(v).alias("lower"), F.max(v).alias("upper"), F.avg(v).alias("mean"), F.count(v).alias("n_finite"))


def tumbling(width: str) -> Column:
    return F.window("ts", width)


def sliding(width: str, step: str) -> Column:
    return F.window("ts", width, step)


def session(gap: str) -> Column:
    return F.session_window("ts", gap)


def windowed(events: DataFrame, window: Column, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Windowed counts and moments of event values, with a watermark for late rows."""
    src = events.withWatermark("ts", delay) if events.isStreaming else events
    return src.groupBy(window.alias("w"), *keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lower"), F.max("value").alias("upper"))


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_latest(df: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Keep the newest row of every key of a streaming aggregate in Parquet. Each micro-batch writes the rows it changed to a
    folder named by its number, so a repeated batch replaces itself; a query started again goes on from the checkpoint, whose
    state store holds the aggregates. Nothing passes the driver."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_latest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key that `write_latest` has stored."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to parquet; restarts go on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
