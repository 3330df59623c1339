"""Streaming queries, run over what is available and compared with batch SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.functions.numeric import r6
from tessera.plans import fixtures as fx
from tessera.plans.fixtures import scratch
from tessera.plans.registry import query
from tessera.streaming import records as N


def _record_files(spark, path):
    """Record files with an ingest time and some records stored twice."""
    base = os.path.join(scratch(spark), "in")
    r = fx.records(spark, path)
    again = r.filter("random_seed = 0 AND fs_method IN ('Brand#2', 'Brand#3')")
    stamped = r.unionByName(again).withColumn("ingest_ts", F.timestamp_seconds(F.lit(1704067200) + F.col("random_seed") * 60))
    stamped.write.json(base)
    return base


def _finish(df, spark, keys):
    base = scratch(spark)
    N.write_latest(df, os.path.join(base, "out"), os.path.join(base, "cp"))
    return N.read_latest(spark, os.path.join(base, "out"), keys)


@query("record_stream", "SELECT dataset, metric_name, count(*) AS n, round(sum(metric_value), 5) + 0 AS total FROM records GROUP BY 1, 2")
def _(spark, path):
    out = os.path.join(scratch(spark), "out")
    N.write_available(N.record_stream(spark, _record_files(spark, path)), out, os.path.join(scratch(spark), "cp"))
    return spark.read.parquet(out).groupBy("dataset", "metric_name").agg(F.count("*").alias("n"), (F.round(F.sum("metric_value"), 5) + F.lit(0.0)).alias("total"))


@query("stream_progress", """
    WITH e AS (SELECT count(DISTINCT fs_method) * count(DISTINCT metric_name) * count(DISTINCT random_seed) AS n_expected FROM records)
    SELECT dataset, integration_method, count(*) AS n_done, n_expected, round(count(*) / n_expected, 6) + 0 AS share FROM records, e GROUP BY 1, 2, 4""")
def _(spark, path):
    r = fx.records(spark, path)
    keys = r.select(F.count_distinct("fs_method") * F.count_distinct("metric_name") * F.count_distinct("random_seed")).scalar()
    expected = r.select("dataset", "integration_method").distinct().withColumn("n_expected", keys)
    expected.write.parquet(side := os.path.join(scratch(spark), "expected"))
    s = N.record_stream(spark, _record_files(spark, path), files_per_trigger=2)
    return _finish(N.progress(s, spark.read.parquet(side)), spark, ["dataset", "integration_method"]).withColumn("share", r6("share"))


@query("stream_ranges", """
    SELECT dataset, task, metric_name, round(min(metric_value), 6) + 0 AS lower, round(max(metric_value), 6) + 0 AS upper, round(avg(metric_value), 6) + 0 AS mean, count(metric_value) AS n_finite FROM records GROUP BY 1, 2, 3""")
def _(spark, path):
    out = _finish(N.running_ranges(N.record_stream(spark, _record_files(spark, path), files_per_trigger=2)), spark, ["dataset", "task", "metric_name"])
    return out.withColumns({c: r6(c) for c in ("lower", "upper", "mean")})


def _events(spark, path, late=False):
    """The events table as a file stream. A far-future row of its own event type closes all windows; `late` rows come after it."""
    base = os.path.join(scratch(spark), "in")
    e = fx.table(spark, path, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(os.path.join(base, "a"))
    last = e.agg(F.max("event_id").alias("event_id")).select("event_id", F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("bigint").alias("user_id"),
                                                             F.lit("close").alias("event_type"), F.lit(0.0).alias("value"))
    last.write.parquet(os.path.join(base, "b"))
    if late:  # the watermark of one batch drops late rows from the next but one
        last.write.parquet(os.path.join(base, "b2"))
        e.filter("user_id % 3 = 0").write.parquet(os.path.join(base, "c"))
    return N.event_stream(spark, os.path.join(base, "*"), e.schema, 1)


def _windowed(spark, path, window, keys, late=False):
    out = os.path.join(scratch(spark), "out")
    w = N.windowed(_events(spark, path, late), window, keys, "40 days").select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", r6("mean").alias("mean"), r6("lower").alias("lower"), r6("upper").alias("upper"))
    N.write_available(w, out, os.path.join(scratch(spark), "cp"))
    return spark.read.parquet(out).filter(F.col("start") < F.lit("2029-01-01").cast("timestamp_ntz"))


STATS = "count(*) AS n, round(avg(value), 6) + 0 AS mean, round(min(value), 6) + 0 AS lower, round(max(value), 6) + 0 AS upper"


@query("stream_tumbling", f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, {STATS} FROM events GROUP BY 1, 2, 3""")
def _(spark, path):
    return _windowed(spark, path, N.tumbling("1 hour"), ["event_type"])


@query("stream_late", f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, {STATS} FROM events GROUP BY 1, 2, 3""")
def _(spark, path):
    """Rows behind the watermark arrive again: they change nothing."""
    return _windowed(spark, path, N.tumbling("1 hour"), ["event_type"], late=True)


@query("stream_sliding", f"""
    WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start FROM events, (SELECT unnest(range(3)) AS k))
    SELECT start, start + INTERVAL 3 HOUR AS "end", event_type, {STATS} FROM e GROUP BY 1, 2, 3""")
def _(spark, path):
    return _windowed(spark, path, N.sliding("3 hours", "1 hour"), ["event_type"])


@query("stream_session", f"""
    WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, {STATS} FROM s GROUP BY user_id, k""")
def _(spark, path):
    return _windowed(spark, path, N.session("2 hours"), ["user_id"])
