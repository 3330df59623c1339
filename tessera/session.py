"""Session helpers: local sessions for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "tessera") -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators call it each round so plans stay small."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_PER_TASK = 250_000


def spread_rows(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """Hash-partition so that a task sorts about ROWS_PER_TASK of the `rows`, when the session's shuffle partitions would hold more.
    `rows` is a count that is at hand; without one the frame stays as it is."""
    parts = -(-(rows or 0) // ROWS_PER_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition to the session's shuffle partition number. An explicit number is kept by adaptive
    execution, which would otherwise merge partitions of few bytes and much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
