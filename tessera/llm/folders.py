"""Shared folders: lineage cuts and files that tasks write where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local folder for local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    root = shared_root(spark)
    return f"{root if '://' in root else 'file://' + root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark, path, schema = df.sparkSession, new_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove the files of their shuffles when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def freed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`stored`, with the files of the shuffles removed, and the folder, for `dropped`."""
    spark, path, schema = df.sparkSession, new_folder(df.sparkSession, name), df.schema
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def dropped(path: str) -> None:
    """Removes a folder that `freed` wrote and that nothing will read again."""
    store, at = filesystem(path)
    store.delete_dir(at)


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared URI; pyarrow opens local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def get_bytes(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def put_bytes(uri: str, data: bytes) -> None:
    """Writes a file under its final name only once it is whole, so a retried task leaves no torn file."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)
