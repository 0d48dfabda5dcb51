"""Durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a new
    temporary one, and a cluster, whose machines would not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_barloom_dir", None)
        if base is None:
            base = spark._barloom_dir = tempfile.mkdtemp(prefix="barloom-")
    return f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Let Spark delete a query's shuffle files as it ends, for queries whose result is written to the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    The table lives as long as the folder; whoever owns spark.checkpoint.dir clears it.
    """
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", compression)
    with shuffles_deleted(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.barloom_path = path
    return made


def discard(table: DataFrame, partition: str = "") -> None:
    """Delete a table of materialize(), or one partition of it, once what was made of it is itself stored."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{table.barloom_path}/{partition}")
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
