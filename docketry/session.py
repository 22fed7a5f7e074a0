"""Session settings and the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Read by ``session``: adaptive plans split skewed joins, and civil days need a fixed zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "docketry", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='docketry-')}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where a session of one machine names none, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, and a lost executor costs a reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join in which it isn't broadcast: packed files of few MB may hold many times as much, all of which would pass through the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it lies in fewer pieces than there are cores, for work that is dear a row; otherwise as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
