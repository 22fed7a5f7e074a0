"""Micro-batches: idempotent ingest, late children, windows and alert hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.changes import latest
from docketry.session import shared_path


def source(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Append each batch to ``path`` in a folder of its own, so a batch that is run again replaces itself.

    The state is read with :func:`current`: of each key the highest revision.
    """

    def write(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: list[str], revision: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), key, revision)


def ready_and_deferred(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, parent) whose parent is there or in the batch, and those that wait for it."""
    parents = known.select(F.col("id").alias("parent")).union(batch.select("id")).distinct()
    child = F.col("parent").isNotNull()
    ready = batch.where(~child).unionByName(batch.where(child).join(parents, "parent", "left_semi").select(*batch.columns))
    return ready, batch.where(child).join(parents, "parent", "left_anti").select(*batch.columns)


def windowed(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out and their state is dropped."""
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def distinct_within(stream: DataFrame, at: str, key: list[str], late: str = "1 day") -> DataFrame:
    """Repeated requests are answered once; keys are remembered until the watermark has passed them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def run_to_parquet(stream: DataFrame, spark: SparkSession, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there and give the last batch's result, from the shared folder."""
    path = shared_path(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n:08d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    return spark.read.parquet(f"{path}/{last:08d}") if last >= 0 else spark.createDataFrame([], stream.schema)
