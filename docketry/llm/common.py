"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='docketry-')}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only where a session of one machine names none (local tests) a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a result that is
    used several times is computed once, and a lost executor costs a reread."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`staged`, which nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def vector_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text, null where there is none) and vector (doubles) of the rows whose vector has no null or non-finite component."""
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", odd))


def most_common_size(rows: DataFrame, column: str, divisor: int = 1) -> DataFrame:
    """Of rows with lists of several lengths those of the most frequent length that ``divisor`` divides; of several the longest."""
    sizes = rows.where(F.size(column) % divisor == 0).groupBy(F.size(column).alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size(column) == (most["size"] if most else 0))


#: Bytes of a side that is broadcast at most, and copies of its rows where it is larger.
BROADCAST_BYTES, SALTS = 8 << 20, 32


def attach(rows: DataFrame, totals: DataFrame, keys: list[str], salt: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row a key); null keys are equal.

    A small ``totals``, as measured, is broadcast.  Of a larger one every key is
    copied for each salt, and the rows of a hot key are dealt out by the hash of ``salt``.
    The planner knows only the size of its packed files, before the copies, so
    it's told not to broadcast them.
    """
    totals = staged(totals, "totals")
    size = totals.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32).alias("s")).first()["s"] or 0
    renamed = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if size <= most:
        joined = rows.join(F.broadcast(renamed), same, "left")
    else:
        copies = renamed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("_row_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
        joined = dealt.join(copies.hint("merge"), [*same, F.col("_row_salt") == F.col("_salt")], "left").drop("_salt", "_row_salt")
    return joined.drop(*[f"_{k}" for k in keys])


def fold_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim_memory() -> None:
    """Hand freed memory back to the system, where Arrow and the C library can.

    Python workers live on after a task, and what each stage leaves with them adds up.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that ends by :func:`trim_memory`."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return task


def runs_of_bytes(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts holding about ``limit`` bytes each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
