"""WARC archives and their fixity audit by hash trees.

Pages are written as WARC 1.1 resource records, one after another, to bounded
shard files that Spark's text writer makes (the end of a line is the end of a
record).  A shard's records, in order of their offsets, are the leaves of a
hash tree of fixed fan-out, whose nodes know the offset range they cover; the
shards' roots are joined by further levels up to one root of the replica.  Trees
are stored beside the archive.  Two replicas are compared from the root, and only
nodes below a mismatch are read, so comparing the trees of sound replicas reads
their roots.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged

FAN_OUT = 64
END = "\r\n\r\n"
_LENGTH, _URI, _ID = (re.compile(rb"\r\n" + x + rb":[ \t]*([^\r\n]*)", re.I) for x in (b"Content-Length", b"WARC-Target-URI", b"WARC-Record-ID"))
_SHARD = r"([^/]*)/part-(\d+)-[^/]*-c(\d+)\.[^/]*$"


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """A page as a WARC record without the two line ends after it; null values count as empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    line = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]", " ")
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(page_id).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        line,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    ]
    return F.concat(*head, body)


#: Largest record, and how many such records a file has at most: about 64 MB.
_FILES = ((1 << 16, 1000), (1 << 21, 32), (1 << 31, 1))


def write_warc(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write the one string column of ``records`` as gzipped WARC files of ``per_file`` records and about 64 MB at most.

    Larger records go to files of fewer records, in a folder of their size, so
    no file holds more than one record over 2 MB.
    """
    records, size = records.toDF("record"), F.octet_length("record")
    least, most = records.agg(F.min(size), F.max(size)).first()
    low = -1
    for high, count in ((_FILES[0][0], per_file), *_FILES[1:]):
        if low < 0 or (most or 0) > low and (least or 0) <= high:
            own = records.where((size > low) & (size <= high)) if (most or 0) > _FILES[0][0] else records
            own.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", min(per_file, count)).text(f"{path}/to-{high}")
        low = high


@dataclass(frozen=True)
class Parsed:
    offset: int
    n_bytes: int
    record_id: str
    uri: str
    body: bytes
    whole: bytes


def parse_warc(data: bytes) -> Iterator[Parsed]:
    """The records of a file by their Content-Length.

    After damage to a header the next ``WARC/1.1`` line after a record's end is
    searched for, and what lies between is given as one record without id.
    """
    at = 0
    while at < len(data):
        head = data.find(END.encode(), at)
        fields = [x.search(data, at, head) if head >= 0 and data.startswith(b"WARC/", at) else None for x in (_LENGTH, _URI, _ID)]
        size = int(fields[0][1]) if fields[0] and fields[0][1].isdigit() else -1
        end = head + 4 + size
        if size < 0 or not data.startswith(END.encode(), end):
            end = data.find(END.encode() + b"WARC/1.1\r\n", at)
            end = end if end >= 0 else len(data) - len(END) if data.endswith(END.encode()) else len(data)
            fields = [fields[0], None, None] if size < 0 else fields
        name = fields[2][1].decode("utf-8", "replace") if fields[2] else ""
        uri = fields[1][1].decode("utf-8", "replace") if fields[1] else ""
        yield Parsed(at, end - at, name, uri, data[head + 4 : end] if head >= 0 else b"", data[at:end])
        at = end + 4


def read_warc(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """shard, ordinal, offset (in the file before compression), n_bytes, record_id, uri, sha256; with ``text`` also html.

    Files are found in all folders below ``path``.  Those of :func:`write_warc`
    have folder, part and number as shard, others their name.  Repeated record
    ids are repeated rows; an empty archive gives none.  A file is read whole by
    one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(path).where("length > 0")
    named = F.concat_ws("-", *[F.regexp_extract("path", _SHARD, k) for k in (1, 2, 3)])
    shard = F.when(F.col("path").rlike(_SHARD), named).otherwise(F.regexp_extract("path", r"[^/]*$", 0))
    names = ["shard", "ordinal", "offset", "n_bytes", "record_id", "uri", "sha256", *["html"] * text]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = list(parse_warc(data))
                columns = [pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), *(pa.array([getattr(r, k) for r in rows], pa.int64()) for k in ("offset", "n_bytes")), *(pa.array([getattr(r, k) for r in rows], pa.string()) for k in ("record_id", "uri")), pa.array([hashlib.sha256(r.whole).hexdigest() for r in rows], pa.string())]
                if text:
                    columns.append(pa.array([r.body.decode("utf-8", "replace") for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "shard string, ordinal long, offset long, n_bytes long, record_id string, uri string, sha256 string" + ", html string" * text
    return files.select(shard.alias("shard"), "content").mapInArrow(parse, kinds)


def write_tree(records: DataFrame, path: str) -> None:
    """Store the hash tree of ``records`` at ``path``: (level, shard, place, hash, start, end, record_id), leaves at level 0.

    ``place`` orders a level, FAN_OUT nodes under each node of the next; start
    and end are the offset range that a node of a shard covers.  Hashes cover the
    records' bytes in their order; a range may move without a change of its hash.
    """
    names = ["shard", "place", "hash", "start", "end", "record_id"]
    level, k = records.select("shard", F.col("ordinal").alias("place"), F.col("sha256").alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("n_bytes")).alias("end"), "record_id"), 0
    spark = records.sparkSession
    while True:
        level.select(*names).write.parquet(f"{path}/level={k}")
        level = spark.read.schema(level.schema).parquet(f"{path}/level={k}")
        if not level.agg(F.max("place")).first()[0]:
            return
        child = F.array_sort(F.collect_list(F.struct("place", "hash")))  # FAN_OUT at most
        up = level.groupBy("shard", F.floor(F.col("place") / FAN_OUT).alias("place"))
        level, k = up.agg(F.sha2(F.array_join(F.transform(child, lambda x: x["hash"]), ""), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"), F.lit("").alias("record_id")), k + 1


def read_tree(spark: SparkSession, path: str) -> list[DataFrame]:
    """The levels of a stored tree, leaves first; each read touches one level's files."""
    tree = spark.read.parquet(path)
    top = tree.agg(F.max("level")).first()[0] or 0
    return [tree.where(F.col("level") == k).drop("level") for k in range(top + 1)]


def archive_root(levels: list[DataFrame]) -> str:
    """One hash for the whole replica: over the shards' roots, in groups by hash of the shard's name, level by level."""
    level = levels[-1].where("place = 0").select(F.col("shard").alias("name"), "hash")
    for digits in (4, 2, 0):
        child = F.array_sort(F.collect_list(F.struct("name", "hash")))
        group = F.substring(F.sha2(F.col("name"), 256), 1, digits) if digits else F.lit("")
        level = level.groupBy(group.alias("group")).agg(F.sha2(F.array_join(F.transform(child, lambda x: F.concat(x["name"], x["hash"])), ""), 256).alias("hash")).select(F.col("group").alias("name"), "hash")
    row = level.first()
    return row["hash"] if row else hashlib.sha256(b"").hexdigest()


def locate_damage(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """The leaves (shard, place, start, end, record_id, replica) without an equal in the other replica; replica is 0 or 1.

    From the shards' roots down, a level's nodes are compared only under nodes
    that differ.  Below the lowest of these, records are held against each other
    by id and hash, in whatever shard they are, so that one lost, put in, longer
    or shorter record doesn't make those after it differ.  Equal records are
    counted; of those that are too many, the last ones are given.
    """
    spark = ours[0].sparkSession
    if len(ours) == len(theirs) and archive_root(ours) == archive_root(theirs):
        return spark.createDataFrame([], "shard string, place long, start long, end long, record_id string, replica int")
    depth = max(len(ours), len(theirs))
    levels = [[t[min(k, len(t) - 1)] for k in range(depth)] for t in (ours, theirs)]
    suspects = None
    for k in range(depth - 1, -1, -1):
        under = [x if suspects is None else x.withColumn("up", F.floor(F.col("place") / FAN_OUT)).join(suspects, ["shard", "up"], "left_semi") for x in (levels[0][k], levels[1][k])]
        if k:
            a, b = (x.select("shard", "place", F.col("hash").alias(f"hash{n}")) for n, x in enumerate(under))
            suspects = staged(a.join(b, ["shard", "place"], "full").where(~F.col("hash0").eqNullSafe(F.col("hash1"))).select("shard", F.col("place").alias("up")), "suspects")
    leaves = under[0].withColumn("replica", F.lit(0)).unionByName(under[1].withColumn("replica", F.lit(1)))
    side = lambda n: F.sum((F.col("replica") == n).cast("long"))
    uneven = leaves.groupBy("record_id", "hash").agg(side(0).alias("n0"), side(1).alias("n1")).where("n0 <> n1")
    uneven = uneven.select("record_id", "hash", F.least("n0", "n1").alias("even"))
    copy = F.row_number().over(Window.partitionBy("record_id", "hash", "replica").orderBy("shard", "place"))
    left = leaves.join(uneven, ["record_id", "hash"]).withColumn("copy", copy).where(F.col("copy") > F.col("even"))
    return left.select("shard", "place", "start", "end", "record_id", "replica")


def audit(spark: SparkSession, ours: str, theirs: str) -> DataFrame:
    """Each record of replica ``ours``: shard, ordinal, offset, n_bytes, record_id, uri, sha256, and ``intact``: equal in ``theirs``.

    Records that only ``theirs`` has come with null in all but shard and
    record_id and aren't intact.  A changed record is one row, that of ``ours``;
    repeated record ids are told apart by their order.  Two empty archives give
    no row.  Both trees are stored, so a later comparison of either replica reads
    its tree alone (:func:`read_tree`, :func:`locate_damage`).
    """
    records, trees = staged(read_warc(spark, ours), "records"), []
    for own in (records, read_warc(spark, theirs)):
        path = shared_dir(spark, "tree")
        write_tree(own, path)
        trees.append(read_tree(spark, path))
    nth = F.row_number().over(Window.partitionBy("record_id", "replica").orderBy("shard", "place"))
    bad = staged(locate_damage(*trees).withColumn("nth", nth), "damage")
    hurt = bad.where("replica = 0").select("shard", F.col("place").alias("ordinal"), F.lit(False).alias("sound"))
    known = bad.where("replica = 0").select("record_id", "nth")
    lost = bad.where("replica = 1").select("shard", "record_id", "nth").join(known, ["record_id", "nth"], "left_anti")
    rows = records.join(hurt, ["shard", "ordinal"], "left").withColumn("intact", F.coalesce("sound", F.lit(True))).drop("sound")
    return rows.unionByName(lost.select("shard", "record_id", F.lit(False).alias("intact")), allowMissingColumns=True)
