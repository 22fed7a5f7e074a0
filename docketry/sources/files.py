"""Files in and out: imports with any header, blobs by content, and sinks for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import neutral_cell, tr_lower

# Names that columns of imported lists go by.
SYNONYMS = {"başlık": "title", "title": "title", "kurum": "issuer", "issuer": "issuer", "yayım tarihi": "publish_date", "tarih": "publish_date", "önem": "severity", "severity": "severity", "birimler": "units", "units": "units", "url": "url"}


def read_list(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A CSV list with columns by their canonical names; rows without a title are dropped."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return canonical_columns(raw)


def canonical_columns(rows: DataFrame, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """The first column of each known name."""
    picked: dict[str, str] = {}
    for name in rows.columns:
        low = name.lstrip("﻿").replace("I", "ı").replace("İ", "i").strip().lower()
        if low in synonyms:
            picked.setdefault(synonyms[low], name)
    out = rows.select(*[F.col(f"`{old}`").alias(new) for new, old in picked.items()])
    return out.where(F.trim(F.coalesce("title", F.lit(""))) != "") if "title" in picked else out.limit(0)


def split_units(units: Column) -> Column:
    return F.filter(F.transform(F.split(F.translate(units, ";", ","), ","), lambda x: F.trim(x)), lambda x: x != "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A set of JSON lines with blank lines and // comments between."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '//')")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def store_blobs(contents: DataFrame, path: str) -> DataFrame:
    """Write new contents under their SHA-256, in folders by its first two digits; returns every row's key.

    Contents that are there already aren't written again.
    """
    spark, keyed = contents.sparkSession, contents.withColumn("sha", F.sha2("content", 256)).withColumn("prefix", F.substring("sha", 1, 2))
    new = keyed.select("sha", "prefix", "content").dropDuplicates(["sha"])
    try:
        new = new.join(spark.read.parquet(path).select("sha"), "sha", "left_anti")
    except Exception as missing:  # no blob was stored yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    new.write.partitionBy("prefix").mode("append").parquet(path)
    return keyed.drop("content", "prefix")


def write_sheet(rows: DataFrame, path: str) -> None:
    """A CSV for spreadsheets: texts can't be taken for formulas."""
    cells = [neutral_cell(c).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*cells).write.option("header", True).option("sep", ";").mode("overwrite").csv(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Sheets side by side, each a folder of CSV files named by its place and name; written by all tasks, whatever their size."""
    for place, (name, rows) in enumerate(sheets.items(), 1):
        write_sheet(rows, f"{path}/{place:02d}-{name}")


def read_sheet(spark: SparkSession, path: str, place: int, name: str) -> DataFrame:
    """A written sheet's cells as texts, those that were marked as no formulas without the mark."""
    rows = spark.read.option("header", True).option("sep", ";").csv(f"{path}/{place:02d}-{name}")
    return rows.select(*[F.regexp_replace(c, "^'(?=[=+@\\t\\r-])", "").alias(c) for c in rows.columns])


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One text: nodes (id, label, n) and edges (a, b, label) as a flow chart; ways back are dashed.

    For the graph of a pipeline, so of a few dozen rows.
    """
    node = nodes.select(F.lit(0).alias("k"), F.col("id").alias("o"), F.format_string('  %s["%s (%d)"]', "id", "label", "n").alias("line"))
    arrow = F.when(tr_lower("label").rlike("hata|yeniden"), "-.->").otherwise("-->")
    edge = edges.select(F.lit(1).alias("k"), F.concat("a", "b").alias("o"), F.format_string("  %s %s|%s| %s", "a", arrow, "label", "b").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "line"))), lambda x: x["line"])
    return node.union(edge).agg(F.concat_ws("\n", F.lit("flowchart LR"), F.array_join(lines, "\n")).alias("text"))
