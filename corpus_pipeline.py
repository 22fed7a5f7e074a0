"""From the table of documents to encoded training data, in five stages.

Each stage takes what the one before kept, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import decontaminate, near_dedup, piece_codec, quality_rules, suffix_dedup
from docketry.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays.

    Of several rows of one id the first by text stays; rows without id all stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    stays = docs.join(kept, "doc_id", "left_semi").withColumn("_n", first).where("_n = 1").select(*docs.columns)
    return stays.unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are cut out, in whole characters.

    Null and empty texts stay as they are.  Equal rows lose their texts, all but
    what is shorter; an empty table stays empty, and other columns pass through.
    """
    found = suffix_dedup.remove_repeats(docs, whole_characters=True)
    text = F.when(F.size("spans") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    cut = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Rows are told apart by id and text, so of several rows of one id only those
    that hold an item go, and rows without id are judged by their text.  Null and
    empty texts stay; an empty benchmark takes nothing out.
    """
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    keyed = docs.withColumn("_key", key)
    leaks = decontaminate.find_leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(leaks.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every whole text as ids of the piece vocabulary, a row a document.

    Null texts count as empty and have no ids; repeated rows are coded one by
    one.  Columns of the documents that are named like a result are replaced.
    """
    return piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("suffix-array repeats", repeats),
    ("benchmark decontamination", benchmark),
    ("piece encoding", encode),
]

#: SQL can't express sketches, walks or Viterbi; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
