"""Summaries against their sources, notes of versions, frozen settings."""

from conftest import DATA
from pyspark.sql import functions as F

from docketry.operators import changes, evaluation, summaries
from docketry.plans import catalogue, stages


def test_claims_are_kept_that_a_quote_bears_out(spark):
    borne_out = {r["item_id"] for r in catalogue.claim_evidence(spark, DATA).collect()}
    rows = stages.summary_claims(spark, DATA).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {(r["place"], r["n_quotes"], r["n_found"], r["kept"]) for r in rows} == {(d * 10, 2, int(d in borne_out), d in borne_out) for d in docs} | {(d * 10 + 1, 1, 0, False) for d in docs}
    told = {r["record"]: r for r in stages.verified_summary(spark, DATA).collect()}
    for record in {d // 8 for d in docs}:
        own = [d for d in docs if d // 8 == record]
        kept = sum(d in borne_out for d in own)
        r = told[record]
        assert (r["sentences"], r["topics"], r["removed"], r["grounding"]) == (kept, 0, 2 * len(own) - kept, round(kept / (2 * len(own)), 4))


def test_claims_without_quotes_or_sources(spark):
    kind = "record long, kind string, place int, text string, quotes array<string>"
    claims = spark.createDataFrame([(1, "sentence", 1, "a", None), (1, "topic", 2, "b", []), (2, "sentence", 1, "c", ["the words of it are here"]), (1, "sentence", 3, None, ["x"]), (1, "sentence", 0, "d", ["the words of it are here", None])], kind)
    sources = spark.createDataFrame([(1, 7, "See: the words of it are here."), (3, 8, None)], "record long, doc_id long, text string")
    found = summaries.verified_claims(claims, sources)
    assert sorted((r["record"], r["text"], r["n_quotes"], r["n_found"], r["kept"]) for r in found.collect()) == [(1, "a", 0, 0, False), (1, "b", 0, 0, False), (1, "d", 2, 1, True), (2, "c", 1, 0, False)]
    assert {(r["record"], tuple(r["sentences"]), r["removed"]) for r in summaries.verified_summaries(found).collect()} == {(1, ("d",), 2), (2, (), 1)}
    versions = spark.createDataFrame([(1, 1, False, "x"), (1, 2, True, "y"), (1, 3, True, "z"), (2, 1, False, "w")], "reg_id long, version int, is_current boolean, short_content string")
    assert {tuple(r) for r in summaries.current_summaries(versions).select("reg_id", "version", "short_content").collect()} == {(1, 3, "z")}


def test_notes_of_versions(spark):
    rows = [({"a": "1", "summary": "old"}, "new", ["f.pdf"]), (None, "", []), ({"a": "1"}, None, None)]
    frame = spark.createDataFrame(rows, "e map<string,string>, s string, m array<string>")
    assert [r["x"] for r in frame.select(changes.version_extra(F.col("e"), F.col("s"), F.col("m")).alias("x")).collect()] == [{"a": "1", "summary": "new", "missing_attachments": '["f.pdf"]'}, {}, {"a": "1"}]


def test_answers_are_shared_by_equal_contexts_alone(spark):
    rows = [r["digest"] for r in stages.context_hashes(spark, DATA).collect()]
    texts = {(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(set(rows)) == len(texts) and len(rows) == 200
    other = evaluation.frozen_settings({"model": "m1", "relevance_threshold": 0.4}, ("model", "relevance_threshold"), {"rules": "b, a", "guide": "what counts!"}, "3")
    assert stages.FROZEN["knowledge_version"] != other["knowledge_version"] and stages.FROZEN["knowledge_version"].startswith("3+") and "other" not in stages.FROZEN
    one = spark.range(1).select(*[evaluation.context_hash([F.lit(x).alias("t"), F.lit(y).alias("u")], stages.FROZEN).alias(f"c{n}") for n, (x, y) in enumerate((("a", None), (None, "a"), ("a", "")))]).first()
    assert len(set(one)) == 3
