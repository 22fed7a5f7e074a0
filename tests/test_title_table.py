import random

import pytest
from pyspark.sql import functions as F

from docketry.functions.similarity import WordTable, token_set, token_set_table
from docketry.operators import ladder
from docketry.operators.ladder import LadderRules


def test_a_table_of_titles_is_the_ratio_of_each_two():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeİ") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    titles = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(260)]
    titles += ["", "a", "a a b", "x" * 63, "y" * 31 + " " + "z" * 31, "y" * 31 + " " + "z" * 30, "x" * 62 + "y"]
    titles = [t for t in titles if WordTable.fits(" ".join(sorted(set(t.split()))))]
    left, right = titles[::2], titles[1::2] + titles[-3:]
    got = token_set_table(WordTable(left), WordTable(right))
    assert got.tolist() == [[token_set(a, b) for b in right] for a in left]
    assert token_set_table(WordTable([]), WordTable(right)).shape == (0, len(right))


@pytest.mark.parametrize("rows", [0, 300])
def test_a_crowded_title_takes_as_many_rounds_as_it_has_blocks(spark, monkeypatch, rows):
    """Two sources publish one title over and over; each copy's record hangs on the one before."""
    docs = spark.range(160).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"))
    keys = docs.select("doc_id", F.lit("t").alias("key"), F.lit(False).alias("strong"))
    a, b = (docs.select(F.col("doc_id").alias(c), F.col("source").alias(f"s{c}")) for c in "ab")
    pairs = a.join(b, (F.col("a") < F.col("b")) & (F.col("b") - F.col("a") < 4) & (F.col("sa") != F.col("sb"))).select("a", "b", F.lit(0.95).alias("score"))
    seen, staged = [], ladder.staged
    monkeypatch.setattr(ladder, "staged", lambda df, name: seen.append(name) or staged(df, name))
    got = {r["doc_id"]: r["record"] for r in ladder.link_ladder(docs, keys, pairs, rules=LadderRules(group_rows=rows)).collect()}
    assert got == {i: i - i % 2 for i in range(160)}
    assert seen.count("settled") <= 16
