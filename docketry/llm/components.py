"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """Rows (node, comp): every node of ``links`` (a, b), and the smallest node that it reaches.

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so the number of rounds is about logarithmic in the
    longest path.  Every round is written to the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("near"))
        target = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        stepped = staged(near.join(target, "near", "left").select("node", "comp", F.least("near", "far").alias("next")), "labels")
        moved = stepped.where("next <> comp").limit(1).count()
        labels = stepped.select("node", F.col("next").alias("comp"))
        if not moved:
            return labels
