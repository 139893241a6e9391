"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import release, written


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of the links a, b (longs).

    Rounds of minimum over neighbours and pointer jumping until nothing changes; each round is
    written, so neither the lineage nor the driver grows. A node with many links costs one row per
    link in a join that may be split, and its minima are combined before the shuffle.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        step = written(lower)
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = written(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.col("label") > F.least("next", F.coalesce("far", "next"))).alias("moved")))
        done = after.where("moved").isEmpty()
        release(step)
        release(labels)
        labels = after
        if done:
            release(both)
            return labels.select("node", "label")
