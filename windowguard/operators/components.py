"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.session import stage


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with a link to another one; root is the least node of its group.

    Each round a node, and the root it has so far, take the least root among the node's neighbours;
    then every node takes the root of its root. Labels are written after each round; links with a null
    end or to the node itself are ignored.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = stage(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = stage(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("root").alias("near")), "other")
        near = near.groupBy("node").agg(F.min("near").alias("near")).join(labels, "node")
        offers = near.select("node", F.least("near", "root").alias("root")).unionByName(
            near.select(F.col("root").alias("node"), F.least("near", "root").alias("root"))
        )
        least = offers.groupBy("node").agg(F.min("root").alias("root"))
        above = least.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = least.join(above, "root").select("node", F.col("top").alias("root"))
        after = stage(after, "labels")
        changed = after.join(labels.withColumnRenamed("root", "_before"), "node").where(F.col("root") != F.col("_before"))
        if changed.isEmpty():
            return after
        labels = after
