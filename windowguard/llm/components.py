"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.session import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another one; root is the least node it reaches.

    Each round links all larger neighbours of a node to its least neighbour, then the node and its
    smaller neighbours to the least of them, until nothing changes: about log(nodes) rounds. The
    links are kept distinct and written after each round, minima are pre-aggregated, and the joins
    are plain equi-joins, so a node with very many links is split by the adaptive planner. Links of
    a node to itself or with a null end are ignored; no links give no rows.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    edges = stage(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(least, "u").select(F.inline(ends)).where("u != v").distinct()
        edges = stage(small, "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
