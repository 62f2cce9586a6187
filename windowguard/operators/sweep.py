"""Decision trees for all pairs of an error type and a service at once.

Every pair has its own sample of runs, its own training half and its own tree, but all of them grow
together: per level there is one aggregation of counts by (pair, node, token, bin) and one join that
moves the sequences to their child nodes. The number of Spark jobs depends on the depth alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.operators.series import prefix_sums
from windowguard.operators.textmodels import split_by_hash
from windowguard.session import stage

PAIR = ["error_type", "service"]
NODE = [*PAIR, "node"]
ROOT = 1


@dataclass(frozen=True)
class Sweep:
    """What a sweep compares and how its trees grow; a sequence's half and a pair's runs follow ``seed``."""

    normal: str = "correct"
    n_runs: int = 100
    fraction: float = 0.5
    max_depth: int = 5
    max_bins: int = 32
    seed: int = 42


def sample_pairs(sequences: DataFrame, seq_id: str, plan: Sweep) -> DataFrame:
    """(error_type, service, seq, label): the sequences of every pair, in the runs drawn for it.

    ``sequences`` has (seq_id, run, test_name, service). A pair is an error test that some run has at a
    service. It draws ``n_runs`` of the runs that have it, in the order of a hash of seed, error type,
    service and run, and takes from those the error test (label 1) and the normal test (label 0) of its
    service. A run or sequence may serve many pairs. Rows with a null in any of the columns are left out.
    """
    rows = sequences.select("run", "test_name", "service", F.col(seq_id).alias("seq")).dropna()
    errors = rows.where(F.col("test_name") != plan.normal).withColumnRenamed("test_name", "error_type")
    dice = F.md5(F.concat_ws("|", F.lit(str(plan.seed)), "error_type", "service", "run"))
    # As many rows as runs have the error, whatever the number of their sequences.
    place = F.row_number().over(Window.partitionBy(*PAIR).orderBy(dice, "run"))
    runs = errors.select(*PAIR, "run").distinct().withColumn("_place", place).where(F.col("_place") <= plan.n_runs).drop("_place")
    runs = stage(runs, "sweep-runs")
    normals = rows.where(F.col("test_name") == plan.normal).drop("test_name")
    return (
        errors.join(runs, [*PAIR, "run"], "left_semi")
        .select(*PAIR, "seq", F.lit(1).alias("label"))
        .unionByName(normals.join(runs, ["service", "run"]).select(*PAIR, "seq", F.lit(0).alias("label")))
        .distinct()
    )


def binned(tokens: DataFrame, seq_id: str, value: str, plan: Sweep) -> DataFrame:
    """(seq, token, bin) of every cell with a value above zero, bins counted from 1 by token.

    A token with at most ``max_bins`` distinct values has a bin for each, any other one that many bins
    of about equal numbers of cells. Equal values share a bin; a token that a sequence lacks is bin 0.
    """
    cells = tokens.where(F.col(value) > 0).select(F.col(seq_id).alias("seq"), "token", F.col(value).cast("double").alias("value"))
    sizes = cells.groupBy("token", "value").agg(F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(sizes, ["token"], "value", ["n", "one"])
    even = F.floor(F.col("n_before") * plan.max_bins / F.col("n_total"))
    number = F.when(F.col("one_total") <= plan.max_bins, F.col("one_before")).otherwise(even) + 1
    bins = ranked.select("token", "value", number.cast("int").alias("bin"))
    # The least value of all is in the first bin whatever its token: those cells, most of them if values are counts, stay.
    least = F.lit(cells.agg(F.min("value")).first()[0]).cast("double")
    above = cells.where(F.col("value") > least).join(bins, ["token", "value"]).select("seq", "token", "bin")
    first = cells.where(F.col("value") == least).where(F.col("token").isNotNull()).select("seq", "token", F.lit(1).alias("bin"))
    return stage(first.unionByName(above), "sweep-cells")


def _purity(positive: Column, n: Column) -> Column:
    """Sum of squared class counts over the size: what a split of least Gini impurity makes large."""
    return (positive * positive + (n - positive) * (n - positive)) / n


def best_splits(members: DataFrame, cells: DataFrame) -> DataFrame:
    """(pair, node, token, bin, n, positive): the best split of every node that one improves.

    The cells of bin ``bin`` and above go right. A split has to leave rows on both sides and must change
    the share of positives; among equally good ones the first token and then the lowest bin is taken.
    """
    here = members.groupBy(*NODE).agg(F.count("*").alias("n"), F.sum("label").alias("positive"))
    here = here.where((F.col("positive") > 0) & (F.col("positive") < F.col("n")))
    # Only cells of nodes that can still be split are counted; the counts are added up before the shuffle.
    open_nodes = stage(here, "sweep-nodes")
    counts = (
        members.join(open_nodes.select(*NODE), NODE, "left_semi")
        .join(cells, "seq")
        .groupBy(*NODE, "token", "bin")
        .agg(F.count("*").alias("_n"), F.sum("label").alias("_p"))
    )
    above = Window.partitionBy(*NODE, "token").orderBy(F.desc("bin"))
    sides = counts.withColumns({"n_right": F.sum("_n").over(above), "p_right": F.sum("_p").over(above)}).join(open_nodes, NODE)
    n_left, p_left = F.col("n") - F.col("n_right"), F.col("positive") - F.col("p_right")
    score = _purity(F.col("p_right"), F.col("n_right")) + _purity(p_left, n_left)
    useful = sides.where((n_left > 0) & (F.col("p_right") * F.col("n") != F.col("positive") * F.col("n_right")))
    order = F.struct((-score).alias("score"), F.col("token"), F.col("bin"))
    best = useful.groupBy(*NODE, "n", "positive").agg(F.min(order).alias("_best"))
    return best.select(*NODE, "_best.token", "_best.bin", "n", "positive")


def descend(members: DataFrame, splits: DataFrame, cells: DataFrame) -> DataFrame:
    """Members at the child nodes of their splits; those at a node without a split stay."""
    at = members.join(splits.select(*NODE, "token", F.col("bin").alias("_cut")), NODE, "left")
    # Of the cells only those of tokens that split a node move, as many as there are nodes at most.
    asked = cells.join(splits.select("token"), "token", "left_semi")
    moved = at.join(asked, ["seq", "token"], "left")
    right = F.coalesce(F.col("bin") >= F.col("_cut"), F.lit(False)).cast("long")
    node = F.when(F.col("_cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + right)
    return moved.withColumn("node", node).select(*members.columns)


def grow(members: DataFrame, cells: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(members at their leaves, splits of all trees); rows with ``train`` false only move along."""
    splits = None
    for depth in range(max_depth):
        new = stage(best_splits(members.where("train").drop("train"), cells), "sweep-splits")
        if new.isEmpty():
            break
        splits = new if splits is None else splits.unionByName(new)
        members = stage(descend(members, new, cells), f"sweep-level-{depth}")
    if splits is None:
        splits = best_splits(members.where("train").drop("train"), cells).limit(0)
    return members, splits


def tree_sweep(tokens: DataFrame, sequences: DataFrame, seq_id: str, plan: Sweep | None = None, value: str = "n") -> tuple[DataFrame, DataFrame]:
    """Scores of the test sequences of every pair, and the trees.

    ``tokens`` has (seq_id, token, value): counts, or weights of ``vector_cells``, stored and binned once
    for all pairs. Scores are (error_type, service, seq_id, label, score), score the share of label 1 in
    the training rows of the leaf; a pair without training rows scores null. Trees are (error_type, service,
    node, token, bin, n, positive), the root is node 1 and the children of node i are 2i and 2i + 1, where
    cells of at least ``bin`` go to the latter. Without pairs both are empty.
    """
    plan = plan or Sweep()
    cells = binned(tokens, seq_id, value, plan)
    pairs = sample_pairs(sequences, seq_id, plan)
    train, test = split_by_hash(pairs, "seq", plan.fraction, plan.seed)
    halves = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    members = stage(halves.withColumn("node", F.lit(ROOT).cast("long")), "sweep-members")
    members, splits = grow(members, cells, plan.max_depth)
    leaves = members.where("train").groupBy(*NODE).agg((F.sum("label") / F.count("*")).alias("score"))
    scored = members.where(~F.col("train")).join(leaves, NODE, "left")
    return scored.select(*PAIR, F.col("seq").alias(seq_id), F.col("label").cast("double").alias("label"), "score"), splits
