"""A decision tree on sparse vectors, whose work follows the non-zero cells and not the vocabulary.

``pyspark.ml`` spreads every row to one number per feature, so a large vocabulary does not fit its executors.
Here a level is one aggregation of counts by (node, feature, bin) over the cells of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.session import stage

MAX_BINS = 32
MAX_DEPTH = 5
ROOT = 1
#: Below this a node counts as pure.
PURE = 2.0**-52


@dataclass(frozen=True)
class Node:
    """Rows ``n`` and positives ``p`` of a node and, if it is split, the feature and what goes left."""

    n: int
    p: int
    feature: int | None = None
    threshold: float | None = None


def _cells(rows: DataFrame) -> DataFrame:
    """(_row, label, index, value) of the cells that are not zero."""
    point = F.unwrap_udt("features")
    places = F.coalesce(point["indices"], F.sequence(F.lit(0), F.size(point["values"]) - 1))
    cells = F.arrays_zip(places.alias("index"), point["values"].alias("value"))
    return rows.select("_row", "label", F.inline(cells)).where("value <> 0")


def binned(cells: DataFrame, n_rows: int, max_bins: int = MAX_BINS) -> DataFrame:
    """(index, value, bin, threshold): every value of a feature, zero too where a row lacks it.

    A feature with at most ``max_bins`` values has a bin for each. Any other is cut into that many of about
    equal numbers of rows: a bin ends where the count of rows below passes the middle between two values, a
    value that fills several bins takes one, and those behind it make up for it one value at a time.
    ``threshold`` lies between a bin's last value and the next one. Features of one value are left out.
    """
    bins = min(max_bins, n_rows)
    stride = n_rows / bins
    sizes = cells.groupBy("index", "value").agg(F.count("*").alias("n"))
    sizes = stage(sizes, "tree-values")
    zeros = sizes.groupBy("index").agg((F.lit(n_rows) - F.sum("n")).alias("n")).where("n > 0")
    every = sizes.unionByName(zeros.select("index", F.lit(0.0).alias("value"), "n"))
    feature = Window.partitionBy("index")
    by_value = feature.orderBy("value")
    ranked = every.select(
        "index",
        "value",
        F.lead("value").over(by_value).alias("_next"),
        (F.row_number().over(by_value) - 1).alias("_place"),
        F.count("*").over(feature).alias("_kinds"),
        (F.sum("n").over(by_value) - F.col("n") / 2.0).alias("_middle"),
    ).where("_kinds > 1")
    # Ends of bins of equal size below the middle, less the number of values: its least so far is the lag.
    due = F.when(F.col("_place") > 0, F.ceil(F.col("_middle") / stride) - 1 - F.col("_place")).otherwise(0)
    lag = F.min(due).over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.when(F.col("_kinds") <= bins, F.col("_place")).otherwise(F.col("_place") + F.least(lag, F.lit(0)))
    numbered = ranked.withColumn("bin", number.cast("int"))
    last = F.lead("bin").over(by_value)
    between = F.when(last > F.col("bin"), (F.col("value") + F.col("_next")) / 2.0)
    return numbered.withColumn("threshold", between).select("index", "value", "bin", "threshold")


def _gini(n: Column, p: Column) -> Column:
    no, yes = (n - p) / n, p / n
    return F.lit(1.0) - no * no - yes * yes


def _best(counts: DataFrame, zero_bins: DataFrame, nodes: dict[int, Node]) -> dict[int, tuple]:
    """Node to (feature, bin, n left, p left) of the split that gains most; the first one of equal ones."""
    sizes = {k: F.create_map(*(F.lit(x) for i, node in nodes.items() for x in (i, getattr(node, k)))) for k in "np"}
    here = counts.groupBy("node", "index").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    rest = here.join(zero_bins, "index").select(
        "node", "index", "bin", (sizes["n"][F.col("node")] - F.col("_n")).alias("_n"), (sizes["p"][F.col("node")] - F.col("_p")).alias("_p")
    )
    # Cells of a feature that share the bin of zero have been counted apart from the rows without the feature.
    rows = counts.unionByName(rest.where("_n > 0")).groupBy("node", "index", "bin").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    upto = Window.partitionBy("node", "index").orderBy("bin")
    sides = rows.select(
        "node", "index", "bin", F.sum("_n").over(upto).alias("nl"), F.sum("_p").over(upto).alias("pl"),
        sizes["n"][F.col("node")].alias("n"), sizes["p"][F.col("node")].alias("p"),
    ).where("nl < n")
    n, p, nl, pl = (F.col(c) for c in ("n", "p", "nl", "pl"))
    gain = _gini(n, p) - nl / n * _gini(nl, pl) - (n - nl) / n * _gini(n - nl, p - pl)
    order = F.struct((-gain).alias("loss"), "index", "bin", "nl", "pl")
    best = sides.groupBy("node").agg(F.min(order).alias("_best")).where("_best.loss < 0").select("node", "_best.*")
    return {r["node"]: (r["index"], r["bin"], r["nl"], r["pl"]) for r in best.collect()}  # a row per node of the level


def _feature(index: int) -> Column:
    """The value of one feature of ``_point``, zero where a sparse vector lacks it."""
    point = F.col("_point")
    place = F.when(point["indices"].isNull(), F.lit(index)).otherwise(F.array_position(point["indices"], F.lit(index)).cast("int") - 1)
    return F.coalesce(F.when(place >= 0, F.get(point["values"], place)), F.lit(0.0))


def grow(train: DataFrame, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS) -> dict[int, Node]:
    """Nodes of the tree of (label, features); the root is 1, the children of i are 2i and 2i + 1.

    Splits by Gini impurity as ``pyspark.ml`` makes them without sampling: of equal gains the first feature
    and the lowest threshold is taken. The driver holds the nodes, 2 ** (max_depth + 1) at most.
    """
    rows = stage(train.select(F.monotonically_increasing_id().alias("_row"), F.col("label").cast("double").alias("label"), "features"), "tree-rows")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("p")).first()
    nodes = {ROOT: Node(total["n"], total["p"])}
    if not total["n"]:
        return nodes
    values = stage(binned(_cells(rows), total["n"], max_bins), "tree-bins")
    zero_bins = values.where("value = 0").select("index", "bin")
    cells = stage(_cells(rows).join(values.select("index", "value", "bin"), ["index", "value"]).select("_row", "label", "index", "bin"), "tree-cells")
    points = rows.select("_row", F.unwrap_udt("features").alias("_point"))
    level = {ROOT: nodes[ROOT]}
    for _ in range(max_depth):
        level = {i: node for i, node in level.items() if abs(1 - (node.p / node.n) ** 2 - (1 - node.p / node.n) ** 2) >= PURE}
        if not level:
            break
        at = points.select("_row", _walk(nodes, lambda i, _: F.lit(i) if i in level else F.lit(None).cast("int")).alias("node"))
        at = at.where("node is not null")
        counts = cells.join(at, "_row").groupBy("node", "index", "bin").agg(F.count("*").alias("_n"), F.sum("label").cast("long").alias("_p"))
        splits = _best(stage(counts, "tree-counts"), zero_bins, level)
        if not splits:
            break
        wanted = values.where("threshold is not null").where(F.array_contains(F.lit([f"{f} {b}" for f, b, *_ in splits.values()]), F.concat_ws(" ", "index", "bin")))
        cuts = {(r["index"], r["bin"]): r["threshold"] for r in wanted.collect()}  # one per split
        below = {}
        for i, (index, cut, n_left, p_left) in splits.items():
            node = level[i]
            nodes[i] = Node(node.n, node.p, index, cuts[index, cut])
            below[2 * i], below[2 * i + 1] = Node(n_left, p_left), Node(node.n - n_left, node.p - p_left)
        nodes |= below
        level = below
    return pruned(nodes)


def pruned(nodes: dict[int, Node]) -> dict[int, Node]:
    """The tree with two leaves of one majority made their parent, from the bottom up."""
    kept = dict(nodes)
    for i in sorted(nodes, reverse=True):
        node, sides = kept[i], [kept.get(2 * i), kept.get(2 * i + 1)]
        if node.feature is not None and all(s.feature is None for s in sides) and len({2 * s.p > s.n for s in sides}) == 1:
            kept[i] = Node(node.n, node.p)
            del kept[2 * i], kept[2 * i + 1]
    return kept


def _walk(nodes: dict[int, Node], leaf, i: int = ROOT) -> Column:
    node = nodes[i]
    if node.feature is None:
        return leaf(i, node)
    left, right = _walk(nodes, leaf, 2 * i), _walk(nodes, leaf, 2 * i + 1)
    return F.when(_feature(node.feature) <= node.threshold, left).otherwise(right)


def score(rows: DataFrame, nodes: dict[int, Node]) -> DataFrame:
    """Add ``score``, the share of label 1 in the leaf of ``features``."""
    share = _walk(nodes, lambda _, node: F.lit(node.p / node.n if node.n else None).cast("double"))
    return rows.withColumn("_point", F.unwrap_udt("features")).withColumn("score", share).drop("_point")
