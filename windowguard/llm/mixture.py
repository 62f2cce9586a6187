"""Mixing sources to target weights by hierarchical token budgets.

Documents sit in a tree of domain, language and source. The total budget flows down by integer
weights; a node whose leaves cannot use their share, all epochs counted, passes what is left to its
siblings, and only what a whole family cannot use reaches the parent's siblings. Each leaf then
takes whole epochs and the first documents of one more, in an order seeded per epoch.

Budgets are integers, so the same numbers come out at any parallelism.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.session import stage

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf that share a prefix-sum bucket.
BUCKET_ROWS = 4096
ORDER_DIGITS = 10


@dataclass(frozen=True)
class Recipe:
    """Weights by path (a domain; domain/lang; domain/lang/source), 1 where none is given.

    ``share`` is the budget in percent of all tokens, ``max_epochs`` how often a document may be
    used at most. Weights are whole numbers; a node of weight zero is left out.
    """

    weights: dict[str, int] = field(default_factory=dict)
    share: int = 50
    max_epochs: int = 2
    seed: int = 42

    def weight(self, level: int) -> Column:
        path = F.concat_ws("/", *LEVELS[: level + 1])
        out = F.lit(1)
        for name, value in self.weights.items():
            if name.count("/") == level:
                out = F.when(path == name, value).otherwise(out)
        return out.cast("long")


def source_domain(source: Column | str = "source") -> Column:
    """A domain of the numbered sources: their number modulo four."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), number.cast("long") % 4)).otherwise("other")


def count_tokens(text: Column | str = "text") -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of the children of each node, by weight, none above its capacity.

    Needs ``budget`` (of the parent), ``capacity`` and ``weight``. Children fill up in the order of
    capacity by weight; those that the level of the rest would overfill get their capacity, the
    others share what is left. A family is as large as a node has children.
    """
    family = Window.partitionBy(*parent)
    line = family.orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("capacity") * rest <= (F.col("budget") - before) * F.col("weight")
    marked = children.withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    shared = marked.withColumns({"taken": taken, "open_weight": open_weight})
    part = F.expr("(budget - taken) * weight div open_weight")
    return shared.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop(
        "full", "taken", "open_weight", "budget", "weight", "capacity"
    )


def leaf_budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """``budget`` of every leaf; ``leaves`` has the levels, tokens and rows, one row a leaf."""
    for level in range(len(LEVELS)):
        leaves = leaves.where(recipe.weight(level) > 0)
    leaves = stage(leaves.withColumn("capacity", F.col("tokens") * recipe.max_epochs), "leaves")
    everything = Window.partitionBy()
    whole = F.least(
        F.expr(f"sum(tokens) OVER () * {recipe.share} div 100"), F.sum("capacity").over(everything)
    )
    budgets, parent = None, []
    for level, name in enumerate(LEVELS):
        path = [*parent, name]
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
        # The root's children, as many as there are domains, add up to the whole.
        children = nodes.withColumn("budget", whole) if budgets is None else nodes.join(budgets, parent)
        children = children.withColumn("weight", recipe.weight(level)).drop("tokens")
        budgets, parent = share_out(children, parent, name).withColumnRenamed("share", "budget"), path
    return leaves.select(*LEVELS, "tokens", "rows").join(budgets, list(LEVELS))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: an MD5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan_leaves(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """For each leaf: budget, whole epochs, and the last key of the started epoch (null: none).

    ``rows`` has the levels, doc_id and n_tokens. Prefix sums run over ranges of the order key, a
    few thousand documents each, so a leaf with most of all documents is many small groups.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    budgets = leaf_budgets(leaves, recipe)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    plan = budgets.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = stage(plan.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)), "mixture")
    keyed = (
        rows.join(plan.where("rest > 0"), list(LEVELS))
        .withColumn("key", order_key(recipe.seed, F.col("whole") + 1, F.col("doc_id")))
        # Rows of one id are taken together.
        .groupBy(*LEVELS, "rest", "buckets", "key")
        .agg(F.sum("n_tokens").alias("n_tokens"))
    )
    place = F.conv(F.substring("key", 1, ORDER_DIGITS), 16, 10).cast("long")
    bucket = F.shiftright(place * F.col("buckets"), 4 * ORDER_DIGITS)
    keyed = stage(keyed.withColumn("bucket", bucket), "mixture-keys")
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("tokens"))
    line = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("tokens").over(line), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        keyed.join(before, [*LEVELS, "bucket"])
        .where(F.col("before") <= F.col("rest"))
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy(*LEVELS)
        .agg(F.max("key").alias("last_key"))
    )
    return stage(plan.join(last, list(LEVELS), "left").select(*LEVELS, "budget", "whole", "last_key"), "mixture-plan")


def select(docs: DataFrame, recipe: Recipe, domain: Column | None = None) -> DataFrame:
    """The chosen documents with all their columns in a struct ``row``, and domain, lang, source,
    n_tokens, leaf_budget and ``epochs``, the number of times each is used.

    ``docs`` needs doc_id, text, lang and source. Null languages and sources are nodes named
    "unknown"; a null text has no tokens; a leaf without tokens has no budget and gives nothing.
    Rows that share a leaf and an id are taken or left together, nulls being one id. A leaf's last
    document may leave some of its budget unused; documents are never cut. No documents, no rows.
    """
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        "doc_id",
        (source_domain() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        count_tokens().alias("n_tokens"),
    ).withColumn("domain", F.coalesce("domain", F.lit("other")))
    light = stage(keyed.drop("row"), "mixture-rows")
    plan = plan_leaves(light, recipe)
    key = order_key(recipe.seed, F.col("whole") + 1, F.col("doc_id"))
    more = F.coalesce((key <= F.col("last_key")).cast("long"), F.lit(0))
    return (
        keyed.join(plan, list(LEVELS))
        .withColumn("epochs", F.col("whole") + more)
        .where("epochs > 0")
        .select("row", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), "epochs")
    )


def mixed(docs: DataFrame, recipe: Recipe, domain: Column | None = None) -> DataFrame:
    """The chosen documents with their own columns, each as often as it is used."""
    chosen = select(docs, recipe, domain)
    if recipe.max_epochs > 1:
        chosen = chosen.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    return chosen.select("row.*")
