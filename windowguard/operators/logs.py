"""Service features from log lines, and log templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators.components import connected
from windowguard.operators.series import fill_windows
from windowguard.session import stage, stage_alone

WILDCARD = "<*>"
UNMATCHED = "-1"


def parse_logs(lines: DataFrame, timezone: str = K.LOG_TIMEZONE) -> DataFrame:
    """Add ts_ms, level and content to rows with a ``line``; lines that do not parse are dropped.

    Dropping them is part of the generator, since a filter would be pushed below the parsing and
    repeat it.
    """
    parts = F.array(S.log_parts(F.col("line"), timezone))
    kept = [c for c in lines.columns if c != "line"]
    return lines.select(*kept, F.inline(F.filter(parts, lambda p: p["ts_ms"].isNotNull())))


def _masked() -> Column:
    """The text of a line with a wildcard for each token with a digit, one space between tokens."""
    text = F.btrim(F.col("content"), F.lit(S.WHITESPACE))
    wild = F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*", WILDCARD)
    return F.regexp_replace(wild, r"\s+", " ")


def _template_key(df: DataFrame) -> DataFrame:
    """Add the masked text (unless there), its tokens, their number and the first one."""
    if "masked" not in df.columns:
        df = df.withColumn("masked", _masked())
    nothing = F.array().cast("array<string>")
    return (
        df.withColumn("tokens", F.when(F.col("masked") == "", nothing).otherwise(F.split("masked", " ")))
        .withColumn("n_tokens", F.size("tokens"))
        .withColumn("first_token", F.coalesce(F.get("tokens", F.lit(0)), F.lit("")))
    )


def condense(parsed: DataFrame, window_ms: int = K.WINDOW_MS, *extra: Column) -> DataFrame:
    """Counts ``n`` of the lines of each (case, service, window, level, masked text).

    Tokens with a digit are masked, so most lines merge before the shuffle. Stored, this table
    stands for the parsed lines: templates are fitted on it and matched with it, and the raw text
    is read and parsed once. ``extra`` are further aggregates to carry.
    """
    masked = parsed.withColumns({"masked": _masked(), "timestamp_window_ms": S.bucket(F.col("ts_ms"), window_ms)})
    keys = ["case_id", "service_name", "timestamp_window_ms", "level", "masked"]
    return masked.groupBy(*keys).agg(F.count("*").alias("n"), *extra)


LEAF = ["n_tokens", "first_token"]
#: Leaves of more tokens than this are not handled by one task.
LEAF_CELLS = 1 << 21


def _numbered(parsed: DataFrame) -> DataFrame:
    """(line, masked) and the leaf of every masked text; only the text is shuffled."""
    if "masked" not in parsed.columns:
        parsed = parsed.withColumn("masked", _masked())
    return _template_key(parsed.select("masked").distinct()).select(F.monotonically_increasing_id().alias("line"), *LEAF, "masked")


def _with_leaves(lines: DataFrame) -> DataFrame:
    """The numbered lines with the least line of their leaf and the number of its lines."""
    leaves = lines.groupBy(*LEAF).agg(F.min("line").alias("leaf"), F.count("*").alias("leaf_lines")).toDF("_n", "_first", "leaf", "leaf_lines")
    return lines.join(leaves, F.col("n_tokens").eqNullSafe(F.col("_n")) & (F.col("first_token") == F.col("_first"))).drop("_n", "_first")


def _varied(lines: DataFrame, group: str, *more: str) -> DataFrame:
    """(group, position): where a group, named by one of its lines, has a wildcard or more than one token; ``more`` are the same in a group."""
    first = lines.where(F.col("line") == F.col(group)).select(group, F.col("masked").alias("_first"))
    unlike = F.zip_with(F.split("masked", " "), F.split("_first", " "), lambda x, y: (x != y) | (x == WILDCARD))
    marked = lines.select(group, *more, "masked").join(first, group).select(group, *more, F.posexplode(unlike).alias("position", "_unlike"))
    return marked.where("_unlike").select(group, *more, "position").distinct()


def _reduced(lines: DataFrame, varied: DataFrame, group: str) -> DataFrame:
    """The leaf and template of each group: the tokens of the line that names it, with wildcards at the varied positions."""
    first = lines.where(F.col("line") == F.col(group)).select(group, F.posexplode(F.split("masked", " ")).alias("position", "token"))
    marked = first.join(varied.withColumn("_wild", F.lit(True)), [group, "position"], "left")
    token = F.when(F.col("_wild"), WILDCARD).otherwise(F.col("token"))
    ordered = marked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", token.alias("token")))).alias("_tokens"))
    tokens = F.transform("_tokens", lambda p: p["token"])
    # The first token is that of all lines of the leaf.
    return ordered.select(F.size("_tokens").alias("n_tokens"), F.get(tokens, F.lit(0)).alias("first_token"), F.array_join(tokens, " ").alias("template"))


def _cells(lines: DataFrame) -> DataFrame:
    """(leaf, need, line, cell) of the constant tokens; a cell is a hash of leaf, position and token.

    A line has about as many cells as tokens, so keys and links hold numbers, never a text. Equal
    hashes of unlike cells only make more lines meet.
    """
    tokens = lines.select("leaf", "need", "line", F.posexplode(F.split("masked", " ")).alias("position", "token"))
    return tokens.where(F.col("token") != WILDCARD).select("leaf", "need", "line", F.xxhash64("leaf", "position", "token").alias("cell"))


def _rarest(shared: DataFrame) -> DataFrame:
    """(cell, line): of the cells with ``df`` > 1 lines, the rarest of each line, as many as it may miss and one more."""
    of_line = Window.partitionBy("leaf", "line")
    places = {
        "place": F.row_number().over(of_line.orderBy("df", "cell")),
        "size": F.count("*").over(of_line),
    }
    return shared.withColumns(places).where(F.col("place") <= F.col("size") - F.col("need") + 1).select("cell", "line")


def leaf_keys(lines: DataFrame) -> DataFrame:
    """(cell, line): the keys at which the lines of a leaf meet that may be similar.

    ``lines`` has one row per masked text with its number, its leaf, the lines and tokens of that, and
    ``need``, the number of equal constant tokens that links two lines. Two such lines share one of the
    rarest (position, token) pairs of each, as many as a line may miss and one more.
    """
    # Most leaves have few lines: their texts, shorter than their cells, are moved, and the cells of a leaf stay in one task.
    small = F.col("leaf_lines") * F.col("n_tokens") <= LEAF_CELLS
    of_leaf = Window.partitionBy("leaf", "cell")
    rare = _rarest(_cells(lines.where(small)).withColumn("df", F.count("*").over(of_leaf)).where("df > 1"))
    large = lines.where(~small)
    if not large.isEmpty():
        cells = _cells(large)
        holders = stage(cells.groupBy("leaf", "cell").agg(F.count("*").alias("df")).where("df > 1"), "log-cells")
        rare = rare.unionByName(_rarest(cells.join(holders, ["leaf", "cell"])))
    return stage(rare, "log-keys")


def similar_lines(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(line, root): the least line of its group for every line that is linked to another one of its leaf.

    ``lines`` are those with ``keys``. They meet at those: first with the least line of a key, then all
    those that are still in different groups. Every meeting is verified.
    """

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct().join(lines.select("line", "leaf", "need", "masked"), "line")
        pairs = pairs.join(lines.select(F.col("line").alias("other"), F.col("leaf").alias("_leaf"), F.col("masked").alias("_others")), "other")
        equal = F.zip_with(F.split("masked", " "), F.split("_others", " "), lambda x, y: ((x == y) & (x != WILDCARD)).cast("int"))
        total = F.aggregate(equal, F.lit(0), lambda n, x: n + x)
        return pairs.where((F.col("leaf") == F.col("_leaf")) & (total >= F.col("need"))).select("line", "other")

    least = keys.groupBy("cell").agg(F.min("line").alias("other"))
    links = stage(verified(keys.join(least, "cell").where("line <> other").select("line", "other")), "log-links")
    roots = connected(links, "line", "other").select(F.col("node").alias("line"), "root")
    rooted = stage(keys.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line")), "log-rooted")
    # Cells whose lines are in one group already are done.
    open_keys = rooted.groupBy("cell").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("cell")
    rooted = rooted.join(open_keys, "cell", "left_semi")
    mates = rooted.select("cell", F.col("line").alias("other"), F.col("root").alias("_root"))
    apart = rooted.join(mates, "cell").where((F.col("line") < F.col("other")) & (F.col("root") != F.col("_root")))
    more = stage(verified(apart.select("line", "other")), "log-links")
    if not more.isEmpty():
        roots = connected(links.unionByName(more), "line", "other").select(F.col("node").alias("line"), "root")
    return roots


def _mixed_templates(many: DataFrame, mixed: DataFrame) -> DataFrame:
    """The leaf and template of the lines of mixed leaves, each once."""
    keys = stage_alone(lambda: leaf_keys(many.repartition("leaf").join(mixed, "leaf", "left_semi")), "log-keyed")
    # Few lines share enough cells to have keys. Which do is told by numbers, so texts are moved once.
    keyed = keys.select("line", F.lit(True).alias("keyed")).distinct()
    wanted = stage(many.select("leaf", "line").join(mixed, "leaf", "left_semi").select("line").join(keyed, "line", "left"), "log-wanted")
    rest = stage_alone(lambda: many.join(wanted, "line"), "log-rest", "zstd")
    held = rest.where("keyed").drop("keyed")
    linked = stage_alone(lambda: held.join(similar_lines(held, keys), "line", "left"), "log-grouped", "zstd")
    groups = linked.where("root is not null")
    texts = _reduced(groups, _varied(groups, "root"), "root")
    alone = rest.where("keyed is null").select(*LEAF, F.col("masked").alias("template"))
    alone = alone.unionByName(linked.where("root is null").select(*LEAF, F.col("masked").alias("template")))
    # The template of a group has a wildcard, so no line without one can say the same.
    wild = F.contains("template", F.lit(WILDCARD))
    return texts.unionByName(alone.where(wild)).distinct().unionByName(alone.where(~wild))


def fit_templates(parsed: DataFrame, similarity: float = K.TEMPLATE_SIMILARITY) -> DataFrame:
    """Templates of the lines: (n_tokens, first_token, template, template_id).

    Lines of the same token count and first token are a leaf. Within a leaf, lines are linked if at
    least ``similarity`` of their tokens are equal and constant (tokens with a digit are wildcards from
    the start and never count), and linked lines, directly or by others, make one template, in which
    tokens that vary are wildcards. A leaf whose lines all agree on that many tokens is one template
    without any comparison, and the line of a leaf of its own is one as it is. The result does not
    depend on the order of the lines.
    """

    def leaves() -> list[DataFrame]:
        texts = stage_alone(lambda: _numbered(parsed), "log-texts", "zstd")
        # Half of the leaves at a time, as all texts are on disk twice already.
        half = F.pmod(F.xxhash64(*LEAF), F.lit(2))
        return [_with_leaves(texts.where(half == i)) for i in range(2)]

    lines = stage_alone(leaves, "log-lines", "zstd")
    found = lines.where("leaf_lines = 1").select(*LEAF, F.coalesce("masked", F.lit("")).alias("template"))
    many = lines.where("leaf_lines > 1").withColumn("need", F.ceil(F.lit(similarity) * F.col("n_tokens") - F.lit(1e-9)).cast("int"))

    def varied_of_whole() -> DataFrame:
        varied = _varied(many, "leaf", "n_tokens", "need").withColumn("_varied", F.count("*").over(Window.partitionBy("leaf")))
        return varied.where(F.col("n_tokens") - F.col("_varied") >= F.col("need")).select("leaf", "position")

    # Lines of a leaf differ, so each leaf has varied positions; mixed leaves have too many.
    varied = stage_alone(varied_of_whole, "log-varied", "zstd")
    whole = varied.select("leaf").distinct()
    mixed = stage_alone(lambda: many.where("line = leaf").select("leaf").join(whole, "leaf", "left_anti"), "log-leaves")
    found = found.unionByName(stage_alone(lambda: _reduced(many.join(mixed, "leaf", "left_anti"), varied, "leaf"), "log-whole", "zstd"))
    if not mixed.isEmpty():
        found = found.unionByName(stage_alone(lambda: _mixed_templates(many, mixed), "log-mixed", "zstd"))
    return found.withColumn("template_id", F.md5("template"))


def match_templates(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``template_id`` to parsed lines; a line no template fits gets ``-1``.

    Of several templates of a leaf that fit, the one with most constant tokens is taken, then the
    least id.
    """
    words = F.split("template", " ")
    constant = F.size(F.filter(words, lambda t: t != WILDCARD))
    entry = F.struct((-constant).alias("order"), F.col("template_id").alias("id"), words.alias("words"))
    leaves = templates.groupBy(*LEAF).agg(F.array_sort(F.collect_list(entry)).alias("_leaf"))
    joined = _template_key(parsed).join(leaves, LEAF, "left")

    def fits(t: Column) -> Column:
        pairs = F.zip_with("tokens", t["words"], lambda a, b: (b == WILDCARD) | (a == b))
        return (F.col("n_tokens") == 0) | F.forall(pairs, lambda ok: ok)

    best = F.get(F.filter("_leaf", fits), F.lit(0))["id"]
    return joined.withColumn("template_id", F.coalesce(best, F.lit(UNMATCHED))).select(*parsed.columns, "template_id")


def aggregate_logs(parsed: DataFrame, window_ms: int = K.WINDOW_MS) -> DataFrame:
    """Event, error and distinct-template counts per (case, service, window), of lines or condensed lines."""
    if "n" not in parsed.columns:
        parsed = parsed.withColumns(
            {"timestamp_window_ms": S.bucket(F.col("ts_ms"), window_ms), "n": F.lit(1).cast("long")}
        )
    errors = F.sum(F.when(F.col("level").isin(K.ERROR_LEVELS), F.col("n")).otherwise(0))
    return parsed.groupBy("case_id", "service_name", "timestamp_window_ms").agg(
        F.sum("n").alias("event_count"),
        errors.alias("error_count"),
        F.count_distinct("template_id").alias("unique_templates"),
    )


def log_features(
    parsed: DataFrame, templates: DataFrame | None, window_ms: int = K.WINDOW_MS
) -> DataFrame:
    """The three log features, windows without events filled with 0.

    Without templates every line counts as unmatched. The counts are staged, so that filling the
    gaps does not parse the lines again.
    """
    if templates is None:
        matched = parsed.withColumn("template_id", F.lit(UNMATCHED))
    else:
        matched = match_templates(parsed, templates)
    counts = ["event_count", "error_count", "unique_templates"]
    keys = ["case_id", "service_name"]
    windows = stage(aggregate_logs(matched, window_ms), "log-windows")
    filled = fill_windows(windows, keys, "timestamp_window_ms", window_ms, counts)

    def share(count: str) -> Column:
        return F.coalesce(F.try_divide(count, "event_count"), F.lit(0.0))

    return filled.select(
        *keys,
        "timestamp_window_ms",
        F.col("event_count").cast("double").alias("service_log__event_rate"),
        share("error_count").alias("service_log__error_ratio"),
        share("unique_templates").alias("service_log__template_diversity"),
    )
