"""Points in time against any number of intervals per key, as an equi-join on time bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.operators.series import prefix_sums
from windowguard.session import stage

#: A bin of the next level is as long as this many of the level below.
FAN = 64
LEVELS = 6
#: A piece of the next level of ``coverage`` is as long as this many of the level below.
RANK_FAN = 4


def merged(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): the intervals of a key with those that overlap or touch made one.

    Intervals without a start or end, and those that end before they start, are left out.
    """
    rows = intervals.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    before = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    number = F.sum("_opens").over(Window.partitionBy(*keys).orderBy(start))
    numbered = rows.withColumn("_opens", opens).withColumn("_group", number)
    return numbered.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def coverage(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n_intervals, longest): the stretches of a key that the same intervals cover.

    ``start`` and ``end`` are whole numbers, both inclusive; ``longest`` is the largest end - start of the
    ``n_intervals`` that cover a stretch. Stretches are disjoint, at most two an interval, however many
    overlap. Their number comes from prefix sums over the ends. For the longest, an interval is cut into
    pieces whose lengths, in stretches, are powers of RANK_FAN; the longest of each piece is kept, and a
    stretch looks at the one piece of each length that holds it. Intervals with a null, and those that end
    before they start, are left out.
    """
    rows = stage(intervals.where(F.col(start) <= F.col(end)).select(*keys, start, end), "intervals")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    opens = rows.select(*keys, F.col(start).alias("_at"), one.alias("_opens"), none.alias("_closes"))
    closes = rows.select(*keys, (F.col(end) + 1).alias("_at"), none.alias("_opens"), one.alias("_closes"))
    ends = opens.unionByName(closes).groupBy(*keys, "_at").agg(F.sum("_opens").alias("_opens"), F.sum("_closes").alias("_closes"))
    ends = stage(ends.withColumn("_one", one), "interval-ends")
    active = F.col("_opens_before") + F.col("_opens") - F.col("_closes_before") - F.col("_closes")
    ranked = prefix_sums(ends, keys, "_at", ["_opens", "_closes", "_one"])
    ranked = stage(ranked.select(*keys, "_at", F.col("_one_before").alias("_rank"), active.alias("n_intervals")), "interval-ranks")

    # Of intervals with one start the one that ends last is longest wherever another lies.
    widest = rows.groupBy(*keys, start).agg(F.max(end).alias(end))
    first = ranked.select(*keys, F.col("_at").alias(start), F.col("_rank").alias("_low"))
    behind = ranked.select(*keys, (F.col("_at") - 1).alias(end), F.col("_rank").alias("_high"))
    placed = widest.join(first, [*keys, start]).join(behind, [*keys, end])
    top = ranked.agg(F.max("_rank")).first()[0] or 0
    sizes = [RANK_FAN**k for k in range(1 + next(k for k in range(64) if RANK_FAN**k > top))]

    def whole(size: int) -> tuple[Column, Column]:
        return F.ceil(F.col("_low") / size).cast("long"), F.floor(F.col("_high") / size).cast("long")

    def pieces(level: int, low: Column, high: Column) -> Column:
        bins = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(bins, lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_bin")))

    cut = []
    for level, size in enumerate(sizes):
        low, high = whole(size)
        upper_low, upper_high = whole(size * RANK_FAN)
        above = upper_low < upper_high
        cut.append(pieces(level, low, F.when(above, upper_low * RANK_FAN).otherwise(high)))
        cut.append(pieces(level, F.when(above, upper_high * RANK_FAN).otherwise(high), high))
    held = placed.select(*keys, (F.col(end) - F.col(start)).alias("longest"), F.explode(F.concat(*cut)).alias("_piece"))
    held = held.groupBy(*keys, "_piece._level", "_piece._bin").agg(F.max("longest").alias("longest"))
    looks = F.array(*[
        F.struct(F.lit(level).alias("_level"), F.floor(F.col("_rank") / size).cast("long").alias("_bin")) for level, size in enumerate(sizes)
    ])
    covered = ranked.where("n_intervals > 0")
    looking = covered.select(*keys, "_rank", F.explode(looks).alias("_look")).select(*keys, "_rank", "_look.*")
    longest = looking.join(stage(held, "interval-pieces"), [*keys, "_level", "_bin"]).groupBy(*keys, "_rank").agg(F.max("longest").alias("longest"))
    after = ranked.select(*keys, (F.col("_rank") - 1).alias("_rank"), (F.col("_at") - 1).alias(end))
    found = covered.join(after, [*keys, "_rank"]).join(longest, [*keys, "_rank"])
    return found.select(*keys, F.col("_at").alias(start), end, "n_intervals", "longest")


def inside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Every point with every interval of its keys that covers it, both ends inclusive.

    ``at``, ``start`` and ``end`` are numbers in one unit, ``width`` is the length of a bin in it. An
    interval becomes one row per bin that it touches; a long one takes bins of a higher level, FAN times
    as long each, so no interval makes more than FAN + 2 rows, but for those beyond the top level.
    A point looks into one bin of each level that occurs. Points of one key and bin can be split among
    tasks, as they are the streamed side of an equi-join. Nulls match nothing.
    """
    length = F.col(end) - F.col(start)
    level = reduce(
        lambda rest, k: F.when(length <= width * FAN ** (k + 1), k).otherwise(rest), reversed(range(LEVELS - 1)), F.lit(LEVELS - 1)
    )
    leveled = stage(intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level), "intervals")
    size = F.lit(float(width)) * F.pow(F.lit(float(FAN)), F.col("_level"))

    def bin_of(time: Column, size: Column) -> Column:
        return F.floor(time / size).cast("long")

    cut = leveled.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), size), bin_of(F.col(end), size))))
    used = sorted(r[0] for r in leveled.select("_level").distinct().collect())  # LEVELS rows at most
    looks = F.array(*[F.struct(F.lit(k).alias("_level"), bin_of(F.col(at), F.lit(float(width * FAN**k))).alias("_bin")) for k in used or [0]])
    placed = points.withColumn("_look", F.explode(looks)).select(*points.columns, "_look.*")
    met = placed.join(cut, [*keys, "_level", "_bin"])
    more = [c for c in intervals.columns if c not in keys]
    return met.where(F.col(at).between(F.col(start), F.col(end))).select(*points.columns, *more)


def phases(cells: DataFrame, intervals: DataFrame, window_ms: int) -> DataFrame:
    """Add ``phase`` to rows with case_id and timestamp_window_ms, for any number of injections a case.

    ``intervals`` has (case_id, start_ms, end_ms), which may overlap. A window whose start lies in one is
    ``inject``, one before all of them ``baseline``, any other ``recover``; a case without is ``normal``.
    """
    whole = stage(merged(intervals, ["case_id"], "start_ms", "end_ms"), "injections")
    windows = cells.select("case_id", "timestamp_window_ms").distinct()
    hit = inside(windows, whole, ["case_id"], "timestamp_window_ms", "start_ms", "end_ms", window_ms)
    hit = hit.select("case_id", "timestamp_window_ms", F.lit(True).alias("_hit"))
    first = stage(whole.groupBy("case_id").agg(F.min("start_ms").alias("_first")), "first-injections")
    phase = (
        F.when(F.col("_first").isNull(), "normal")
        .when(F.col("_hit"), "inject")
        .when(F.col("timestamp_window_ms") < F.col("_first"), "baseline")
        .otherwise("recover")
    )
    found = cells.join(first, "case_id", "left").join(hit, ["case_id", "timestamp_window_ms"], "left")
    return found.withColumn("phase", phase).select(*cells.columns, "phase")


def samples_inside(samples: DataFrame, intervals: DataFrame, bin_s: float) -> DataFrame:
    """The samples (case_id, timestamp in seconds) that lie in any interval (case_id, start_ms, end_ms) of their case."""
    whole = merged(intervals, ["case_id"], "start_ms", "end_ms")
    seconds = whole.select("case_id", *((F.col(c) / F.lit(1000.0)).alias(f"_{c}") for c in ("start_ms", "end_ms")))
    return inside(samples, seconds, ["case_id"], "timestamp", "_start_ms", "_end_ms", bin_s).select(*samples.columns)
