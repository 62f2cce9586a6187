"""Ranks, quantiles, previous rows and sequences that hold for groups of any size.

A group may hold a third of all rows, so nothing here sorts a whole group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.session import stage

HEAVY_ROWS = 1_000_000
#: Ranges of about a quarter of a heavy group's least size, at least two. More than 2 ** RANGE_BITS
#: are not told apart, which at 10 ** 12 rows leaves some 10 ** 7 rows a range.
RANGES_PER_HEAVY = 4
RANGE_BITS = 17
CUT_ROWS = 1_000_000
CHUNK_WINDOWS = 65_536


def prefix_sums(
    df: DataFrame, keys: list[str], order: str, weights: list[str], heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Add ``<w>_before`` (sum over smaller ``order`` in the group) and ``<w>_total`` per weight.

    ``df`` has one row per (keys, order), a numeric ``order`` and otherwise numeric columns
    without NULL; groups with a NULL key are left out, as in a pandas group-by. A group with at
    least ``heavy_rows`` rows is split into value ranges: the ranges are summed first, then each
    range is ranked by itself and shifted by the sum of the ranges below it. Every row is ranked;
    only the cut points come from about ``CUT_ROWS`` rows picked by hash, because they merely
    balance the load and any others would give the same result. There are as many ranges as the
    rows call for, and every heavy group is split, however many there are. A light group is one
    range and needs no shift.

    All branches read the same columns of ``df`` (hence ``every``), so its exchange is reused.
    """
    df = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df)
    numbers = [F.col(c) for c in df.columns if c not in {*keys, order}]
    every = reduce(lambda a, b: a + b, numbers) >= 0
    sizes = df.groupBy(*keys).agg(F.count(F.when(every, 1)).alias("_rows"))
    if keys:
        heavy = sizes.where(F.col("_rows") >= heavy_rows).select(*keys, F.lit(True).alias("_heavy"))
        split = df.join(heavy, keys, "left")
    else:
        split = df.withColumn("_heavy", sizes.scalar() >= heavy_rows)

    rows = df.agg(F.count(F.when(every, 1))).scalar()
    draw = F.abs(F.xxhash64(*keys, order) / F.lit(2.0**63))
    picked = every & (draw <= F.lit(CUT_ROWS) / rows)
    wanted = F.ceil(F.col("_all") * RANGES_PER_HEAVY / F.lit(float(heavy_rows)))
    n_ranges = F.least(F.greatest(wanted, F.lit(2)), F.lit(2**RANGE_BITS)).cast("int")
    places = F.sequence(F.lit(1), F.col("_ranges") - 1)
    cuts = (
        df.select(F.when(picked, F.col(order)).alias("_x"), F.when(every, 1).alias("_one"))
        .agg(F.array_sort(F.collect_list("_x")).alias("_xs"), F.count("_one").alias("_all"))
        .withColumn("_ranges", n_ranges)
        .select(
            F.transform(
                places, lambda i: F.get("_xs", F.floor(i * F.size("_xs") / F.col("_ranges")).cast("int"))
            ).alias("_cuts")
        )
    )
    # Binary search for the number of cut points <= order.
    place = F.aggregate(
        F.array(*[F.lit(2**bit) for bit in reversed(range(RANGE_BITS))]),
        F.lit(0),
        lambda low, step: low
        + F.when(F.get("_cuts", low + step - 1) <= F.col(order), step).otherwise(0),
    )
    split = split.withColumn("_cuts", cuts.scalar()).select(
        *df.columns, "_heavy", F.when(F.col("_heavy"), place).otherwise(0).alias("_range")
    )

    per_range = split.where("_heavy").groupBy(*keys, "_range").agg(
        *[F.sum(F.when(every, F.col(w))).alias(w) for w in weights]
    )
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_range.select(
        *keys,
        "_range",
        *[F.sum(w).over(lower).alias(f"_{w}_shift") for w in weights],
        *[F.sum(w).over(group).alias(f"_{w}_total") for w in weights],
    )
    one_range = Window.partitionBy(*keys, "_range")
    inside = one_range.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = split.select(
        "*",
        *[F.sum(w).over(inside).alias(f"_{w}_inside") for w in weights],
        *[F.sum(w).over(one_range).alias(f"_{w}_range") for w in weights],
    ).join(shifts, [*keys, "_range"], "left")
    nothing = F.lit(0)
    return ranked.select(
        *df.columns,
        *[
            (F.coalesce(f"_{w}_shift", nothing) + F.coalesce(f"_{w}_inside", nothing)).alias(f"{w}_before")
            for w in weights
        ],
        *[F.coalesce(f"_{w}_total", f"_{w}_range").alias(f"{w}_total") for w in weights],
    )


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add the place of each row, from 0, in the order of ``order``; rows that tie follow in any order.

    Rows are ordered in range partitions that are written once, counted, and numbered by themselves;
    only the counts, one per partition, meet in one task. A frequent value is spread by a tie breaker.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = stage(tied.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie")) - 1
    placed = ordered.withColumn("_inside", inside).join(stage(offsets, "offsets"), "_part")
    return placed.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def quantile_of(value: str, weight: str, q: float) -> Column:
    """Aggregate: linear-interpolation quantile over rows ranked by ``prefix_sums``."""
    total, before = F.col(f"{weight}_total"), F.col(f"{weight}_before")
    position = (total - 1) * F.lit(float(q))

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < before + F.col(weight)), F.col(value)))

    low, high = at(F.floor(position)), at(F.ceil(position))
    return low + (high - low) * F.max(position - F.floor(position))


def quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``; NULL values are skipped."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = prefix_sums(counts, keys, value, ["_n"], heavy_rows)
    return ranked.groupBy(*keys).agg(
        *[quantile_of(value, "_n", q).alias(name) for name, q in probs.items()]
    )


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    window_ms: int,
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """Add ``previous_<c>``: the value of ``c`` in the row before, per series ordered by ``order``.

    ``df`` has one row per (keys, order) on a grid of ``window_ms``. A series is worked on in
    chunks of at most ``chunk_windows`` rows; the last row of each chunk is carried to the next.
    """
    row = F.struct(*columns)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(window_ms * chunk_windows)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    lasts = chunked.groupBy(*keys, "_chunk").agg(F.max_by(row, F.col(order)).alias("_last"))
    carried = lasts.select(
        *keys,
        "_chunk",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"),
    )
    joined = chunked.withColumn("_inside", F.lag(row).over(inside)).join(carried, [*keys, "_chunk"])
    previous = F.coalesce("_inside", "_carried")
    return joined.select(*df.columns, *[previous[c].alias(f"previous_{c}") for c in columns])


def row_index(
    df: DataFrame, keys: list[str], order: str, window_ms: int, chunk_windows: int = CHUNK_WINDOWS
) -> DataFrame:
    """Add ``row_index``, the position from 0 within each series, ranking chunk by chunk."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(window_ms * chunk_windows)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows"))
    below = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_offset")
    )
    joined = chunked.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = joined.join(offsets, [*keys, "_chunk"])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias("row_index"))


def sequences(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    length: int,
    window_ms: int,
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """Every run of ``length`` consecutive rows per series, stride 1, as ``steps`` structs.

    Each chunk of rows also gets the first ``length - 1`` rows of the next one, so that runs
    across a chunk border are whole while no task holds more than a chunk.
    """
    if length < 1:
        raise ValueError(f"sequence length must be >= 1, got {length}")
    chunk_rows = max(chunk_windows, length)
    indexed = row_index(df, keys, order, window_ms, chunk_windows)
    own = F.floor(F.col("row_index") / F.lit(chunk_rows))
    lent = (F.col("row_index") % chunk_rows < length - 1) & (own > 0)
    chunks = F.when(lent, F.array(own, own - 1)).otherwise(F.array(own))
    copies = indexed.withColumn("_own", own).withColumn("_chunk", F.explode(chunks))
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("row_index").rowsBetween(0, length - 1)
    )
    runs = copies.withColumn("steps", F.collect_list(F.struct(order, *columns)).over(frame))
    return runs.where((F.size("steps") == length) & (F.col("_own") == F.col("_chunk"))).select(
        *keys, F.col(order).alias(f"first_{order}"), "steps"
    )


def fill_windows(
    df: DataFrame,
    keys: list[str],
    order: str,
    window_ms: int,
    zero_columns: list[str],
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """Add the missing windows between each group's first and last one, with 0 in ``zero_columns``.

    The grid is spread chunk by chunk, so that no single row expands into a whole time span.
    """
    chunk_ms = window_ms * chunk_windows
    spans = df.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    starts = F.sequence(F.col("_low"), F.col("_high"), F.lit(chunk_ms).cast("long"))
    parts = spans.withColumn("_start", F.explode(starts))
    end = F.least(F.col("_high"), F.col("_start") + F.lit(chunk_ms - window_ms))
    grid = parts.select(
        *keys, F.explode(F.sequence("_start", end, F.lit(window_ms).cast("long"))).alias(order)
    )
    return grid.join(df, [*keys, order], "left").fillna(0, subset=zero_columns)
