"""Contiguous shards of nearly equal byte size by global prefix sums.

Rows are ordered by range partitions, each partition is summed, the partition sums are
accumulated, and every row then knows the bytes before it. Cutting that line at equal targets
gives contiguous shards. Only (order, size) travel; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard.session import stage

ROW_OVERHEAD = 8


def text_size(text: Column | str) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed overhead per row."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def byte_offsets(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """Add ``start`` (bytes before the row), ``row`` (rows before it) and ``total`` (all bytes).

    Order: the columns of ``order``, nulls first; rows that tie in all of them follow in an
    arbitrary but fixed sequence, which spreads even one repeated key over many partitions.
    The ordered rows are written once, so that a lost executor cannot renumber the partitions.
    """
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id())
    ordered = stage(ordered, "shard-order")
    # One row per partition, so this window is as long as the partition list.
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_parts = Window.partitionBy()
    totals = (
        ordered.groupBy("_part")
        .agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(line), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(line), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(all_parts).alias("total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.withColumns(
            {
                "_start": F.coalesce(F.sum(size).over(before), F.lit(0)),
                "_row": F.row_number().over(inside) - 1,
            }
        )
        .join(stage(totals, "shard-totals"), "_part")
        .withColumns(
            {
                "start": F.col("_start") + F.col("_bytes_before"),
                "row": (F.col("_row") + F.col("_rows_before")).cast("long"),
            }
        )
        .drop("_tie", "_part", "_start", "_row", "_bytes_before", "_rows_before")
    )


def shard_by_bytes(rows: DataFrame, shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard).

    A row belongs to the shard in which its middle byte lies, so a shard misses its target by at
    most half a row at either end. A row larger than a target leaves a neighbouring shard empty
    rather than being cut. No rows in, no rows out; null order values come first; repeated rows
    each get a slot of their own.
    """
    placed = byte_offsets(rows, order, size)
    middle = F.col("start") + F.col(size) / 2
    cut = F.floor(middle * shards / F.col("total")).cast("int")
    placed = stage(placed.withColumn("shard", F.least(cut, F.lit(shards - 1))), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    return (
        placed.join(stage(first, "shard-first"), "shard")
        .withColumn("slot", F.col("row") - F.col("_first"))
        .drop("_first", "start", "row", "total")
    )


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Shards of a document table in the order of doc_id: doc_id, size, text_crc32, shard, slot.

    A null text has size 8 and the checksum of the empty text; extra columns are left aside.
    """
    rows = docs.select(
        "doc_id",
        text_size("text").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return shard_by_bytes(rows, shards, ["doc_id", "text_crc32", "size"])
