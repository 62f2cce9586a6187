"""Large JSON documents that hold an array of records, read by many tasks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowguard.session import shared_dir, stage
from windowguard.sources import headers

#: Files up to this size are read by one task each.
SPLIT_BYTES = 128 << 20

# An array whose first element is an object, up to the colon behind the first key.
_OPENING = re.compile('\ufeff?' r'\s*\[\s*(\{\s*"(?:[^"\\]|\\.)*"\s*:)')
_STRING = r'"(?:[^"\\]|\\.)*+"'
_BROKEN = "_broken_record"


def _whole(spark: SparkSession, files: dict[str, str], schema: T.StructType, patterns: str | list[str] | None = None) -> DataFrame:
    """The records of files (decoded by encoded path), each read by one task; ``patterns``, if given, are paths of the same files."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
    rows = reader.json(patterns or [headers.literal_path(p) for p in files.values()])
    rows = rows.select(*schema.names, F.col("_metadata.file_path").alias(headers.FILE))
    return rows.join(headers.file_table(spark, files, [F.col("path")]), headers.FILE).drop(headers.FILE)


def _balance(text: Column) -> Column:
    """How many more objects a text opens than it closes, strings left aside."""
    bare = F.regexp_replace(text, _STRING, "")
    return (F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))).cast("long")


def fragments(spark: SparkSession, paths: list[str], opening: str) -> DataFrame:
    """(path, block, place, text, balance): the files cut before each ``opening``, which begins a text again.

    The cuts are made by the line reader, so a file is read in as many splits as it has. A key's quotes
    are escaped inside a string, so no cut lies in one; one inside a record shows in its balance. The
    piece before the first record is left out.
    """
    raw = spark.read.option("lineSep", opening).text([headers.literal_path(p) for p in paths])
    placed = raw.select(
        headers.decoded_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.concat(F.lit(opening), "value").alias("text"),
    )
    pieces = stage(placed.withColumn("balance", _balance(F.col("text"))), "json-pieces")
    first = pieces.where(F.col("block") == 0).groupBy("path").agg(F.min("place").alias("_first"))
    return pieces.join(first, "path").where((F.col("block") > 0) | (F.col("place") > F.col("_first"))).drop("_first")


def _starts(pieces: DataFrame) -> DataFrame:
    """(path, block, place, balance, start): the place at which the record of each piece begins.

    A piece begins a record if all before it are closed. Balances are summed within a block, and the
    sums of blocks along the file; texts do not move.
    """
    numbers = pieces.select("path", "block", "place", "balance")
    inside = Window.partitionBy("path", "block").orderBy("place")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbers.groupBy("path", "block").agg(F.sum("balance").alias("_sum"))
    sums = sums.select("path", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_open"))
    within = F.coalesce(F.sum("balance").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = F.when(F.col("_open") + within == 0, F.col("place"))
    placed = stage(numbers.join(sums, ["path", "block"]).withColumn("_begun", begun), "json-depths")
    last = placed.groupBy("path", "block").agg(F.max_by("_begun", F.when(F.col("_begun").isNotNull(), F.col("place"))).alias("_last"))
    carried = last.select("path", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    start = F.coalesce(F.last("_begun", ignorenulls=True).over(inside), "_carried")
    return placed.join(carried, ["path", "block"]).withColumn("start", start).select("path", "block", "place", "balance", "start")


def records(pieces: DataFrame) -> DataFrame:
    """(path, block, place, text) of every record, at its first piece; cut records are joined again."""
    if pieces.where(F.col("balance") != 0).isEmpty():
        return pieces.drop("balance")
    starts = _starts(pieces)
    held = pieces.drop("balance").join(starts.drop("balance"), ["path", "block", "place"])
    parts = starts.groupBy("path", "start").agg(F.count("*").alias("_parts"))
    held = held.join(parts, ["path", "start"])
    single = held.where(F.col("_parts") == 1).select("path", "block", "place", "text")
    ordered = F.array_sort(F.collect_list(F.struct("block", "place", "text")))
    joined = (
        held.where(F.col("_parts") > 1)
        .groupBy("path", "start")
        .agg(ordered.alias("_pieces"))
        .select(
            "path",
            F.col("_pieces")[0]["block"].alias("block"),
            F.col("start").alias("place"),
            F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("text"),
        )
    )
    return single.unionByName(joined)


def _split(spark: SparkSession, paths: list[str], opening: str, schema: T.StructType) -> DataFrame:
    rows = records(fragments(spark, paths, opening))
    end = F.substring_index("text", "}", -1)
    body = F.substring("text", F.lit(1), F.length("text") - F.length(end))
    wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    parsed = F.from_json("_body", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    # A value of another type leaves a record readable.
    valid = F.when(F.col(f"_row.{_BROKEN}").isNull(), F.col("_row").isNotNull()).otherwise(F.try_parse_json("_body").isNotNull())
    sign = F.btrim(end, F.lit(" \t\r\n"))
    rows = rows.select("path", "block", "place", sign.alias("_sign"), body.alias("_body")).withColumn("_row", parsed)
    rows = stage(rows.select("path", "block", "place", "_sign", valid.alias("_valid"), F.col("_row").dropFields(_BROKEN).alias("_row")), "json-records")
    at = F.struct("block", "place")
    closed = F.when(F.col("_sign") == "]", at)
    files = rows.groupBy("path").agg(
        (F.bool_and(F.coalesce("_valid", F.lit(False)) & F.col("_sign").isin(",", "]")) & (F.count(closed) == 1) & (F.max(closed) == F.max(at))).alias("_whole")
    )
    whole = stage(files.where("_whole").select("path"), "json-files")
    return rows.join(whole, "path").select("_row.*", "path")


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: T.StructType, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of JSON documents, with the ``path`` of their file.

    A document is an object or an array of objects. Files of more than ``split_bytes`` that hold an
    array are cut at the text that opens a record, up to the colon of its first key, and read in as
    many splits as they have; records cut in the middle are joined again. A large file that is no
    readable array to its end gives no rows; a small one gives at most rows without values.
    """
    named = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("name"), headers.decoded_path().alias("path"), "length")
    listed = named.collect()  # names and sizes
    names_of = {r["path"]: r["name"] for r in listed}
    small = [r["path"] for r in listed if r["length"] <= split_bytes]
    large = [r["path"] for r in listed if r["length"] > split_bytes]
    groups: dict[str, list[str]] = {}
    if large and shared_dir(spark) is not None:
        names = [headers.literal_path(p) for p in large]
        for path, begin in headers.beginnings(spark, names).items():
            found = _OPENING.match(begin)
            if found:
                groups.setdefault(found[1], []).append(path)
            else:
                small.append(path)
    else:
        small += large
    # A list of names is looked up file by file; the paths as given say the same where no file is cut.
    whole = {names_of[p]: p for p in small}
    frames = [_whole(spark, whole, schema, None if groups else paths)] if small else []
    frames += [_split(spark, members, opening, schema) for opening, members in sorted(groups.items())]
    if not frames:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("path", T.StringType())]))
    return reduce(DataFrame.unionAll, frames)
