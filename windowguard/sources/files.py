"""Readers of raw case folders and profile inputs.

A case is a folder under the data root; its name becomes the ``case_id`` column, so that one
read covers all cases.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowguard import schemas
from windowguard.functions import scalars as S
from windowguard.session import stage
from windowguard.sources import headers, json_arrays

LOG = logging.getLogger(__name__)

# Columns that every metric file has, and those that hold numbers.
METRIC_COLUMNS = ["metric_name", "timestamp", "value", "pod", "interface"]
NUMBERS = ("timestamp", "value")

TRACE_RED_FILE = "tt_traces_red_15s.csv"
CLIENT_RED_FILE = "tt_endpoint_health_15s.csv"


def _path() -> Column:
    """Decoded path of the file a row comes from."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def _part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def _before(path: Column, folder: str) -> Column:
    """The name of the folder that holds ``folder``.

    What stands below may be a file, or a folder of part files under the file's name.
    """
    return F.regexp_extract(path, f"([^/]+)/{folder}/", 1)


def _nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_trace_red(spark: SparkSession, root: str) -> DataFrame:
    """Windowed server RED tables of all cases; the window is epoch ms."""
    raw = spark.read.schema(schemas.TRACE_RED).csv(f"{root}/*/_pipeline_out/{TRACE_RED_FILE}", header=True)
    named = raw.withColumn("case_id", _before(_path(), "_pipeline_out"))
    return _nan_to_null(named.withColumnRenamed("timestamp_window", "timestamp_window_ms"))


def read_client_red(spark: SparkSession, root: str) -> DataFrame:
    """Windowed client RED tables of all cases; the ISO window becomes epoch ms."""
    raw = spark.read.schema(schemas.CLIENT_RED).csv(f"{root}/*/_pipeline_out/{CLIENT_RED_FILE}", header=True)
    named = raw.withColumn("case_id", _before(_path(), "_pipeline_out")).withColumn(
        "timestamp_window_ms", S.iso_to_ms(F.col("timestamp_window"))
    )
    return _nan_to_null(named.drop("timestamp_window"))


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a file or folder matches the pattern, in whatever store the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    return {path: headers.fields(line) for path, line in headers.first_lines(spark, paths).items()}


def _usable(columns: list[str]) -> bool:
    return set(METRIC_COLUMNS) <= set(columns)


def metric_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, columns, usable) of every metric CSV: its header, and whether it can be read by it.

    The header is the first line with any text. A file without one, or without one of the needed
    columns, is not usable. Only the beginning of each file is read.
    """
    found = [(path, columns, _usable(columns)) for path, columns in _headers(spark, paths).items()]
    return spark.createDataFrame(found, "path string, columns array<string>, usable boolean")


def read_metric_samples(
    spark: SparkSession, paths: str | list[str], labels: list[str] | None = None, source: str | None = None
) -> DataFrame:
    """Long metric CSVs: labels as text, timestamp and value as numbers.

    Each file is read by the names in its own header, so files may differ in order and in their
    labels; a label that a file lacks is NULL. Only the beginning of a file is read to learn its
    header; then there is one scan for all files with the same header, so columns that a query does
    not use are not parsed, and its conditions reach the scan. Files that cannot be used are skipped
    with a warning (``metric_headers`` lists them), so one bad file does not stop the others. Rows
    whose time is no number are left out. ``metric_file`` is the file a sample comes from. ``labels``
    are the further columns to give, all of any header by default; ``source`` names a column for the
    path of the file, if one is wanted.
    """
    # What follows from a path is worked out once a file, not once a row.
    known: dict[tuple[str, ...], list[str]] = {}
    found = _headers(spark, paths)
    for path, columns in sorted(found.items()):
        if _usable(columns):
            known.setdefault(tuple(columns), []).append(path)
    skipped = len(found) - sum(map(len, known.values()))
    if skipped:
        LOG.warning("%d metric files have no usable header and are skipped", skipped)
    # The folder gives the case, whatever the file says.
    own = {"case_id", "metric_file"} | ({source} if source else set())
    if labels is None:
        labels = sorted({n for columns in known for n in headers.distinct_names(list(columns))} - {*METRIC_COLUMNS, *own})
    names = [*METRIC_COLUMNS, *labels]

    path = F.col("path")
    places = headers.file_table(
        spark,
        {headers.encoded_path(spark, m): m for members in known.values() for m in members},
        [
            _before(path, "metric_data").alias("case_id"),
            F.regexp_extract(path, "/metric_data/([^/]+)", 1).alias("metric_file"),
            *([path.alias(source)] if source else []),
        ],
    )

    def scan(columns: list[str], members: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in headers.distinct_names(columns)])
        reader = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", False)
        raw = reader.csv([headers.literal_path(m) for m in members])

        def cell(name: str) -> Column:
            text = F.col(f"`{name}`") if name in schema.names else F.lit(None).cast("string")
            return (text.try_cast("double") if name in NUMBERS else text).alias(name)

        return raw.select(*[cell(n) for n in names], F.col("_metadata.file_path").alias(headers.FILE)).join(places, headers.FILE).drop(headers.FILE)

    if known:
        rows = reduce(DataFrame.unionAll, (scan(list(c), m) for c, m in known.items()))
    else:
        kinds = ", ".join(f"`{n}` {'double' if n in NUMBERS else 'string'}" for n in [*names, "case_id", "metric_file", *([source] if source else [])])
        rows = spark.createDataFrame([], kinds)
    return _nan_to_null(rows.where(F.col("timestamp").isNotNull()))


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """Log lines (case_id, service_name, line) of all cases.

    The pod folder gives the service: ``log_data/<pod>/*.log``, or ``log_data/<run>/<pod>/*.log``
    where no folder directly below ``log_data`` holds logs only. Bytes that are no text are
    replaced.
    """
    reader = spark.read.option("pathGlobFilter", "*.log").option("recursiveFileLookup", True)
    lines = reader.text(f"{root}/*/log_data").select(
        F.make_valid_utf8("value").alias("line"), _path().alias("_path")
    )
    tail = F.split(F.element_at(F.split("_path", "/log_data/"), -1), "/")
    case_dir = F.element_at(F.split(F.element_at(F.split("_path", "/log_data/"), -2), "/"), -1)
    placed = lines.select(
        case_dir.alias("case_id"), "line", tail[0].alias("_top"), F.size(tail).alias("_depth"),
        tail[F.size(tail) - 2].alias("_pod"),
    )
    found = reader.format("binaryFile").load(f"{root}/*/log_data").select(_path().alias("_path"))
    tops = (
        found.select(case_dir.alias("case_id"), tail[0].alias("_top"), F.size(tail).alias("_depth"))
        .groupBy("case_id", "_top")
        .agg(F.min("_depth").alias("_shallow"), F.max("_depth").alias("_deep"))
    )
    flat = tops.groupBy("case_id").agg(
        F.max((F.col("_shallow") == 2) & (F.col("_deep") == 2)).alias("_flat")
    )
    flat = stage(flat, "layout")
    wanted = F.when(F.col("_flat"), 2).otherwise(3)
    return (
        placed.join(flat, "case_id")
        .where(F.col("_depth") == wanted)
        .select("case_id", S.service_of_pod(F.col("_pod")).alias("service_name"), "line")
    )


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every case that has windowed tables.

    The document in the case folder comes first, then the one in ``trace_data``, else the case
    is a Normal run. A missing key takes its default, a key that is null stays NULL; a document that
    is there but cannot be parsed is an error that names the case. ``case_id`` is the folder,
    ``meta_case_id`` the name in the document, and ``fit_normal`` tells whether the case itself says
    it is Normal, which a document without a type does not.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    cases = (
        reader.option("pathGlobFilter", "*.csv")
        .format("binaryFile")
        .load(f"{root}/*/_pipeline_out")
        .select(_before(_path(), "_pipeline_out").alias("case_id"))
        .distinct()
    )

    documents = (
        spark.read.option("pathGlobFilter", "case_metadata.json")
        .option("recursiveFileLookup", True)
        .text(root, wholetext=True)
        .select(_path().alias("_path"), "value")
    )
    in_trace = _part(F.col("_path"), 2) == "trace_data"
    placed = documents.select(
        F.when(in_trace, _part(F.col("_path"), 3)).otherwise(_part(F.col("_path"), 2)).alias("case_id"),
        F.when(in_trace, 1).otherwise(0).alias("_place"),
        "value",
    )
    first = placed.groupBy("case_id").agg(F.min_by("value", "_place").alias("_text"))
    parsed = F.from_json("_text", "map<string,string>")
    broken = F.raise_error(F.concat(F.lit("case metadata cannot be parsed: "), "case_id"))
    whole = F.col("_text").rlike(r"(?s)^\s*\{.*\}\s*$") & parsed.isNotNull()
    first = first.withColumn("doc", F.when(whole, parsed).otherwise(broken.cast("map<string,string>")))
    doc = F.col("doc")

    def of(key: str) -> Column:
        return F.try_element_at(doc, F.lit(key))

    def with_default(key: str, default: str) -> Column:
        return F.when(F.map_contains_key(doc, key), of(key)).otherwise(default)

    return cases.join(first, "case_id", "left").select(
        "case_id",
        F.coalesce(of("case_id"), "case_id").alias("meta_case_id"),
        with_default("anomaly_type", "Normal").alias("anomaly_type"),
        with_default("anomaly_level", "none").alias("anomaly_level"),
        of("target_service").alias("target_service"),
        of("inject_start_ms").cast("long").alias("inject_start_ms"),
        of("inject_end_ms").cast("long").alias("inject_end_ms"),
        (doc.isNull() | F.coalesce(S.is_normal(of("anomaly_type")), F.lit(False))).alias("fit_normal"),
    )


def read_requests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Client request records, one JSON object per line."""
    return spark.read.schema(schemas.REQUEST).json(paths)


def read_traces(spark: SparkSession, paths: str | list[str], split_bytes: int = json_arrays.SPLIT_BYTES) -> DataFrame:
    """Nested trace documents; a large array of traces is read by many tasks."""
    return json_arrays.read_json_arrays(spark, paths, schemas.TRACE, split_bytes).drop("path")


def read_range_results(
    spark: SparkSession, paths: str | list[str], run_prefix: str = "", split_bytes: int = json_arrays.SPLIT_BYTES
) -> DataFrame:
    """Metric range results with run and test folder; unreadable files give no usable row.

    Only runs whose folder begins with ``run_prefix`` are taken. A large array is read by many tasks.
    """
    raw = json_arrays.read_json_arrays(spark, paths, schemas.RANGE_RESULT, split_bytes)
    path = F.col("path")
    return raw.select(
        _part(path, 4).alias("run_end"), _part(path, 3).alias("test_name"),
        _part(path, 1).alias("file"), "metric", "values",
    ).where(F.col("metric").isNotNull() & F.col("run_end").startswith(run_prefix))


def read_text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files with a header, every column as text."""
    return spark.read.csv(paths, header=True)


def read_line_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of log files with folder and file name (line order is not kept)."""
    path = _path()
    return spark.read.text(paths).select(
        _part(path, 2).alias("subdirectory"), _part(path, 1).alias("file_name"),
        F.make_valid_utf8("value").alias("line"),
    )
