"""Profiles of files, lines and metrics, and ranked loadings."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators.series import numbered, quantiles
from windowguard.session import stage


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_size_stats(
    inventory: DataFrame,
    case_filter: str = "both",
    run_marker: str = K.RUN_FOLDER,
    ordered: bool = True,
) -> DataFrame:
    """Size statistics in KB per file name of an inventory (path, size), most frequent first.

    Only folders whose path holds ``run_marker`` count; ``case_filter`` keeps folders with
    (correct) or without (error) "correct" in their path.
    """
    if case_filter not in ("both", "correct", "error"):
        raise ValueError("case_filter must be both, correct or error")
    folder, name = _folder(F.col("path")), _name(F.col("path"))
    files = inventory.where(folder.contains(run_marker))
    if case_filter != "both":
        correct = folder.contains("correct")
        files = files.where(correct if case_filter == "correct" else ~correct)
    sizes = files.where(~name.startswith("metric_") & (name != "last_fetch_time.txt")).select(
        name.alias("name"), (F.col("size") / F.lit(1024.0)).alias("size_kb")
    )
    stats = sizes.groupBy("name").agg(
        F.count("*").alias("count"),
        F.avg("size_kb").alias("mean"),
        F.coalesce(F.stddev_samp("size_kb"), F.lit(0.0)).alias("std_dev"),
        F.min("size_kb").alias("min"),
        F.max("size_kb").alias("max"),
    )
    joined = stats.join(quantiles(sizes, ["name"], "size_kb", {"median": 0.5}), "name")
    out = joined.select("name", "count", "mean", "median", "std_dev", "min", "max")
    return out.orderBy(F.desc("count"), "name") if ordered else out


def empty_items(inventory: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Empty files and folders (kind, path, name, expected) of an inventory (path, size).

    A file is empty with 0 bytes, or as a csv of just its header. A folder is empty if no file
    at any depth below it is not; a path ending in ``/`` stands for a folder itself. Folders
    whose name starts with a dot are left out, and empty folders are never expected.
    """
    path = F.regexp_replace("path", "^/+", "")
    header_only = F.lower("path").endswith(".csv") & (F.col("size") == K.HEADER_ONLY_CSV_BYTES)
    items = inventory.select(
        path.alias("path"),
        path.endswith("/").alias("is_dir"),
        ((F.col("size") == 0) | header_only).alias("is_empty"),
    )
    files = (
        items.where(~F.col("is_dir") & F.col("is_empty"))
        .select(F.lit("file").alias("kind"), "path", _name(F.col("path")).alias("name"))
        .withColumn("expected", F.col("name").isin(K.EXPECTED_EMPTY if expected is None else expected))
    )
    parts = F.split("path", "/")
    above = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)),
        lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
    )
    folders = (
        items.select(F.explode(above).alias("path"), (F.col("is_dir") | F.col("is_empty")).alias("ok"))
        .groupBy("path")
        .agg(F.min("ok").alias("ok"))
        .where("ok")
        .select(F.lit("dir").alias("kind"), "path", _name(F.col("path")).alias("name"))
        .where(~F.col("name").startswith("."))
        .withColumn("expected", F.lit(False))
    )
    return files.unionByName(folders)


def empty_profile(inventory: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Frequency of each empty item name with its kinds."""
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), "/")
    return (
        empty_items(inventory, expected)
        .groupBy("name")
        .agg(F.count("*").alias("count"), kinds.alias("type"))
    )


def empty_breakdown(inventory: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """One row of totals over the empty items."""
    names = K.EXPECTED_EMPTY if expected is None else expected
    is_file = F.col("kind") == "file"
    csv = is_file & F.lower("name").endswith(".csv")

    def count(condition: Column, alias: str) -> Column:
        return F.count(F.when(condition, 1)).alias(alias)

    return empty_items(inventory, expected).agg(
        count(~is_file, "empty_dirs"),
        count(csv, "empty_csv_files"),
        count(is_file & ~csv, "other_empty_files"),
        count(F.col("name").isin(names), "expected_empty"),
        count(~F.col("expected"), "unexpected_empty"),
    )


def service_logs(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines (subdirectory, file_name, line) of the ``.log`` files whose name holds ``pattern``.

    Folders of metrics are skipped. Both names are columns of the file listing, so the filter is
    applied before a line is looked at.
    """
    named = F.col("file_name").contains(pattern) & F.col("file_name").endswith(".log")
    return lines.where(named & ~F.col("subdirectory").contains("metrics"))


def log_types(lines: DataFrame) -> DataFrame:
    """Type of every non-blank line, with the base file name, of rows (file_name, line)."""
    return lines.where(F.col("line").rlike(r"\S")).withColumns(
        {
            "log_type": S.line_type(F.col("line")),
            "base_filename": S.base_file_name(F.col("file_name")),
        }
    )


def log_type_counts(typed: DataFrame) -> DataFrame:
    """Counts by type, by base file name and by both; the absent key is NULL.

    The lines are counted once by both keys, the other groupings roll those counts up.
    """
    both = typed.groupBy("base_filename", "log_type").agg(F.count("*").alias("n"))
    kind, file = F.col("log_type"), F.col("base_filename")
    return (
        both.groupingSets([[kind], [file], [file, kind]], file, kind)
        .agg(F.sum("n").alias("count"))
        .select("base_filename", "log_type", "count")
    )


def distinct_names(df: DataFrame, column: str) -> list[str]:
    """The names that become columns, in order: as many as the wide table has columns."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def log_type_pivot(
    typed: DataFrame, files: list[str] | None = None, prefix: str = K.SERVICE_LOG_PREFIX
) -> DataFrame:
    """Counts of line types by base file name, 0 where absent, most frequent type first.

    Without ``files`` the distinct names are looked up first, however many there are. ``prefix``
    is cut from the column names.
    """
    files = distinct_names(typed, "base_filename") if files is None else files
    wide = typed.groupBy("log_type").pivot("base_filename", files).agg(F.count(F.lit(1)))
    names = [c for c in wide.columns if c != "log_type"]
    filled = wide.fillna(0, subset=names)
    total = sum((F.col(f"`{c}`") for c in names), F.lit(0))
    return filled.orderBy(total.desc(), "log_type").select(
        "log_type", *[F.col(f"`{c}`").alias(c.replace(prefix, "")) for c in names]
    )


def trim_lines(
    lines: DataFrame, skip: int = 100, fraction: float = 7.05, names: list[str] | None = None
) -> DataFrame:
    """Drop the first ``skip`` lines of each file; of files of a correct run keep only the first
    1/``fraction`` of the rest, rounded down.

    ``lines`` has (path, line_no from 0, line). Only the named logs outside metrics folders are
    kept. A file is never sorted, its lines are compared with a bound that is counted per file
    and staged, so that the lines are shuffled only if the bounds are too many to broadcast.
    """
    folder = _folder(F.col("path"))
    kept = lines.where(~folder.contains("metrics"))
    kept = kept.where(_name(F.col("path")).isin(K.TRIMMED_LOGS if names is None else names))
    ends = kept.groupBy("path").agg(F.count("*").alias("_lines"))
    rest = F.greatest(F.col("_lines") - skip, F.lit(0))
    cut = F.when(folder.contains("correct"), F.floor(rest / F.lit(fraction))).otherwise(rest)
    index = F.col("line_no") - skip
    ends = stage(ends.withColumn("_kept", cut).drop("_lines"), "line-counts")
    return (
        kept.join(ends, "path")
        .where((index >= 0) & (index < F.col("_kept")))
        .drop("_kept")
    )


def prom_long(results: DataFrame) -> DataFrame:
    """Range results (metric, values) of job node to (timestamp, metric_name, value) rows.

    ``position`` is the place of a value in its list. Unreadable results have no metric and are
    skipped.
    """
    kept = [c for c in results.columns if c not in ("metric", "values")]
    return (
        results.where(F.try_element_at("metric", F.lit("job")) == "node")
        .withColumn("metric_name", S.metric_label_name(F.col("metric")))
        .select(*kept, "metric_name", F.posexplode("values").alias("position", "_pair"))
        .select(
            *kept,
            "metric_name",
            "position",
            F.get("_pair", F.lit(0)).alias("timestamp"),
            F.get("_pair", F.lit(1)).alias("value"),
        )
    )


def prom_wide(
    long: DataFrame, keys: list[str], order: list[str], names: list[str] | None = None
) -> DataFrame:
    """One row per (keys, timestamp), one column per metric in name order, missing as NULL.

    Of several values for the same cell the last one by ``order`` wins. Without ``names`` every
    name of the table gets its column.
    """
    last = F.max_by("value", F.struct(*order))
    names = distinct_names(long, "metric_name") if names is None else sorted(names)
    return long.groupBy(*keys, "timestamp").pivot("metric_name", names).agg(last)


def _csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def prom_dictionary(long: DataFrame) -> DataFrame:
    """(metric_name, index): every name of the table with its place from 0 in name order."""
    return stage(numbered(long.select("metric_name").distinct(), ["metric_name"], "index"), "metric-names")


def prom_wide_lines(long: DataFrame, keys: list[str], order: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """The rows of ``prom_wide`` as CSV text: (keys, timestamp, line), for any number of series.

    A line holds the time and then one cell per name of the dictionary, empty where the time has no
    value. Rows are kept as sorted lists of the values that are there, and the commas of the missing ones
    are put between them when the text is made, so neither the plan nor a row's data grows with the names
    that a time lacks. ``prom_header`` is the line above them.
    """
    names = prom_dictionary(long) if dictionary is None else dictionary
    size = names.agg(F.count("*")).scalar()
    last = long.groupBy(*keys, "timestamp", "metric_name").agg(F.max_by("value", F.struct(*order)).alias("value"))
    cells = last.where(F.col("value").isNotNull()).join(names, "metric_name")
    listed = F.array_sort(F.collect_list(F.struct("index", _csv_cell(F.col("value")).alias("value"))))
    # A time whose values are all null is a row as well.
    times = last.groupBy(*keys, "timestamp").agg(F.lit(True).alias("_there"))
    rows = cells.groupBy(*keys, "timestamp").agg(listed.alias("_cells"))
    cell = F.col("_cells")
    before = F.concat(F.array(F.lit(-1).cast("long")), F.transform(cell, lambda c: c["index"].cast("long")))
    told = F.zip_with(cell, F.slice(before, 1, F.size(cell)), lambda c, b: F.concat(F.repeat(F.lit(","), (c["index"] - b).cast("int")), c["value"]))
    rest = size - 1 - F.element_at(before, -1)
    text = F.concat(_csv_cell(F.col("timestamp")), F.array_join(told, ""), F.repeat(F.lit(","), rest.cast("int")))
    nothing = F.concat(_csv_cell(F.col("timestamp")), F.repeat(F.lit(","), size.cast("int")))
    whole = times.join(rows, [*keys, "timestamp"], "left")
    return whole.select(*keys, "timestamp", F.when(cell.isNull(), nothing).otherwise(text).alias("line"))


def prom_header(dictionary: DataFrame) -> DataFrame:
    """The header ``line`` of the text rows, one row as long as the names are."""
    names = F.array_sort(F.collect_list(F.struct("index", _csv_cell(F.col("metric_name")).alias("name"))))
    joined = F.array_join(F.transform(names, lambda n: n["name"]), ",")
    return dictionary.agg(F.concat(F.lit("timestamp,"), joined).alias("line"))


def fit_pca(df: DataFrame, vector: str, names: list[str], k: int | None = None):
    """Loadings (component, feature, loading) and variance (component, ratio, cumulative).

    Centred, not scaled. Only the component matrix (features by components) reaches the driver.
    """
    spark = df.sparkSession
    k = k or len(names)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(
        df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    )
    matrix = model.pc.toArray()
    loadings = [(c, names[f], float(matrix[f, c])) for c in range(k) for f in range(len(names))]
    ratios = [float(r) for r in model.explainedVariance]
    variance = [(c, r, t) for c, (r, t) in enumerate(zip(ratios, accumulate(ratios)))]
    return (
        spark.createDataFrame(loadings, "component int, feature string, loading double"),
        spark.createDataFrame(variance, "component int, ratio double, cumulative double"),
    )


def pca_by_subset(df: DataFrame, vector: str, names: list[str], subsets: dict[str, Column]) -> DataFrame:
    """Explained variance (subset, component, ratio, cumulative) of each named subset of the rows."""
    parts = [
        fit_pca(df.where(rows), vector, names)[1].select(F.lit(subset).alias("subset"), "*")
        for subset, rows in subsets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def top_loadings(components: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` features with the largest absolute loading of each of the first ``n`` components."""
    size = F.abs("loading")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(size.desc(), "feature"))
    return (
        components.where(F.col("component") < n).withColumn("rank", rank).where(F.col("rank") <= k)
    )


def selected_features(components: DataFrame, n: int, k: int) -> DataFrame:
    """Distinct features among the top loadings, in name order."""
    return top_loadings(components, n, k).select("feature").distinct().orderBy("feature")


def positional_split(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Mark the first ``n`` rows by a unique ``order`` as head, the others as tail.

    The last head row is found with a top-n, the other rows are only compared with it.
    """
    place = F.struct(*order)
    last = df.select(*order).orderBy(*order).limit(n).agg(F.max(place)).scalar()
    return df.withColumn("part", F.when(place <= last, "head").otherwise("tail"))


def merge_sorted(frames: list[DataFrame], by: str, numeric: bool = False) -> DataFrame:
    """All rows of tables with the same columns, sorted by ``by``.

    The order is by text, as in the merged files, unless ``numeric``. The other columns and a
    row number break ties, so that a frequent value or row is spread over tasks.
    """
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    first = F.col(by).cast("double") if numeric else F.col(by)
    others = [c for c in merged.columns if c != by]
    numbered = merged.withColumn("_row", F.monotonically_increasing_id())
    return numbered.orderBy(first, *others, "_row").drop("_row")
