"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowguard.functions import scalars as S
from windowguard.operators import quality
from windowguard.schemas import ContractConfig

CONTRACT_ORDER = ["case_id", "endpoint_key", "timestamp_window_ms"]


def ordered_contract(df: DataFrame) -> DataFrame:
    """The wide table in total order over its partitions.

    Range partitioning by the full order splits a large case over many tasks.
    """
    return df.repartitionByRange(*CONTRACT_ORDER).sortWithinPartitions(*CONTRACT_ORDER)


def write_contract(df: DataFrame, path: str) -> None:
    """The wide table in total order, one folder per case."""
    ordered_contract(df).write.mode("overwrite").partitionBy("case_id").parquet(path)


def replace_folder(spark: SparkSession, made: str, path: str) -> None:
    """Put the folder ``made`` in the place of ``path``, in the same store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(made), hadoop.Path(path)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(target, True)
    store.mkdirs(target.getParent())
    if not store.rename(source, target):
        raise OSError(f"{made} cannot be renamed to {path}")


def write_contract_checked(df: DataFrame, path: str, config: ContractConfig | None = None) -> None:
    """``write_contract`` with the rules of the table counted by the write itself.

    The rows of one sample_id are neighbours in the order written, so repeats cost no exchange. The
    table is written aside and takes its place only if no rule is broken; otherwise it is removed and
    the error names the rules.
    """
    spark = df.sparkSession
    watched = quality.watched_contract(ordered_contract(df), CONTRACT_ORDER, config)
    aside = f"{path}-{uuid.uuid4().hex}"
    watched.df.write.partitionBy("case_id").parquet(aside)
    _settle(spark, watched, aside, path, "contract")


def write_scores_checked(df: DataFrame, path: str) -> None:
    """``write_scores`` with the rules of the table counted by the write itself, likewise."""
    watched = quality.watched_scores(df)
    aside = f"{path}-{uuid.uuid4().hex}"
    watched.df.write.parquet(aside)
    _settle(df.sparkSession, watched, aside, path, "scores")


def _settle(spark: SparkSession, watched: quality.Watched, aside: str, path: str, table: str) -> None:
    try:
        watched.require_valid(table)
    except quality.ContractError:
        hadoop = spark._jvm.org.apache.hadoop.fs
        target = hadoop.Path(aside)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        raise
    replace_folder(spark, aside, path)


def read_contract(spark: SparkSession, path: str, train_only: bool = False) -> DataFrame:
    """The wide table, or only its Normal rows (the training table)."""
    df = spark.read.option("basePath", path).parquet(path).withColumn("case_id", F.col("case_id").cast("string"))
    return df.where(S.is_normal(F.col("anomaly_type"))) if train_only else df


def stored_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table with ``position``, their place from 0 in its files, by case.

    Files follow each other by name, rows by their place in the file. Rows are counted per file, and
    only the counts are added up, so a large case stays spread over its files.
    """
    rows = read_contract(spark, path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    sizes = rows.groupBy("case_id", "_file").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("case_id").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("case_id", "_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(before, ["case_id", "_file"])
    return placed.withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def materialize(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write filtered samples range-partitioned by ``order`` (case and time) and read them back.

    ``path`` has to name everything the filter depends on (case and window bounds); an existing
    table is overwritten, never trusted.
    """
    df.repartitionByRange(*order).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metrics_document(
    metrics: DataFrame, score_stats: DataFrame | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """One row ``value`` with the metrics as JSON: the overall fields plus a map per stratum.

    The one-row tables ``score_stats`` and ``labels`` are added where given. An undefined metric
    is null in the document, never NaN.
    """

    def number(name: str):
        return F.when(~F.isnan(name), F.col(name)).alias(name)

    clean = metrics.select(
        "protocol_version", "higher_is_more_anomalous", "stratum", "key", "n_samples",
        "has_labels", number("auroc"), number("auprc"),
    )
    overall = F.col("stratum") == "overall"

    def of(name: str):
        return F.max(F.when(overall, F.col(name))).alias(name)

    entry = F.struct("key", F.struct("auroc", "n_samples"))

    def strata(name: str):
        hits = F.array_sort(F.collect_list(F.when(F.col("stratum") == name, entry)))
        return F.map_from_entries(hits).alias(name)

    document = clean.agg(
        F.struct(
            F.max("protocol_version").alias("protocol_version"),
            F.max("higher_is_more_anomalous").alias("higher_is_more_anomalous"),
            of("n_samples"),
            of("has_labels"),
            of("auroc"),
            of("auprc"),
            F.struct(
                F.struct(of("auroc")).alias("overall"),
                strata("by_anomaly_type"),
                strata("by_anomaly_level"),
            ).alias("stratified"),
        ).alias("doc")
    )
    extras = {"score_stats": score_stats, "label_distribution": labels}
    for name, table in extras.items():
        if table is not None:
            row = table.select(F.struct("*")).scalar()
            document = document.withColumn("doc", F.col("doc").withField(name, row))
    return document.select(F.to_json("doc", {"ignoreNullFields": "false"}).alias("value"))


def write_metrics(
    metrics: DataFrame,
    path: str,
    score_stats: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> None:
    document = metrics_document(metrics, score_stats, labels)
    document.coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_text_files(df: DataFrame, folder: str, name: str, suffix: str, numbered: bool = True) -> None:
    """A text column as files ``<name>-<n><suffix>`` of a folder, or one file ``<name><suffix>``.

    Readers that go by file names need them; the part files are written aside and renamed in the
    same store.
    """
    spark = df.sparkSession
    aside = f"{folder}/_parts-{uuid.uuid4().hex}"
    df.write.text(aside)
    paths = spark._jvm.org.apache.hadoop.fs
    store = paths.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(f.getPath()) for f in store.globStatus(paths.Path(f"{aside}/part-*")))
    if not numbered and len(parts) > 1:
        raise ValueError(f"{len(parts)} part files for one file name, coalesce the table first")
    for number, part in enumerate(parts):
        target = f"{folder}/{name}-{number}{suffix}" if numbered else f"{folder}/{name}{suffix}"
        store.rename(paths.Path(part), paths.Path(target))
    store.delete(paths.Path(aside), True)
