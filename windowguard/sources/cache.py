"""A cache of filtered metric samples that reads only files which are new or have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.operators import metrics
from windowguard.session import stage
from windowguard.sources import files, headers

DATA, MANIFEST = "data", "manifest"


def inventory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, modified, case_id) of the files of a read; no file is opened."""
    found = spark.read.format("binaryFile").load(paths).select("path", "length", F.unix_micros("modificationTime").alias("modified"))
    return found.withColumn("case_id", F.regexp_extract("path", "([^/]+)/metric_data/", 1))


def read_manifest(spark: SparkSession, cache: str) -> DataFrame | None:
    """The files of the last run, with the version and the run in which each was filtered."""
    if not files.any_file(spark, f"{cache}/{MANIFEST}/run=*/_SUCCESS"):
        return None
    store = spark._jvm.org.apache.hadoop.fs.Path(cache).getFileSystem(spark._jsc.hadoopConfiguration())
    done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/{MANIFEST}/run=*/_SUCCESS"))
    last = max(int(f.getPath().getParent().getName().removeprefix("run=")) for f in done)
    return spark.read.parquet(f"{cache}/{MANIFEST}/run={last}").withColumn("last_run", F.lit(last))


def refresh(
    spark: SparkSession, paths: str | list[str], bounds: DataFrame, cache: str, names: list[str] | None = None
) -> DataFrame:
    """Bring the cache up to date with the files and bounds; returns the manifest of this run.

    A file's version is a digest of its path, size, time, of the bounds of its case and of the metric
    names, so whatever the filter depends on makes a new one. Versions that the last manifest lists are
    left alone; the others are read, filtered and written as one partition each, which replaces what a
    run that failed half-way may have left there. The manifest is written last, so a reader sees the
    run as a whole or not at all. Files of cases without bounds are left out, files that are gone drop out.
    The manifest is (path, case_id, version, run): ``run`` is the one that filtered the file, from 1.
    """
    wanted = names or K.POD_METRICS + K.HOST_METRICS
    seen = inventory(spark, paths).join(bounds.select("case_id", "start_ms", "end_ms"), "case_id")
    parts = ["path", "length", "modified", "start_ms", "end_ms"]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts], *map(F.lit, sorted(wanted))))
    now = stage(seen.select("path", "case_id", digest.alias("version")), "cache-files")
    before = read_manifest(spark, cache)
    if before is None:
        run, known = 1, now.limit(0).withColumn("run", F.lit(0))
    else:
        run = (before.agg(F.max("last_run")).first()[0] or 0) + 1
        known = before.select("path", "case_id", "version", "run")
    kept = now.join(known.select("version", "run"), "version", "left")
    manifest = stage(kept.select("path", "case_id", "version", F.coalesce("run", F.lit(run)).alias("run")), "cache-manifest")
    fresh = manifest.where(F.col("run") == run)
    stale = [headers.literal_path(r[0]) for r in fresh.select("path").collect()]  # as many as new files
    if stale:
        samples = files.read_metric_samples(spark, stale, labels=[], source="_source")
        versions = fresh.select(F.col("path").alias("_source"), "version")
        kept_rows = metrics.filter_samples(samples.join(versions, "_source"), bounds, wanted, keep=["version"])
        kept_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{cache}/{DATA}")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{cache}/{MANIFEST}/run={run}")
    return manifest


def read_samples(spark: SparkSession, cache: str) -> DataFrame:
    """The samples of the files in the last manifest; partitions of older versions are not read."""
    manifest = read_manifest(spark, cache)
    if manifest is None:
        raise FileNotFoundError(f"{cache} has no manifest")
    schema = f"{', '.join(f'{c} {t}' for c, t in COLUMNS.items())}, version string"
    if files.any_file(spark, f"{cache}/{DATA}/version=*"):
        data = spark.read.schema(schema).parquet(f"{cache}/{DATA}")
    else:
        data = spark.createDataFrame([], schema)
    return data.join(manifest.select("version"), "version", "left_semi").drop("version")


COLUMNS = {
    "case_id": "string",
    "metric_file": "string",
    "metric_name": "string",
    "timestamp": "double",
    "value": "double",
    "pod": "string",
    "interface": "string",
}


def drop_old_versions(spark: SparkSession, cache: str) -> int:
    """Delete the partitions that the last manifest does not list; returns how many there were."""
    manifest = read_manifest(spark, cache)
    current = {r[0] for r in manifest.select("version").collect()} if manifest is not None else set()
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(cache).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in store.globStatus(hadoop.Path(f"{cache}/{DATA}/version=*")) or []:
        if status.getPath().getName().removeprefix("version=") not in current:
            store.delete(status.getPath(), True)
            gone += 1
    return gone
