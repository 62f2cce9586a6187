"""Session settings and written intermediate tables."""

from __future__ import annotations

import atexit
import logging
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOG = logging.getLogger(__name__)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Python workers get small batches, whatever the length of a text.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build(app: str, master: str | None = None, partitions: str | None = None) -> SparkSession:
    """A session with the settings above; ``partitions`` is for small local runs."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    # Call-site capture costs a stack walk per column expression.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    # The default of 100 compiled stages is fewer than a few of these queries need.
    builder = builder.config("spark.sql.codegen.cache.maxEntries", "2000")
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "8g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the operators count on (UTC, AQE with skew-join splitting)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str | None:
    """Folder for written intermediates: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster without the
    setting there is none.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="windowguard-")
        context.setCheckpointDir(named)
    return named


_STAGED: list[tuple[SparkSession, str]] = []
#: Of each thread: the tables that the innermost ``stage_alone`` has seen written.
_SEEN = threading.local()
#: Spark deletes the shuffle files of a statement when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "spark.sql.parquet.compression.codec"


def _delete(spark: SparkSession, path: str) -> bool:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except (AttributeError, ConnectionError, Py4JError, Py4JNetworkError):
        return False  # the session has ended, and its JVM with it
    return True


def remove_staged() -> None:
    """Delete all tables that ``stage`` has written; frames that read them are no longer usable.

    Called when the driver's process ends; a long-lived one may call it between flows.
    """
    while _STAGED:
        if not _delete(*_STAGED.pop()):
            return


atexit.register(remove_staged)


def scratch(spark: SparkSession, name: str) -> str | None:
    """A new path in the shared folder that ``remove_staged`` deletes; none without such a folder."""
    folder = shared_dir(spark)
    if folder is None:
        return None
    _STAGED.append((spark, f"{folder}/{name}-{uuid.uuid4().hex}"))
    return _STAGED[-1][1]


def stage(df: DataFrame, name: str, schema: T.StructType | None = None, more: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, with another ``schema`` if one is given.

    Frames ``more`` of the same columns are written into the same table, one after the other.

    The read-back table has a known size, so the planner broadcasts it only when it is small,
    and a lost executor costs a re-read and no recomputation. Without a shared folder the
    frame stays lazy, and says so: what reads it twice then scans its inputs twice.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if folder is None and schema is not None:
        raise ValueError("spark.checkpoint.dir names no shared folder, which a change of schema needs")
    if folder is None:
        LOG.warning("spark.checkpoint.dir names no shared folder: %s is recomputed by every reader", name)
        return reduce(DataFrame.unionByName, more, df)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for other in more:
        other.write.mode("append").parquet(path)
    _STAGED.append((spark, path))
    getattr(_SEEN, "tables", []).append(_STAGED[-1])
    return spark.read.schema(schema or df.schema).parquet(path)


def stage_alone(build: Callable[[], DataFrame | list[DataFrame]], name: str, compression: str | None = None) -> DataFrame:
    """``stage`` of the frame that ``build`` makes, for flows that must hold little on disk at a time.

    Tables staged by ``build`` are deleted when the result is written, so nothing else may read them. Shuffle
    files go with each statement: what it wrote is in the shared folder, and nothing reads them again. Several
    frames from ``build`` are one table, written a frame at a time.
    """
    spark = SparkSession.active()
    outer, before = getattr(_SEEN, "tables", []), {k: spark.conf.get(k) for k in (CLEANUP, CODEC)}
    _SEEN.tables = []
    spark.conf.set(CLEANUP, "true")
    try:
        built = build()
        frame, *more = built if isinstance(built, list) else [built]
        spark.conf.set(CODEC, compression or before[CODEC])
        result = stage(frame, name, more=tuple(more))
        # Without a shared folder nothing was written.
        for table in _SEEN.tables[:-1]:
            _delete(*table)
            _STAGED.remove(table)
        del _SEEN.tables[:-1]
        return result
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        outer.extend(_SEEN.tables)
        _SEEN.tables = outer
