"""Tables stored in buckets of a key, so that joins on the key need no exchange."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Buckets of a table; tables that are to be joined need the same number.
BUCKETS = 64


def _name(path: str, key: str, buckets: int) -> str:
    return "bucketed_" + hashlib.md5(f"{path}|{key}|{buckets}".encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` below ``path`` in buckets of ``key``, each sorted by it, and read it back.

    Rows are dealt to the buckets before the write, so a bucket is one file. The number of buckets
    bounds the tasks of a join, so it has to grow with the table; a table in the way is replaced.
    """
    spark = df.sparkSession
    name = _name(path, key, buckets)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A table that ``write_bucketed`` left below ``path``, with its buckets known to the planner.

    The session's catalog gets an entry that points at the files; no data is read or moved.
    """
    name = _name(path, key, buckets)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)
