"""Small helpers for schemas and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of the frame with further columns of the given types."""
    more = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])
