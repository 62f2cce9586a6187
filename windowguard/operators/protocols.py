"""What a modality and a fusion have to offer."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Modality(Protocol):
    """Turns the raw rows of one source into feature columns; ``fit`` sees Normal rows only."""

    version: str
    feature_columns: list[str]

    def fit(self, df: DataFrame) -> DataFrame | None: ...

    def transform(self, df: DataFrame, stats: DataFrame | None) -> DataFrame: ...


class Fusion(Protocol):
    """Turns one vector per modality into one vector."""

    output_dim: int

    def __call__(self, vectors: dict[str, Column]) -> Column: ...
