"""One-class scoring: modality vectors, centre and distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowguard.functions import scalars as S
from windowguard.operators.normalize import impute
from windowguard.schemas import ContractConfig

MODALITY_ORDER = ("endpoint_red", "service_metric", "service_log")
CENTER_EPS = 0.1


def modality_vectors(df: DataFrame, config: ContractConfig | None = None) -> DataFrame:
    """Add one ``array<double>`` column per modality, named after it."""
    config = config or ContractConfig()
    return df.withColumns(
        {
            name: F.array(*[F.col(c).cast("double") for c in config.columns(name)])
            for name in config.modalities
        }
    )


def fused_vector(df: DataFrame, config: ContractConfig | None = None, name: str = "features") -> DataFrame:
    """Add the concatenation of the modality vectors in their fixed order."""
    config = config or ContractConfig()
    vectors = modality_vectors(df, config)
    columns = {m: F.col(m) for m in config.modalities}
    return vectors.withColumn(name, S.early_concat(columns, MODALITY_ORDER)).drop(*columns)


def mean_vector(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row ``center`` with the mean of each component: one aggregation, no explode."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)]
    return df.agg(F.array(*means).alias("center"))


def fit_center(df: DataFrame, vector: str, dim: int, eps: float = CENTER_EPS) -> DataFrame:
    """Mean vector whose components within ``eps`` of 0 are pushed to -eps or +eps."""

    def push(c: Column) -> Column:
        near = F.abs(c) < eps
        return F.when(near & (c < 0), F.lit(-eps)).when(near, F.lit(eps)).otherwise(c)

    return mean_vector(df, vector, dim).select(F.transform("center", push).alias("center"))


def score_sq(df: DataFrame, center: DataFrame, vector: str, dim: int) -> DataFrame:
    """Add ``score``, the squared distance to the centre (its mean is the one-class loss)."""
    placed = df.withColumn("_center", center.select("center").scalar())
    score = S.squared_distance(F.col(vector), F.col("_center"), dim)
    return placed.withColumn("score", score).drop("_center")


def score_l2(df: DataFrame, center: DataFrame, vector: str, dim: int) -> DataFrame:
    """Add ``score``, the plain distance to the mean vector."""
    return score_sq(df, center, vector, dim).withColumn("score", F.sqrt("score"))


def score_table(
    contract: DataFrame, config: ContractConfig | None = None, eps: float = CENTER_EPS
) -> DataFrame:
    """Scores of all rows against the centre of the Normal rows, features imputed by Normal means.

    ``contract`` is read for the means, the centre and the scores and should be a stored table.
    """
    config = config or ContractConfig()
    columns = config.feature_columns
    normal = contract.where(S.is_normal(F.col("anomaly_type")))
    filled = fused_vector(impute(contract, columns, "mean", fit=normal), config)
    normal_filled = fused_vector(impute(normal, columns, "mean"), config)
    center = fit_center(normal_filled, "features", len(columns), eps)
    return score_sq(filled, center, "features", len(columns)).select(
        "sample_id",
        "score",
        F.col("is_anomaly").cast("int").alias("y_true"),
        "case_id",
        "endpoint_key",
        "phase",
        "anomaly_type",
        "anomaly_level",
    )
