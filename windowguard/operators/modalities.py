"""The modalities and the fusion of the wide table behind the common protocols."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import logs, metrics, red
from windowguard.operators.oneclass import MODALITY_ORDER


@dataclass
class TraceModality:
    endpoints: dict = field(default_factory=lambda: dict(K.ENDPOINT_SERVICES))
    version: str = "v0"
    feature_columns: list = field(
        default_factory=lambda: [f"endpoint_red__{f}" for f in K.ENDPOINT_FEATURES[:5]]
    )

    def fit(self, df: DataFrame) -> None:
        return None

    def transform(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return red.trace_features(df, self.endpoints)


@dataclass
class ClientModality:
    """Client features; ``stats`` is the trace RED table the divergence is taken against."""

    endpoints: dict = field(default_factory=lambda: dict(K.ENDPOINT_SERVICES))
    version: str = "v0"
    feature_columns: list = field(
        default_factory=lambda: [f"endpoint_red__{f}" for f in K.ENDPOINT_FEATURES[5:]]
    )

    def fit(self, df: DataFrame) -> None:
        return None

    def transform(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return red.client_features(df, stats, self.endpoints)


@dataclass
class MetricModality:
    services: list = field(default_factory=lambda: sorted(set(K.ENDPOINT_SERVICES.values())))
    window_ms: int = K.WINDOW_MS
    version: str = "v0"
    feature_columns: list = field(
        default_factory=lambda: [f"service_metric__{f}" for f in K.METRIC_FEATURES]
    )

    def fit(self, df: DataFrame) -> None:
        return None

    def transform(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return metrics.metric_features(df, self.services, self.window_ms)


@dataclass
class LogModality:
    """Log features; ``fit`` gives the template table of the parsed Normal lines."""

    window_ms: int = K.WINDOW_MS
    version: str = "v0"
    feature_columns: list = field(
        default_factory=lambda: [f"service_log__{f}" for f in K.LOG_FEATURES]
    )

    def fit(self, df: DataFrame) -> DataFrame:
        return logs.fit_templates(df)

    def transform(self, df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
        return logs.log_features(df, stats, self.window_ms)


@dataclass
class EarlyConcat:
    """Concatenation in the fixed modality order; missing or extra modalities are an error."""

    dims: dict[str, int]

    def __post_init__(self) -> None:
        if set(self.dims) != set(MODALITY_ORDER):
            raise ValueError(f"modalities {sorted(self.dims)} must be {sorted(MODALITY_ORDER)}")

    @property
    def output_dim(self) -> int:
        return sum(self.dims.values())

    def __call__(self, vectors: dict[str, Column]) -> Column:
        return S.early_concat(vectors, MODALITY_ORDER)
