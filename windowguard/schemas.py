"""Schemas of the sources and the column groups of the wide table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from windowguard import constants as K

SCOPES = {
    "per_endpoint_min_max": ("per_endpoint", "endpoint_key"),
    "per_service_min_max": ("per_service", "service_name"),
    "global_min_max": ("global", None),
}


@dataclass(frozen=True)
class ModalitySpec:
    features: tuple[str, ...]
    normalization: str

    def __post_init__(self) -> None:
        if not self.features:
            raise ValueError("a modality needs at least one feature")
        if self.normalization not in SCOPES:
            raise ValueError(f"unknown normalization {self.normalization!r}, use one of {sorted(SCOPES)}")


def _default_modalities() -> dict[str, ModalitySpec]:
    return {
        "endpoint_red": ModalitySpec(tuple(K.ENDPOINT_FEATURES), "per_endpoint_min_max"),
        "service_metric": ModalitySpec(tuple(K.METRIC_FEATURES), "per_service_min_max"),
        "service_log": ModalitySpec(tuple(K.LOG_FEATURES), "per_service_min_max"),
    }


@dataclass(frozen=True)
class ContractConfig:
    """Which features the wide table holds and how each group is normalised."""

    contract_version: str = "v0"
    window_size_s: int = 15
    modalities: dict[str, ModalitySpec] = field(default_factory=_default_modalities)

    def columns(self, modality: str) -> list[str]:
        return [f"{modality}__{feature}" for feature in self.modalities[modality].features]

    @property
    def feature_columns(self) -> list[str]:
        return [column for modality in self.modalities for column in self.columns(modality)]

    @property
    def rules(self) -> dict[str, str]:
        """Feature column to normalisation scope."""
        return {
            column: SCOPES[spec.normalization][0]
            for modality, spec in self.modalities.items()
            for column in self.columns(modality)
        }

    @classmethod
    def from_dict(cls, raw: dict) -> "ContractConfig":
        if "modalities" not in raw:
            raise ValueError("contract config lacks 'modalities'")
        return cls(
            contract_version=raw["contract_version"],
            window_size_s=raw["window_size_s"],
            modalities={
                name: ModalitySpec(tuple(spec.get("features", ())), spec["normalization"])
                for name, spec in raw["modalities"].items()
            },
        )


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

TRACE_RED = _struct(
    case_id=S, anomaly_type=S, timestamp_window=L, window_str=S, endpoint_key=S, method=S,
    normalized_path=S, trace_request_count=L, trace_latency_mean=D, trace_latency_p50=D,
    trace_latency_p95=D, trace_latency_p99=D, trace_error_rate=D, trace_5xx_rate=D,
    trace_4xx_rate=D, trace_status_coverage=D, weak_is_anomaly=I, label_confidence=S,
    latency_anomaly_signal=I, error_anomaly_signal=I,
    **{"5xx_anomaly_signal": I},
    phase=S, injection_start_ms=L, injection_end_ms=L, target_service=S,
)

CLIENT_RED = _struct(
    case_id=S, anomaly_type=S, timestamp_window=S, endpoint_key=S, request_count=L, error_rate=D,
    latency_mean=D, latency_p50=D, latency_p95=D, latency_p99=D, status_2xx_rate=D,
    status_4xx_rate=D, status_5xx_rate=D, method=S, normalized_path=S,
)

REQUEST = _struct(timestamp=S, method=S, url=S, status_code=I, latency_ms=D)

SPAN = _struct(type=S, endpoint_name=S, start_ms=L, latency_ms=D, is_error=B, status_code=I)
TRACE = _struct(
    trace_id=S, spans=T.ArrayType(SPAN), summary=_struct(endpoint_names=T.ArrayType(S))
)

RANGE_RESULT = _struct(metric=T.MapType(S, S), values=T.ArrayType(T.ArrayType(S)))
