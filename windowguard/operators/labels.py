"""Identity columns, fault-injection phases and weak labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowguard.functions import scalars as S
from windowguard.operators.series import quantiles
from windowguard.session import stage

PHASES = ["normal", "baseline", "inject", "recover"]


def with_identity(df: DataFrame) -> DataFrame:
    """Add ``window_str`` and ``sample_id``."""
    window = F.col("timestamp_window_ms")
    parts = ("case_id", "endpoint_key", window.cast("string"))
    return df.withColumns(
        {"window_str": S.ms_to_iso(window), "sample_id": F.concat_ws("__", *parts)}
    )


def phase_of(window: Column, start: Column, end: Column) -> Column:
    """Phase of a window against the injection bounds, both inclusive."""
    return (
        F.when(start.isNull() | end.isNull(), "normal")
        .when(window > end, "recover")
        .when(window >= start, "inject")
        .otherwise("baseline")
    )


def with_labels(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Join the case metadata and add the eight label columns.

    A case without metadata counts as a Normal one.
    """
    meta = cases.select(
        "case_id",
        F.col("inject_start_ms").alias("injection_start_ms"),
        F.col("inject_end_ms").alias("injection_end_ms"),
        "target_service",
        "anomaly_type",
        "anomaly_level",
        F.lit(True).alias("_known"),
    )
    phase = phase_of(
        F.col("timestamp_window_ms"), F.col("injection_start_ms"), F.col("injection_end_ms")
    )
    known = F.col("_known").isNotNull()
    return (
        df.join(meta, "case_id", "left")
        .withColumn("phase", phase)
        .withColumns(
            {
                "is_anomaly": F.col("phase") == "inject",
                "is_train_eligible": F.col("phase") != "inject",
                "anomaly_type": F.when(known, F.col("anomaly_type")).otherwise("Normal"),
                "anomaly_level": F.when(known, F.col("anomaly_level")).otherwise("none"),
            }
        )
        .drop("_known")
    )


def phase_counts(df: DataFrame) -> DataFrame:
    """Rows per case and phase, 0 where a phase does not occur."""
    return (
        df.groupBy("case_id")
        .pivot("phase", PHASES)
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=PHASES)
        .withColumn("total", sum((F.col(p) for p in PHASES), F.lit(0)))
    )


def mad_baseline(normal_red: DataFrame) -> DataFrame:
    """Thresholds per endpoint from Normal windows.

    Latency: median + 3 MAD of the p95, or 1.1 medians where the MAD is 0. Error and 5xx rate:
    mean + 0.1. ``normal_red`` is read several times and should be a stored table.
    """
    p95 = "trace_latency_p95"
    medians = quantiles(normal_red, ["endpoint_key"], p95, {"p95_median": 0.5})
    medians = stage(medians, "medians")
    gaps = normal_red.join(medians, "endpoint_key").select(
        "endpoint_key", F.abs(F.col(p95) - F.col("p95_median")).alias("gap")
    )
    gaps = stage(gaps, "gaps")
    mads = quantiles(gaps, ["endpoint_key"], "gap", {"p95_mad": 0.5})
    means = normal_red.groupBy("endpoint_key").agg(
        (F.avg("trace_error_rate") + 0.1).alias("error_threshold"),
        (F.avg("trace_5xx_rate") + 0.1).alias("s5xx_threshold"),
    )
    median, mad = F.col("p95_median"), F.col("p95_mad")
    latency = F.when(mad == 0, median * 1.1).otherwise(median + 3 * mad)
    return (
        means.join(medians, "endpoint_key", "left")
        .join(mads, "endpoint_key", "left")
        .withColumn("latency_threshold", latency)
    )


def weak_labels(red: DataFrame, baseline: DataFrame) -> DataFrame:
    """Three threshold signals, their disjunction and a confidence.

    An endpoint without a baseline only has the absolute 5xx fallback of 0.4. With no baseline
    at all every signal is 0 and the confidence unknown. Confidence by number of signals (our
    choice): 3 high, 2 medium, 1 low, 0 normal.
    """
    any_baseline = baseline.agg(F.count("*") > 0).scalar()
    bounds = baseline.select(
        "endpoint_key",
        "latency_threshold",
        "error_threshold",
        "s5xx_threshold",
        F.lit(True).alias("_seen"),
    )
    s5xx_bound = F.when(F.col("_seen"), F.col("s5xx_threshold")).otherwise(0.4)

    def signal(value: str, bound: Column) -> Column:
        hit = F.coalesce(F.col(value) > bound, F.lit(False))
        return F.when(any_baseline & hit, 1).otherwise(0)

    joined = red.join(bounds, "endpoint_key", "left").withColumns(
        {
            "latency_anomaly_signal": signal("trace_latency_p95", F.col("latency_threshold")),
            "error_anomaly_signal": signal("trace_error_rate", F.col("error_threshold")),
            "5xx_anomaly_signal": signal("trace_5xx_rate", s5xx_bound),
        }
    )
    signals = (
        F.col("latency_anomaly_signal") + F.col("error_anomaly_signal") + F.col("5xx_anomaly_signal")
    )
    confidence = (
        F.when(~any_baseline, "unknown")
        .when(signals == 3, "high")
        .when(signals == 2, "medium")
        .when(signals == 1, "low")
        .otherwise("normal")
    )
    return joined.withColumns(
        {
            "weak_is_anomaly": F.when(signals > 0, 1).otherwise(0),
            "label_confidence": confidence,
        }
    ).drop("latency_threshold", "error_threshold", "s5xx_threshold", "_seen")
