"""Service features from long-format metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators.series import previous_row
from windowguard.session import stage

SAMPLE_COLUMNS = ["case_id", "metric_name", "timestamp", "value", "pod", "interface"]


def source_keys(df: DataFrame) -> list[str]:
    """What samples are summed up within: the case, and the file where several files are told apart.

    Files of one case that overlap in time then show up as repeated rows, not as doubled counters.
    """
    return ["case_id", *(c for c in ("metric_file",) if c in df.columns)]


def filter_samples(
    samples: DataFrame, bounds: DataFrame, names: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Samples of the named metrics between the case's first and last window start.

    Both ends are inclusive. The upper end is the start of the last window, so that samples
    inside that window are left out. ``keep`` are further columns to keep.
    """
    named = samples.where(F.col("metric_name").isin(names or K.POD_METRICS + K.HOST_METRICS))
    seconds = bounds.select(
        "case_id",
        (F.col("start_ms") / F.lit(1000.0)).alias("_start"),
        (F.col("end_ms") / F.lit(1000.0)).alias("_end"),
    )
    inside = F.col("timestamp").between(F.col("_start"), F.col("_end"))
    kept = dict.fromkeys([*source_keys(samples), *SAMPLE_COLUMNS, *(keep or [])])
    return named.select(*kept).join(seconds, "case_id").where(inside).drop("_start", "_end")


def count_in_range(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Number of samples with start <= timestamp <= end; seconds are truncated before comparing."""
    ms = F.col("timestamp").cast("long") * 1000
    return samples.where(ms.between(start_ms, end_ms)).agg(F.count("*").alias("rows_kept"))


def _windowed(samples: DataFrame, window_ms: int) -> DataFrame:
    ms = F.col("timestamp").cast("long") * 1000
    return samples.withColumn("timestamp_window_ms", S.bucket(ms, window_ms))


def _mean_of(metric: str):
    return F.avg(F.when(F.col("metric_name") == metric, F.col("value")))


def pod_windows(samples: DataFrame, services: list[str], window_ms: int = K.WINDOW_MS) -> DataFrame:
    """Mean of each pod metric per (case, service, pod, window), one column per metric.

    The metric list is fixed, so the long-to-wide turn is one aggregation with map-side combine.
    The service depends on the pod alone and is looked up once per pod and window.
    """
    pods = samples.where(F.col("metric_name").isin(K.POD_METRICS)).where(
        F.col("pod").isNotNull() & (F.col("pod") != "")
    )
    return (
        _windowed(pods, window_ms)
        .groupBy(*source_keys(samples), "pod", "timestamp_window_ms")
        .agg(
            _mean_of(K.CPU_COUNTER).alias("cpu"),
            _mean_of(K.MEMORY_USAGE).alias("memory"),
            _mean_of(K.MEMORY_LIMIT).alias("memory_limit"),
            _mean_of(K.PROCESSES).alias("processes"),
        )
        .withColumn("service_name", S.service_of_pod(F.col("pod")))
        .where(F.col("service_name").isin(services))
    )


def metric_pivot(samples: DataFrame, names: list[str], window_ms: int = K.WINDOW_MS) -> DataFrame:
    """Mean value per (case, pod, window) with one column per named metric."""
    return (
        _windowed(samples.where(F.col("pod").isNotNull()), window_ms)
        .groupBy("case_id", "pod", "timestamp_window_ms")
        .pivot("metric_name", names)
        .agg(F.avg("value"))
    )


def counter_rate(
    series: DataFrame,
    keys: list[str],
    counter: str,
    rate: str,
    window_ms: int = K.WINDOW_MS,
    scale_ms: int | None = None,
) -> DataFrame:
    """Difference of a counter to the previous present row, per second of one window.

    The length of a gap is ignored; a drop, a missing value and the first row give 0.
    """
    before = previous_row(series, keys, "timestamp_window_ms", [counter], window_ms)
    step = (F.col(counter) - F.col(f"previous_{counter}")) / F.lit((scale_ms or window_ms) / 1000.0)
    return before.withColumn(rate, F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0))).drop(
        f"previous_{counter}"
    )


def pod_features(samples: DataFrame, services: list[str], window_ms: int = K.WINDOW_MS) -> DataFrame:
    """CPU rate, memory ratio and process count per (case, service, window), mean over pods.

    The process count stays missing where no pod has one, but is 0 where its metric does not
    occur in the case at all. The pod windows are staged, because the samples they sum up are
    many and what follows reads them several times.
    """
    keys = source_keys(samples)
    wide = stage(pod_windows(samples, services, window_ms), "pod-windows")
    rated = counter_rate(wide, [*keys, "pod"], "cpu", "cpu_rate", window_ms)
    ratio = F.when(F.col("memory_limit") > 0, F.col("memory") / F.col("memory_limit"))
    service = (
        rated.withColumn("memory_ratio", F.coalesce(S.clip(ratio, 0.0, 1.0), F.lit(0.0)))
        .groupBy(*keys, "service_name", "timestamp_window_ms")
        .agg(
            F.avg("cpu_rate").alias("service_metric__cpu_usage_rate"),
            F.avg("memory_ratio").alias("service_metric__memory_usage_ratio"),
            F.avg("processes").alias("service_metric__process_count"),
        )
    )
    count = F.col("service_metric__process_count")
    # One row per case, stored: the planner knows that it is small.
    present = stage(wide.groupBy(*keys).agg((F.count("processes") > 0).alias("_has_processes")), "processes")
    return (
        service.join(present, keys)
        .withColumn(
            "service_metric__process_count",
            F.when(F.col("_has_processes"), count).otherwise(F.lit(0.0)),
        )
        .drop("_has_processes")
    )


def host_rates(samples: DataFrame, window_ms: int = K.WINDOW_MS) -> DataFrame:
    """Network error rates per (case, window): counters summed over interfaces, then differenced."""
    sums = (
        _windowed(samples.where(F.col("metric_name").isin(K.HOST_METRICS)), window_ms)
        .groupBy(*source_keys(samples), "metric_name", "timestamp_window_ms")
        .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    )
    keys = source_keys(samples)
    sums = stage(sums, "host-windows")
    rated = counter_rate(sums, [*keys, "metric_name"], "total", "rate", window_ms)

    def of(metric: str):
        rate = F.max(F.when(F.col("metric_name") == metric, F.col("rate")))
        return F.coalesce(rate, F.lit(0.0))

    return rated.groupBy(*keys, "timestamp_window_ms").agg(
        of(K.NET_RX_ERRORS).alias("service_metric__net_rx_error_rate"),
        of(K.NET_TX_ERRORS).alias("service_metric__net_tx_error_rate"),
    )


def metric_features(
    samples: DataFrame, services: list[str], window_ms: int = K.WINDOW_MS
) -> DataFrame:
    """The five service features; the host rates go to every service of the window."""
    pods = pod_features(samples, services, window_ms)
    return with_host_rates(pods, host_rates(samples, window_ms)).drop("metric_file")


def with_host_rates(cells: DataFrame, rates: DataFrame) -> DataFrame:
    """Give every service of a window the host rates of that window, 0 where there are none."""
    joined = cells.join(rates, [*source_keys(rates), "timestamp_window_ms"], "left")
    return joined.fillna(
        0.0, subset=["service_metric__net_rx_error_rate", "service_metric__net_tx_error_rate"]
    )
