"""Request-rate, error and duration features per endpoint and window."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators.series import HEAVY_ROWS, prefix_sums, quantile_of

CELL = ["case_id", "endpoint_key", "timestamp_window_ms"]
MIN_FOR_P50 = 2
MIN_FOR_TAIL = 5


def entry_spans(traces: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Entry spans of nested traces with their ``METHOD:path`` key.

    A span whose own name is no endpoint takes the first endpoint of the trace summary; a span
    with neither is dropped.
    """

    def key_of(name: Column) -> Column:
        method = F.regexp_extract(name, K.ENTRY_ENDPOINT, 1)
        return S.endpoint_key(method, F.regexp_extract(name, K.ENTRY_ENDPOINT, 2), known)

    listed = F.filter("summary.endpoint_names", lambda n: n.rlike(K.ENTRY_ENDPOINT))
    spans = traces.withColumn("_fallback", F.get(listed, F.lit(0))).withColumn(
        "_span", F.explode(F.filter("spans", lambda s: s["type"] == "Entry"))
    )
    own = F.col("_span.endpoint_name")
    name = F.when(own.rlike(K.ENTRY_ENDPOINT), own).otherwise(F.col("_fallback"))
    kept = [c for c in traces.columns if c not in ("spans", "summary")]
    return (
        spans.where(F.coalesce(own != "", F.lit(False)))
        .withColumn("_name", name)
        .where(F.col("_name").isNotNull())
        .select(
            *kept,
            key_of(F.col("_name")).alias("endpoint_key"),
            F.col("_span.start_ms").alias("ts_ms"),
            F.col("_span.latency_ms").alias("latency_ms"),
            F.col("_span.is_error").alias("is_error"),
            F.col("_span.status_code").alias("status_code"),
        )
    )


def requests_of(lines: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Client request records to (endpoint_key, ts_ms, latency_ms, status_code)."""
    kept = [c for c in lines.columns if c not in ("timestamp", "method", "url")]
    return lines.select(
        *kept,
        S.endpoint_key(F.col("method"), F.col("url"), known).alias("endpoint_key"),
        S.iso_to_ms(F.col("timestamp")).alias("ts_ms"),
    )


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _cells(df: DataFrame, window_ms: int, flags: dict[str, Column], heavy_rows: int) -> DataFrame:
    """Per cell: row count, latency mean and gated quantiles, and one sum per flag.

    Rows are first counted per (cell, latency), so that equal latencies never travel twice, and
    the latencies of a cell are ranked in ranges (``prefix_sums``).
    """
    cells = df.withColumn("timestamp_window_ms", S.bucket(F.col("ts_ms"), window_ms))
    counts = cells.groupBy(*CELL, "latency_ms").agg(
        F.count("*").alias("rows"),
        F.count("latency_ms").alias("timed"),
        *[_count(flag).alias(name) for name, flag in flags.items()],
    )
    ranked = prefix_sums(counts, CELL, "latency_ms", ["timed"], heavy_rows)
    total = F.max("timed_total")

    def gated(q: float, least: int) -> Column:
        return F.when(total >= least, quantile_of("latency_ms", "timed", q))

    weighted = F.sum(F.col("latency_ms") * F.col("timed"))
    return ranked.groupBy(*CELL).agg(
        F.sum("rows").alias("rows"),
        F.try_divide(weighted, F.sum("timed")).alias("mean"),
        gated(0.5, MIN_FOR_P50).alias("p50"),
        gated(0.95, MIN_FOR_TAIL).alias("p95"),
        gated(0.99, MIN_FOR_TAIL).alias("p99"),
        *[F.sum(name).alias(name) for name in flags],
    )


def trace_red(
    spans: DataFrame, window_ms: int = K.WINDOW_MS, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Server-side RED. Status rates count only spans with a status and are NULL without any."""
    status = F.col("status_code")
    flags = {
        "errors": F.col("is_error"),
        "with_status": status.isNotNull(),
        "s5xx": (status >= 500) & (status < 600),
        "s4xx": (status >= 400) & (status < 500),
    }
    cells = _cells(spans, window_ms, flags, heavy_rows)
    return cells.select(
        *CELL,
        F.col("rows").alias("trace_request_count"),
        F.col("mean").alias("trace_latency_mean"),
        F.col("p50").alias("trace_latency_p50"),
        F.col("p95").alias("trace_latency_p95"),
        F.col("p99").alias("trace_latency_p99"),
        F.try_divide("errors", "rows").alias("trace_error_rate"),
        F.try_divide("s5xx", "with_status").alias("trace_5xx_rate"),
        F.try_divide("s4xx", "with_status").alias("trace_4xx_rate"),
        F.try_divide("with_status", "rows").alias("trace_status_coverage"),
    )


def client_red(
    requests: DataFrame, window_ms: int = K.WINDOW_MS, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Client-side RED."""
    status = F.col("status_code")
    flags = {
        "errors": status >= 400,
        "s2xx": (status >= 200) & (status < 300),
        "s4xx": (status >= 400) & (status < 500),
        "s5xx": (status >= 500) & (status < 600),
    }
    cells = _cells(requests, window_ms, flags, heavy_rows)
    return cells.select(
        *CELL,
        F.col("rows").alias("request_count"),
        F.try_divide("errors", "rows").alias("error_rate"),
        F.col("mean").alias("latency_mean"),
        F.col("p50").alias("latency_p50"),
        F.col("p95").alias("latency_p95"),
        F.col("p99").alias("latency_p99"),
        F.try_divide("s2xx", "rows").alias("status_2xx_rate"),
        F.try_divide("s4xx", "rows").alias("status_4xx_rate"),
        F.try_divide("s5xx", "rows").alias("status_5xx_rate"),
    )


def keep_endpoints(df: DataFrame, endpoints: dict[str, str] | DataFrame) -> DataFrame:
    """Rows whose endpoint is known. A configured map becomes a pushed-down IN filter; a table
    of endpoints a semi-join whose strategy the planner picks by size."""
    if isinstance(endpoints, dict):
        return df.where(F.col("endpoint_key").isin(list(endpoints)))
    return df.join(endpoints.select("endpoint_key"), "endpoint_key", "left_semi")


def with_service(df: DataFrame, endpoints: dict[str, str] | DataFrame) -> DataFrame:
    """Add ``service_name``; an unknown endpoint gives NULL."""
    if isinstance(endpoints, dict):
        pairs = [F.lit(text) for pair in endpoints.items() for text in pair]
        return df.withColumn("service_name", F.try_element_at(F.create_map(*pairs), "endpoint_key"))
    return df.join(endpoints.select("endpoint_key", "service_name"), "endpoint_key", "left")


def trace_features(red: DataFrame, endpoints: dict[str, str] | DataFrame) -> DataFrame:
    """The five server-side features of known endpoints."""
    features = [
        "trace_request_count", "trace_latency_p50", "trace_latency_p95",
        "trace_error_rate", "trace_5xx_rate",
    ]
    return keep_endpoints(red, endpoints).select(
        *CELL, *[F.col(f).cast("double").alias(f"endpoint_red__{f}") for f in features]
    )


def client_features(
    red: DataFrame, trace: DataFrame | None, endpoints: dict[str, str] | DataFrame
) -> DataFrame:
    """The five client-side features of known endpoints.

    ``latency_divergence`` is client p95 minus trace p95 of the same cell; NULL without a trace.
    """
    client = keep_endpoints(red, endpoints).select(
        *CELL,
        F.col("request_count").cast("double").alias("endpoint_red__client_request_count"),
        F.col("latency_p95").alias("endpoint_red__client_latency_p95"),
        F.col("error_rate").alias("endpoint_red__client_error_rate"),
        F.col("status_5xx_rate").alias("endpoint_red__client_5xx_rate"),
    )
    if trace is None:
        return client.withColumn("endpoint_red__latency_divergence", F.lit(None).cast("double"))
    p95 = trace.select(*CELL, F.col("trace_latency_p95").alias("_trace_p95"))
    gap = F.col("endpoint_red__client_latency_p95") - F.col("_trace_p95")
    return (
        client.join(p95, CELL, "left")
        .withColumn("endpoint_red__latency_divergence", gap)
        .drop("_trace_p95")
    )


def endpoint_features(
    trace_red_table: DataFrame, client_red_table: DataFrame, endpoints: dict[str, str] | DataFrame
) -> DataFrame:
    """Server and client features of the cells both sides have, in one join.

    The divergence reuses the joined p95: a cell without a trace row is not in the result anyway.
    """
    trace = trace_features(trace_red_table, endpoints)
    client = client_features(client_red_table, None, endpoints)
    gap = F.col("endpoint_red__client_latency_p95") - F.col("endpoint_red__trace_latency_p95")
    return trace.join(client, CELL, "inner").withColumn("endpoint_red__latency_divergence", gap)


def fuse(trace: DataFrame, client: DataFrame) -> DataFrame:
    """Inner join of both RED tables, client columns prefixed."""
    renamed = client.select(
        *CELL,
        F.col("request_count").alias("client_request_count"),
        F.col("error_rate").alias("client_error_rate"),
        F.col("status_2xx_rate").alias("client_2xx_rate"),
        F.col("status_4xx_rate").alias("client_4xx_rate"),
    )
    return trace.join(renamed, CELL, "inner")


def fuse_report(trace: DataFrame, client: DataFrame) -> DataFrame:
    """Per case: cells on each side, cells on both, repeated keys and the share of client cells hit.

    More than 0 repeats breaks the one-to-one join, a hit rate below 0.6 deserves a warning.
    """
    sides = trace.select(*CELL, F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(
        client.select(*CELL, F.lit(0).alias("t"), F.lit(1).alias("c"))
    )
    cells = sides.groupBy(*CELL).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    both = _count((F.col("t") > 0) & (F.col("c") > 0))
    return cells.groupBy("case_id").agg(
        _count(F.col("t") > 0).alias("trace_cells"),
        _count(F.col("c") > 0).alias("client_cells"),
        both.alias("fused_cells"),
        F.sum(F.greatest(F.col("t") - 1, F.lit(0)) + F.greatest(F.col("c") - 1, F.lit(0))).alias(
            "repeated_keys"
        ),
        F.try_divide(both, _count(F.col("c") > 0)).alias("hit_rate"),
    )


def case_bounds(red: DataFrame) -> DataFrame:
    """First and last window start per case."""
    return red.groupBy("case_id").agg(
        F.min("timestamp_window_ms").alias("start_ms"), F.max("timestamp_window_ms").alias("end_ms")
    )


def window_density(
    spans: DataFrame, sizes_ms: tuple[int, ...] = (5_000, 10_000, 15_000, 90_000)
) -> DataFrame:
    """Per candidate window size: share of cells without a p95 and the median request count.

    Spans are counted once on the greatest common grid and the counts rolled up per size.
    """
    finest = gcd(*sizes_ms)
    fine = (
        spans.withColumn("_fine_ms", S.bucket(F.col("ts_ms"), finest))
        .groupBy("case_id", "endpoint_key", "_fine_ms")
        .agg(F.count("*").alias("rows"), F.count("latency_ms").alias("timed"))
    )
    sized = fine.withColumn("window_ms", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes_ms])))
    start = (F.floor(F.col("_fine_ms") / F.col("window_ms")) * F.col("window_ms")).cast("long")
    cells = (
        sized.withColumn("timestamp_window_ms", start)
        .groupBy("window_ms", *CELL)
        .agg(F.sum("rows").alias("rows"), F.sum("timed").alias("timed"))
    )
    counts = cells.groupBy("window_ms", "rows").agg(
        F.count("*").alias("cells"), _count(F.col("timed") < MIN_FOR_TAIL).alias("without_p95")
    )
    ranked = prefix_sums(counts, ["window_ms"], "rows", ["cells"])
    return ranked.groupBy("window_ms").agg(
        F.sum("cells").alias("n_cells"),
        F.try_divide(F.sum("without_p95"), F.sum("cells")).alias("p95_null_rate"),
        quantile_of("rows", "cells", 0.5).alias("median_requests"),
    ).withColumnRenamed("n_cells", "cells")
