"""Queries over requests, spans and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import labels, normalize, red
from windowguard.plans import sql as Q
from windowguard.plans.registry import query, rounded
from windowguard.session import stage
from windowguard.sources import tables as A

SIX_HOURS = 6 * A.HOUR_MS
TRACE_RATES = [
    "trace_latency_mean", "trace_latency_p50", "trace_latency_p95", "trace_latency_p99",
    "trace_error_rate", "trace_5xx_rate", "trace_4xx_rate", "trace_status_coverage",
]
CLIENT_RATES = [
    "error_rate", "latency_mean", "latency_p50", "latency_p95", "latency_p99",
    "status_2xx_rate", "status_4xx_rate", "status_5xx_rate",
]
CELL = "case_id, endpoint_key, timestamp_window_ms"


def red_tables(spark, folder, window_ms) -> tuple[DataFrame, DataFrame]:
    """Both RED tables, staged as the stored tables they are meant to be."""
    trace = red.trace_red(A.spans(spark, folder), window_ms)
    client = red.client_red(A.client_requests(spark, folder), window_ms)
    return stage(trace, "trace-red"), stage(client, "client-red")


@query(
    f"""WITH {Q.EV} SELECT event_type, {Q.bucket("ts_ms", SIX_HOURS)} AS timestamp_window_ms,
    count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2"""
)
def tumbling_bucket(spark, folder):
    """Events per type and epoch-aligned window."""
    window = S.bucket(F.col("ts_ms"), SIX_HOURS).alias("timestamp_window_ms")
    return A.events(spark, folder).groupBy("event_type", window).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(f"WITH {Q.red(SIX_HOURS)} SELECT {CELL}, request_count, {Q.rounds(CLIENT_RATES)} FROM client")
def client_red(spark, folder):
    """Client RED per case, endpoint and 6 h window, with gated quantiles."""
    return rounded(red.client_red(A.client_requests(spark, folder), SIX_HOURS))


@query(f"WITH {Q.red(SIX_HOURS)} SELECT {CELL}, trace_request_count, {Q.rounds(TRACE_RATES)} FROM trace")
def trace_red(spark, folder):
    """Server RED per case, endpoint and 6 h window; status rates only over spans with a status."""
    return rounded(red.trace_red(A.spans(spark, folder), SIX_HOURS))


RULES = {
    "request_count": "per_endpoint",
    "latency_p95": "per_endpoint",
    "latency_mean": "per_service",
    "error_rate": "global",
}
FIT_SQL = f"""{Q.red(A.DAY_MS)},
served AS (SELECT *, {Q.SERVICE_OF_ENDPOINT} AS service_name FROM client),
normal AS (SELECT * FROM served WHERE case_id LIKE 'Normal%'),
stats AS (
  SELECT 'request_count' AS feature, 'per_endpoint' AS scope, endpoint_key AS group_key,
    CAST(min(request_count) AS DOUBLE) AS lo, CAST(max(request_count) AS DOUBLE) AS hi FROM normal GROUP BY ALL
  UNION ALL SELECT 'latency_p95', 'per_endpoint', endpoint_key, min(latency_p95), max(latency_p95)
    FROM normal GROUP BY ALL
  UNION ALL SELECT 'latency_mean', 'per_service', service_name, min(latency_mean), max(latency_mean)
    FROM normal WHERE service_name IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'error_rate', 'global', '__global__', min(error_rate), max(error_rate) FROM normal)"""


def _served(spark, folder) -> DataFrame:
    client = stage(red.client_red(A.client_requests(spark, folder), A.DAY_MS), "client-red")
    return red.with_service(client, A.ENDPOINTS)


@query(f"WITH {FIT_SQL} SELECT feature, scope, group_key, {Q.rounds(['lo', 'hi'])} FROM stats")
def minmax_fit(spark, folder):
    """Ranges of four features on Normal windows, by endpoint, by service and overall."""
    normal = _served(spark, folder).where(S.is_normal(F.col("case_id")))
    return rounded(normalize.fit_minmax(normal, RULES))


def _applied(feature: str, key: str) -> str:
    hit = f"SELECT {{}} FROM stats s WHERE s.feature = '{feature}' AND s.group_key = {key}"
    low, high = (f"({hit.format(side)})" for side in ("lo", "hi"))
    seen = f"EXISTS ({hit.format('1')})"
    scaled = f"({feature} - {low}) / greatest({high} - {low}, 1e-9)"
    return f"round(CASE WHEN {seen} THEN {scaled} ELSE {feature} END, 6) + 0 AS {feature}"


@query(
    f"""WITH {FIT_SQL} SELECT {CELL}, {_applied("request_count", "endpoint_key")},
    {_applied("latency_p95", "endpoint_key")}, {_applied("latency_mean", "service_name")},
    {_applied("error_rate", "'__global__'")} FROM served"""
)
def minmax_apply(spark, folder):
    """All windows scaled by the Normal ranges; an endpoint without a service stays raw."""
    served = _served(spark, folder)
    stats = stage(normalize.fit_minmax(served.where(S.is_normal(F.col("case_id"))), RULES), "stats")
    scaled = normalize.apply_minmax(served, stats, RULES)
    return rounded(scaled.select(*red.CELL, *RULES))


@query(
    f"""WITH {Q.EV}, {Q.CLIENTS}, known AS (SELECT 'POST:/api/v1/' || event_type AS endpoint_key
    FROM events GROUP BY event_type HAVING avg(value) >= (SELECT avg(value) FROM events))
    SELECT endpoint_key, count(*) AS n, round(sum(latency_ms), 4) AS total
    FROM clients WHERE endpoint_key IN (SELECT endpoint_key FROM known) GROUP BY 1"""
)
def endpoint_semi_join(spark, folder):
    """Requests of the endpoints in a table of slow endpoints."""
    events = A.events(spark, folder)
    mean = events.agg(F.avg("value")).scalar()
    slow = events.groupBy("endpoint_key").agg(F.avg("value").alias("m")).where(F.col("m") >= mean)
    kept = red.keep_endpoints(A.client_requests(spark, folder), slow)
    return kept.groupBy("endpoint_key").agg(
        F.count("*").alias("n"), F.round(F.sum("latency_ms"), 4).alias("total")
    )


@query(
    f"""WITH {Q.EV}, {Q.CLIENTS} SELECT endpoint_key, {Q.SERVICE_OF_ENDPOINT} AS service_name,
    count(*) AS n FROM clients GROUP BY 1, 2"""
)
def endpoint_service_lookup(spark, folder):
    """Requests per endpoint with its service, NULL for an unmapped endpoint."""
    served = red.with_service(A.client_requests(spark, folder), A.ENDPOINTS)
    return served.groupBy("endpoint_key", "service_name").agg(F.count("*").alias("n"))


@query(f"WITH {Q.red(A.DAY_MS)}, {Q.CELLS} SELECT {CELL}, {Q.rounds(Q.FEATURES[:10])} FROM cells")
def red_inner_join(spark, folder):
    """Server and client features of the cells both sides have."""
    trace, client = red_tables(spark, folder, A.DAY_MS)
    return rounded(red.endpoint_features(trace, client, A.ENDPOINTS))


@query(
    f"""WITH {Q.red(SIX_HOURS)} SELECT {CELL},
    round(c.latency_p95, 6) AS endpoint_red__client_latency_p95,
    round(c.latency_p95 - t.trace_latency_p95, 6) + 0 AS endpoint_red__latency_divergence
    FROM client c LEFT JOIN trace t USING (case_id, endpoint_key, timestamp_window_ms)
    WHERE endpoint_key IN {Q.ENDPOINT_LIST}"""
)
def latency_divergence(spark, folder):
    """Client p95 minus server p95 per cell, NULL without a server row."""
    trace, client = red_tables(spark, folder, SIX_HOURS)
    features = red.client_features(client, trace, A.ENDPOINTS)
    return rounded(
        features.select(
            *red.CELL, "endpoint_red__client_latency_p95", "endpoint_red__latency_divergence"
        )
    )


def _order_traces(spark, folder) -> DataFrame:
    """One nested trace per order: an entry span, a local span and an entry span without a path."""
    status = F.col("o_orderstatus")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))

    def span(kind: str, name, latency) -> F.Column:
        return F.struct(
            F.lit(kind).alias("type"),
            name.alias("endpoint_name"),
            start.alias("start_ms"),
            latency.cast("double").alias("latency_ms"),
            (status == "F").alias("is_error"),
            F.when(status == "O", 200).alias("status_code"),
        )

    own = F.concat(F.lit("POST:/api/orders/"), F.col("o_custkey").cast("string"))
    spans = F.array(
        span("Entry", own, F.col("o_totalprice")),
        span("Local", F.lit("GET:/never/seen"), F.col("o_totalprice")),
        span("Entry", F.lit("DatabaseCall"), F.col("o_totalprice") / 2),
        span("Entry", F.lit(""), F.col("o_totalprice") / 4),
    )
    listed = F.when(
        status != "P", F.array(F.lit("Queue"), F.concat(F.lit("GET:/api/"), F.lower("o_orderpriority")))
    ).otherwise(F.array(F.lit("Queue")))
    return A.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("trace_id"),
        spans.alias("spans"),
        F.struct(listed.alias("endpoint_names")).alias("summary"),
    )


@query(
    """WITH t AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN
        CASE WHEN regexp_matches(lower(o_orderpriority), '^[a-z]+(_[a-z0-9]+)*$')
          THEN 'GET:/api/' || lower(o_orderpriority) ELSE 'GET:/api/{param}' END END AS fallback FROM orders),
    s AS (SELECT 'POST:/api/orders/{id}' AS endpoint_key, o_totalprice AS latency_ms, * FROM t
      UNION ALL SELECT fallback, o_totalprice / 2, * FROM t WHERE fallback IS NOT NULL)
    SELECT endpoint_key, count(*) AS n, round(sum(latency_ms), 2) AS total,
      count(*) FILTER (o_orderstatus = 'F') AS errors, count(*) FILTER (o_orderstatus = 'O') AS with_status,
      min(epoch_ms(o_orderdate)) AS first_ms FROM s GROUP BY 1"""
)
def entry_span_filter(spark, folder):
    """Entry spans of nested traces, with the summary's first endpoint as fallback."""
    return red.entry_spans(_order_traces(spark, folder)).groupBy("endpoint_key").agg(
        F.count("*").alias("n"),
        F.round(F.sum("latency_ms"), 2).alias("total"),
        F.count(F.when(F.col("is_error"), 1)).alias("errors"),
        F.count("status_code").alias("with_status"),
        F.min("ts_ms").alias("first_ms"),
    )


@query(
    r"""WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''),
      '[?#].*$', '') AS path FROM pages)
    SELECT 'GET:' || array_to_string(list_transform(string_split(path, '/'), lambda s:
      CASE WHEN regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
          THEN '{uuid}'
        WHEN regexp_matches(s, '^[0-9]+$') THEN '{id}'
        WHEN regexp_matches(s, '^$|^[a-z]+(_[a-z0-9]+)*$|^[a-z]+([A-Z][a-z0-9]*)+$') THEN s
        ELSE '{param}' END), '/') AS endpoint_key, count(*) AS n
    FROM p GROUP BY 1"""
)
def url_normalize(spark, folder):
    """Pages per endpoint key of their URL."""
    key = S.endpoint_key(F.lit("get"), F.col("url")).alias("endpoint_key")
    return A.table(spark, folder, "pages").groupBy(key).agg(F.count("*").alias("n"))


@query(
    f"""WITH {Q.EV} SELECT {Q.bucket("ts_ms // 1000 * 1000", 15_000)} AS timestamp_window_ms,
    count(*) AS n FROM ev GROUP BY 1"""
)
def iso_to_window(spark, folder):
    """Events per 15 s window after a round trip through ISO text."""
    text = S.ms_to_iso(F.col("ts_ms"))
    window = S.bucket(S.iso_to_ms(text), K.WINDOW_MS).alias("timestamp_window_ms")
    return A.events(spark, folder).groupBy(window).agg(F.count("*").alias("n"))


CELL_SQL = f"""{Q.EV}, {Q.CASES}, seen AS (SELECT DISTINCT case_id, endpoint_key,
  {Q.bucket("ts_ms", SIX_HOURS)} AS timestamp_window_ms FROM ev)"""


def _seen_cells(spark, folder) -> DataFrame:
    window = S.bucket(F.col("ts_ms"), SIX_HOURS).alias("timestamp_window_ms")
    return A.events(spark, folder).select("case_id", "endpoint_key", window).distinct()


@query(
    f"""WITH {CELL_SQL} SELECT {CELL},
    strftime(make_timestamp(timestamp_window_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS window_str,
    case_id || '__' || endpoint_key || '__' || timestamp_window_ms AS sample_id FROM seen"""
)
def identity_columns(spark, folder):
    """Window text and sample id of every cell."""
    return labels.with_identity(_seen_cells(spark, folder))


@query(
    f"""WITH {CELL_SQL} SELECT {CELL}, {Q.PHASE} AS phase, {Q.PHASE} = 'inject' AS is_anomaly,
    {Q.PHASE} <> 'inject' AS is_train_eligible, inject_start_ms AS injection_start_ms,
    inject_end_ms AS injection_end_ms, target_service, anomaly_type, anomaly_level
    FROM seen LEFT JOIN cases USING (case_id)"""
)
def phase_labels(spark, folder):
    """The eight label columns of every cell."""
    return labels.with_labels(_seen_cells(spark, folder), A.cases(spark))


@query(
    f"""WITH {CELL_SQL}, phased AS (SELECT case_id, {Q.PHASE} AS phase FROM seen LEFT JOIN cases USING (case_id))
    SELECT case_id, count(*) FILTER (phase = 'normal') AS normal, count(*) FILTER (phase = 'baseline') AS baseline,
    count(*) FILTER (phase = 'inject') AS inject, count(*) FILTER (phase = 'recover') AS recover,
    count(*) AS total FROM phased GROUP BY 1"""
)
def phase_counts(spark, folder):
    """Cells per case and phase."""
    return labels.phase_counts(labels.with_labels(_seen_cells(spark, folder), A.cases(spark)))


@query(
    f"""WITH {Q.EV} SELECT CASE WHEN case_id LIKE 'Normal%' THEN 'Normal'
    WHEN case_id LIKE 'Lv\\_P\\_%' ESCAPE '\\' THEN 'Performance'
    WHEN case_id LIKE 'Lv\\_S\\_%' ESCAPE '\\' THEN 'Service'
    WHEN case_id LIKE 'Lv\\_D\\_%' ESCAPE '\\' THEN 'Database'
    WHEN case_id LIKE 'Lv\\_C\\_%' ESCAPE '\\' THEN 'Code' END AS family, count(*) AS n FROM ev GROUP BY 1"""
)
def anomaly_family(spark, folder):
    """Events per fault family of their case name."""
    family = S.anomaly_family(F.col("case_id")).alias("family")
    return A.events(spark, folder).groupBy(family).agg(F.count("*").alias("n"))


@query(
    f"""WITH {CELL_SQL} SELECT case_id, min(timestamp_window_ms) AS start_ms,
    max(timestamp_window_ms) AS end_ms FROM seen GROUP BY 1"""
)
def case_window_bounds(spark, folder):
    """First and last window of each case."""
    return red.case_bounds(_seen_cells(spark, folder))


@query(
    f"""WITH {Q.red(SIX_HOURS)}, cells AS (
      SELECT case_id, endpoint_key, timestamp_window_ms, sum(t) AS t, sum(c) AS c FROM (
        SELECT case_id, endpoint_key, timestamp_window_ms, 1 AS t, 0 AS c FROM trace
        UNION ALL SELECT case_id, endpoint_key, timestamp_window_ms, 0, 1 FROM client) GROUP BY ALL)
    SELECT case_id, count(*) FILTER (t > 0) AS trace_cells, count(*) FILTER (c > 0) AS client_cells,
      count(*) FILTER (t > 0 AND c > 0) AS fused_cells,
      CAST(sum(greatest(t - 1, 0) + greatest(c - 1, 0)) AS BIGINT) AS repeated_keys,
      round(count(*) FILTER (t > 0 AND c > 0) / nullif(count(*) FILTER (c > 0), 0), 6) AS hit_rate
    FROM cells GROUP BY 1"""
)
def fused_one_to_one(spark, folder):
    """Per case: cells on each side and on both, repeated keys and the hit rate of the join."""
    return rounded(red.fuse_report(*red_tables(spark, folder, SIX_HOURS)))


@query(
    f"""WITH {Q.red(SIX_HOURS)} SELECT {CELL}, trace_request_count, {Q.rounds(TRACE_RATES)},
    request_count AS client_request_count, round(error_rate, 6) AS client_error_rate,
    round(status_2xx_rate, 6) AS client_2xx_rate, round(status_4xx_rate, 6) AS client_4xx_rate
    FROM trace JOIN client USING (case_id, endpoint_key, timestamp_window_ms)"""
)
def fused_table(spark, folder):
    """Server RED with the client columns of the same cell."""
    return rounded(red.fuse(*red_tables(spark, folder, SIX_HOURS)))


MAD_SQL = f"""{Q.EV}, {Q.SPANS}, {Q.trace_cells(A.DAY_MS)},
normal AS (SELECT * FROM trace WHERE case_id LIKE 'Normal%'),
medians AS (SELECT endpoint_key, quantile_cont(trace_latency_p95, 0.5) AS p95_median FROM normal GROUP BY 1),
mads AS (SELECT endpoint_key, quantile_cont(abs(trace_latency_p95 - p95_median), 0.5) AS p95_mad
  FROM normal JOIN medians USING (endpoint_key) GROUP BY 1),
means AS (SELECT endpoint_key, avg(trace_error_rate) + 0.1e0 AS error_threshold,
  avg(trace_5xx_rate) + 0.1e0 AS s5xx_threshold FROM normal GROUP BY 1),
base AS (SELECT *, CASE WHEN p95_mad = 0 THEN p95_median * 1.1e0 ELSE p95_median + 3 * p95_mad END AS latency_threshold
  FROM means LEFT JOIN medians USING (endpoint_key) LEFT JOIN mads USING (endpoint_key))"""
BASE_COLUMNS = ["error_threshold", "s5xx_threshold", "p95_median", "p95_mad", "latency_threshold"]


def _baseline(spark, folder) -> tuple[DataFrame, DataFrame]:
    trace = stage(red.trace_red(A.spans(spark, folder), A.DAY_MS), "trace-red")
    return trace, stage(labels.mad_baseline(trace.where(S.is_normal(F.col("case_id")))), "baseline")


@query(f"WITH {MAD_SQL} SELECT endpoint_key, {Q.rounds(BASE_COLUMNS)} FROM base")
def mad_baseline(spark, folder):
    """Thresholds per endpoint from Normal windows."""
    return rounded(_baseline(spark, folder)[1])


def _signals(base: str) -> str:
    """Statement with the weak labels by the baseline ``base``, which may lack endpoints or be empty."""
    return f"""WITH {MAD_SQL}, known AS ({base}), any_known AS (SELECT count(*) > 0 AS b FROM known), signals AS (
      SELECT t.*, b, CASE WHEN b AND trace_latency_p95 > latency_threshold THEN 1 ELSE 0 END AS latency_anomaly_signal,
        CASE WHEN b AND trace_error_rate > error_threshold THEN 1 ELSE 0 END AS error_anomaly_signal,
        CASE WHEN b AND trace_5xx_rate > CASE WHEN k.endpoint_key IS NULL THEN 0.4e0 ELSE s5xx_threshold END
          THEN 1 ELSE 0 END AS s5
      FROM trace t LEFT JOIN known k USING (endpoint_key), any_known)
    SELECT {CELL}, latency_anomaly_signal, error_anomaly_signal, s5 AS "5xx_anomaly_signal",
      CASE WHEN latency_anomaly_signal + error_anomaly_signal + s5 > 0 THEN 1 ELSE 0 END AS weak_is_anomaly,
      CASE WHEN NOT b THEN 'unknown' ELSE CASE latency_anomaly_signal + error_anomaly_signal + s5 WHEN 3 THEN 'high'
        WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'normal' END END AS label_confidence
    FROM signals"""


def _labelled(trace: DataFrame, baseline: DataFrame) -> DataFrame:
    signals = ["latency_anomaly_signal", "error_anomaly_signal", "5xx_anomaly_signal"]
    labelled = labels.weak_labels(trace, baseline)
    return labelled.select(*red.CELL, *signals, "weak_is_anomaly", "label_confidence")


@query(_signals("FROM base"))
def weak_labels(spark, folder):
    """Three threshold signals per cell with their confidence."""
    return _labelled(*_baseline(spark, folder))


@query(_signals("FROM base WHERE endpoint_key NOT IN ('POST:/api/v1/purchase', 'POST:/api/v1/error')"))
def weak_labels_partial(spark, folder):
    """The same signals where two endpoints have no baseline."""
    trace, baseline = _baseline(spark, folder)
    without = ["POST:/api/v1/purchase", "POST:/api/v1/error"]
    return _labelled(trace, baseline.where(~F.col("endpoint_key").isin(without)))


@query(_signals("FROM base WHERE endpoint_key IS NULL"))
def weak_labels_unknown(spark, folder):
    """The same signals without any baseline: nothing is known."""
    trace, baseline = _baseline(spark, folder)
    return _labelled(trace, baseline.where(F.col("endpoint_key").isNull()))


SIZES = (A.HOUR_MS, 3 * A.HOUR_MS, SIX_HOURS, A.DAY_MS)


@query(
    f"""WITH {Q.EV}, {Q.SPANS}, sizes AS (SELECT unnest([{", ".join(map(str, SIZES))}]) AS w),
    cells AS (SELECT CAST(w AS BIGINT) AS window_ms, case_id, endpoint_key,
      floor(ts_ms / w) AS cell, count(*) AS n FROM spans, sizes GROUP BY ALL)
    SELECT window_ms, count(*) AS cells, round(avg(CASE WHEN n < 5 THEN 1 ELSE 0 END), 6) AS p95_null_rate,
      CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_requests FROM cells GROUP BY 1"""
)
def window_density(spark, folder):
    """Share of cells without a p95 and median request count per window size."""
    return rounded(red.window_density(A.spans(spark, folder), SIZES))
