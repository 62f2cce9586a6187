"""Common table expressions shared by the oracle statements.

They restate the table mapping and the wide table in plain SQL over the same parquet tables.
"""

from __future__ import annotations

from windowguard import constants as K
from windowguard.sources.tables import CASE_COLUMNS, CASE_ROWS, DAY_MS

EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    CASE user_id % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Lv_P_slow'
      WHEN 2 THEN 'Lv_S_kill' ELSE 'Lv_D_pool' END AS case_id,
    'POST:/api/v1/' || event_type AS endpoint_key,
    CASE event_type WHEN 'click' THEN 'svc-shop' WHEN 'view' THEN 'svc-shop'
      WHEN 'purchase' THEN 'svc-order' WHEN 'signup' THEN 'svc-user'
      ELSE 'svc-other' END AS service_name
  FROM events)"""

STATUS = "CASE WHEN k >= 95 THEN 500 WHEN k >= 85 THEN 404 ELSE 200 END"

CLIENTS = f"""
clients AS (
  SELECT case_id, endpoint_key, ts_ms, value AS latency_ms, {STATUS} AS status_code FROM ev)"""

SPANS = f"""
spans AS (
  SELECT case_id, endpoint_key, ts_ms + k * 1000 AS ts_ms, value * 0.8e0 AS latency_ms,
    k >= 90 AS is_error, CASE WHEN k >= 30 THEN {STATUS} END AS status_code
  FROM ev)"""

CASES = f"""
cases AS (SELECT * FROM (VALUES {CASE_ROWS}) AS t({CASE_COLUMNS}))"""


def bucket(ms: str, window: int) -> str:
    return f"CAST(floor({ms} / {window}) * {window} AS BIGINT)"


def _gated(column: str, q: float, least: int) -> str:
    return f"CASE WHEN count({column}) >= {least} THEN quantile_cont({column}, {q}) END"


def _share(condition: str, of: str = "count(*)") -> str:
    return f"count(*) FILTER ({condition}) / nullif({of}, 0)"


def trace_cells(window: int) -> str:
    status = "count(status_code)"
    return f"""
trace AS (
  SELECT case_id, endpoint_key, {bucket("ts_ms", window)} AS timestamp_window_ms,
    count(*) AS trace_request_count,
    avg(latency_ms) AS trace_latency_mean,
    {_gated("latency_ms", 0.5, 2)} AS trace_latency_p50,
    {_gated("latency_ms", 0.95, 5)} AS trace_latency_p95,
    {_gated("latency_ms", 0.99, 5)} AS trace_latency_p99,
    {_share("is_error")} AS trace_error_rate,
    {_share("status_code BETWEEN 500 AND 599", status)} AS trace_5xx_rate,
    {_share("status_code BETWEEN 400 AND 499", status)} AS trace_4xx_rate,
    count(status_code) / count(*) AS trace_status_coverage
  FROM spans GROUP BY ALL)"""


def client_cells(window: int) -> str:
    return f"""
client AS (
  SELECT case_id, endpoint_key, {bucket("ts_ms", window)} AS timestamp_window_ms,
    count(*) AS request_count,
    {_share("status_code >= 400")} AS error_rate,
    avg(latency_ms) AS latency_mean,
    {_gated("latency_ms", 0.5, 2)} AS latency_p50,
    {_gated("latency_ms", 0.95, 5)} AS latency_p95,
    {_gated("latency_ms", 0.99, 5)} AS latency_p99,
    {_share("status_code BETWEEN 200 AND 299")} AS status_2xx_rate,
    {_share("status_code BETWEEN 400 AND 499")} AS status_4xx_rate,
    {_share("status_code BETWEEN 500 AND 599")} AS status_5xx_rate
  FROM clients GROUP BY ALL)"""


def red(window: int) -> str:
    """Both RED tables of one window size."""
    return ",".join([EV, CLIENTS, SPANS, trace_cells(window), client_cells(window)])


ENDPOINT_LIST = "('POST:/api/v1/click','POST:/api/v1/view','POST:/api/v1/purchase','POST:/api/v1/signup')"
SERVICE_OF_ENDPOINT = """CASE endpoint_key WHEN 'POST:/api/v1/click' THEN 'svc-shop'
  WHEN 'POST:/api/v1/view' THEN 'svc-shop' WHEN 'POST:/api/v1/purchase' THEN 'svc-order'
  WHEN 'POST:/api/v1/signup' THEN 'svc-user' END"""

CELLS = f"""
cells AS (
  SELECT t.case_id, t.endpoint_key, t.timestamp_window_ms,
    CAST(trace_request_count AS DOUBLE) AS endpoint_red__trace_request_count,
    trace_latency_p50 AS endpoint_red__trace_latency_p50,
    trace_latency_p95 AS endpoint_red__trace_latency_p95,
    trace_error_rate AS endpoint_red__trace_error_rate,
    trace_5xx_rate AS endpoint_red__trace_5xx_rate,
    CAST(request_count AS DOUBLE) AS endpoint_red__client_request_count,
    latency_p95 AS endpoint_red__client_latency_p95,
    error_rate AS endpoint_red__client_error_rate,
    status_5xx_rate AS endpoint_red__client_5xx_rate,
    latency_p95 - trace_latency_p95 AS endpoint_red__latency_divergence
  FROM trace t JOIN client c USING (case_id, endpoint_key, timestamp_window_ms)
  WHERE endpoint_key IN {ENDPOINT_LIST})"""

BOUNDS = """
bounds AS (
  SELECT case_id, min(timestamp_window_ms) AS start_ms, max(timestamp_window_ms) AS end_ms
  FROM cells GROUP BY 1)"""

POD = "service_name || '-abcdef1-' || lpad(CAST(user_id % 3 AS VARCHAR), 5, '0')"
REPORTS = f"""
samples AS (
  SELECT case_id, 'container_cpu_usage_seconds_total' AS metric_name, ts_ms / 1000e0 AS ts,
    event_id * 40e0 AS value, {POD} AS pod FROM ev
  UNION ALL SELECT case_id, 'container_memory_usage_bytes', ts_ms / 1000e0, value * 10e0 + 100, {POD} FROM ev
  UNION ALL SELECT case_id, 'container_spec_memory_limit_bytes', ts_ms / 1000e0,
    CASE WHEN k < 50 THEN 0e0 ELSE 2000e0 END, {POD} FROM ev
  UNION ALL SELECT case_id, 'container_processes', ts_ms / 1000e0, CAST(k AS DOUBLE), {POD} FROM ev
  UNION ALL SELECT case_id, 'container_network_receive_errors_total', ts_ms / 1000e0, event_id * 3e0, NULL FROM ev
  UNION ALL SELECT case_id, 'container_network_transmit_errors_total', ts_ms / 1000e0, event_id * 5e0, NULL FROM ev)"""

LINEITEM_POD = (
    "'svc' || CAST(l_suppkey % 5 AS VARCHAR) || '-abcdef1-' || lpad(CAST(l_suppkey % 7 AS VARCHAR), 5, '0')"
)
LINEITEM_SAMPLES = f"""
samples AS (
  SELECT 'case' || l_returnflag AS case_id,
    CASE l_linenumber WHEN 1 THEN 'container_cpu_usage_seconds_total'
      WHEN 2 THEN 'container_memory_usage_bytes' WHEN 3 THEN 'container_spec_memory_limit_bytes'
      WHEN 4 THEN 'container_processes' WHEN 5 THEN 'container_network_receive_errors_total'
      WHEN 6 THEN 'container_network_transmit_errors_total'
      WHEN 7 THEN 'container_fs_reads_total' END AS metric_name,
    epoch_ms(l_shipdate) / 1000e0 AS ts, l_extendedprice AS value,
    CASE WHEN l_linenumber <= 4 THEN {LINEITEM_POD} END AS pod,
    CASE WHEN l_linenumber > 4 THEN 'eth' || l_linestatus END AS interface
  FROM lineitem)"""


def metric_tables(source: str, services: str, window: int) -> str:
    """Pod windows, rates and service features over ``source`` (a samples relation)."""
    ms = bucket("CAST(trunc(ts) AS BIGINT) * 1000", window)
    seconds = window / 1000
    return f"""
pods AS (
  SELECT case_id, regexp_replace(pod, '-[a-z0-9]{{6,10}}-[a-z0-9]{{5}}$', '') AS service_name, pod,
    {ms} AS timestamp_window_ms,
    avg(value) FILTER (metric_name = 'container_cpu_usage_seconds_total') AS cpu,
    avg(value) FILTER (metric_name = 'container_memory_usage_bytes') AS memory,
    avg(value) FILTER (metric_name = 'container_spec_memory_limit_bytes') AS memory_limit,
    avg(value) FILTER (metric_name = 'container_processes') AS processes
  FROM {source}
  WHERE metric_name IN ('container_cpu_usage_seconds_total', 'container_memory_usage_bytes',
      'container_spec_memory_limit_bytes', 'container_processes')
    AND pod IS NOT NULL AND pod <> ''
    AND regexp_replace(pod, '-[a-z0-9]{{6,10}}-[a-z0-9]{{5}}$', '') IN {services}
  GROUP BY ALL),
pod_rates AS (
  SELECT *, coalesce(greatest((cpu - lag(cpu) OVER (PARTITION BY case_id, pod
      ORDER BY timestamp_window_ms)) / {seconds}e0, 0), 0) AS cpu_rate,
    coalesce(CASE WHEN memory_limit > 0 THEN least(greatest(memory / memory_limit, 0), 1) END, 0) AS memory_ratio
  FROM pods),
pod_service AS (
  SELECT case_id, service_name, timestamp_window_ms,
    avg(cpu_rate) AS service_metric__cpu_usage_rate,
    avg(memory_ratio) AS service_metric__memory_usage_ratio,
    avg(processes) AS service_metric__process_count
  FROM pod_rates GROUP BY ALL),
host_sums AS (
  SELECT case_id, metric_name, {ms} AS timestamp_window_ms, sum(value) AS total
  FROM {source}
  WHERE metric_name IN ('container_network_receive_errors_total', 'container_network_transmit_errors_total')
  GROUP BY ALL),
host_steps AS (
  SELECT *, coalesce(greatest((total - lag(total) OVER (PARTITION BY case_id, metric_name
    ORDER BY timestamp_window_ms)) / {seconds}e0, 0), 0) AS rate FROM host_sums),
host AS (
  SELECT case_id, timestamp_window_ms,
    coalesce(max(rate) FILTER (metric_name = 'container_network_receive_errors_total'), 0) AS rx,
    coalesce(max(rate) FILTER (metric_name = 'container_network_transmit_errors_total'), 0) AS tx
  FROM host_steps GROUP BY ALL),
has_processes AS (
  SELECT case_id, count(service_metric__process_count) > 0 AS present FROM pod_service GROUP BY 1),
service_features AS (
  SELECT p.case_id, p.service_name, p.timestamp_window_ms, service_metric__cpu_usage_rate,
    service_metric__memory_usage_ratio,
    coalesce(h.rx, 0) AS service_metric__net_rx_error_rate,
    coalesce(h.tx, 0) AS service_metric__net_tx_error_rate,
    CASE WHEN present THEN service_metric__process_count ELSE 0 END AS service_metric__process_count
  FROM pod_service p JOIN has_processes USING (case_id)
  LEFT JOIN host h USING (case_id, timestamp_window_ms))"""


LINES = """
lines AS (
  SELECT case_id, service_name, event_id, event_type, ts_ms,
    strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') || '  ' ||
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
      WHEN 'purchase' THEN 'FATAL' ELSE 'INFO' END ||
    ' 1 --- [' || event_type || '] app.Main : ' ||
    CASE WHEN case_id <> 'Normal' AND k >= 95 THEN 'broken pipe after ' || k || ' of ' || event_type
      WHEN event_type = 'purchase' AND k < 30 THEN 'at app.Pay.run(Pay.java:' || k || ')'
      WHEN event_type = 'purchase' AND k < 60 THEN 'java.io.IOException: lost ' || k
      WHEN event_type = 'purchase' THEN 'payment ' || k
      ELSE event_type || ' by ' || user_id || ' took ' || k END AS line
  FROM ev)"""

LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+([A-Z]+)\s+\d+\s+---"


def parsed_lines(offset_hours: int) -> str:
    """Parsed log lines whose clock runs ``offset_hours`` ahead of UTC."""
    shift = offset_hours * 3_600_000
    return f"""
parsed AS (
  SELECT case_id, service_name, event_id,
    epoch_ms(strptime(regexp_extract(line, '{LOG_LINE}', 1), '%Y-%m-%d %H:%M:%S.%g')) - {shift} AS ts_ms,
    regexp_extract(line, '{LOG_LINE}', 2) AS level,
    trim(regexp_replace(line, '{LOG_LINE}', '')) AS content
  FROM lines WHERE regexp_matches(line, '{LOG_LINE}'))"""


def keyed(source: str, name: str) -> str:
    return f"""
{name}_tokens AS (
  SELECT *, list_transform(list_filter(regexp_split_to_array(content, '\\s+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM {source}),
{name} AS (
  SELECT *, CAST(len(tokens) AS INT) AS n_tokens, coalesce(tokens[1], '') AS first_token FROM {name}_tokens)"""


def templates_of(source: str) -> str:
    """Template table fitted on the contents of ``source``."""
    return (
        f"""
fit_contents AS (SELECT DISTINCT content FROM {source}),"""
        + keyed("fit_contents", "fit_keyed")
        + """,
fit_lines AS (SELECT *, row_number() OVER (ORDER BY n_tokens, tokens) AS id FROM (SELECT DISTINCT n_tokens, first_token, tokens FROM fit_keyed)),
fit_links AS (
  SELECT a.id, b.id AS other FROM fit_lines a JOIN fit_lines b USING (n_tokens, first_token)
  WHERE a.id <> b.id AND len(list_filter(list_zip(a.tokens, b.tokens), lambda p: p[1] = p[2] AND p[1] <> '<*>'))
    >= ceil({similarity} * n_tokens - 1e-9)),
fit_roots AS (
  WITH RECURSIVE reach AS (
    SELECT id, id AS other FROM fit_lines UNION SELECT r.id, l.other FROM reach r JOIN fit_links l ON r.other = l.id)
  SELECT id, min(other) AS root FROM reach GROUP BY 1),
fit_positions AS (
  SELECT n_tokens, first_token, root, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS position
  FROM fit_lines JOIN fit_roots USING (id)),
fit_reduced AS (
  SELECT n_tokens, first_token, root, position,
    CASE WHEN min(token) = max(token) THEN min(token) ELSE '<*>' END AS token
  FROM fit_positions GROUP BY ALL),
templates AS (
  SELECT DISTINCT n_tokens, first_token, string_agg(token, ' ' ORDER BY position) AS template,
    md5(string_agg(token, ' ' ORDER BY position)) AS template_id
  FROM fit_reduced GROUP BY n_tokens, first_token, root)""".replace("{similarity}", str(K.TEMPLATE_SIMILARITY))
    )


MATCHED = (
    keyed("parsed", "line_keyed")
    + """,
fitting AS (
  SELECT n_tokens, tokens, arg_min(template_id, (-len(list_filter(words, lambda w: w <> '<*>')), template_id)) AS template_id
  FROM (SELECT DISTINCT n_tokens, first_token, tokens FROM line_keyed) JOIN (SELECT *, string_split(template, ' ') AS words FROM templates) USING (n_tokens, first_token)
  WHERE n_tokens = 0 OR list_bool_and(list_transform(list_zip(tokens, words), lambda p: p[2] = '<*>' OR p[1] = p[2]))
  GROUP BY ALL),
matched AS (
  SELECT l.*, coalesce(f.template_id, '-1') AS template_id
  FROM line_keyed l LEFT JOIN fitting f USING (n_tokens, tokens))"""
)


def log_tables(window: int) -> str:
    return f"""
log_counts AS (
  SELECT case_id, service_name, {bucket("ts_ms", window)} AS timestamp_window_ms,
    count(*) AS event_count, count(*) FILTER (level IN ('ERROR', 'FATAL')) AS error_count,
    count(DISTINCT template_id) AS unique_templates
  FROM matched GROUP BY ALL),
log_grid AS (
  SELECT case_id, service_name,
    unnest(range(min(timestamp_window_ms), max(timestamp_window_ms) + {window}, {window})) AS timestamp_window_ms
  FROM log_counts GROUP BY 1, 2),
log_windows AS (
  SELECT case_id, service_name, timestamp_window_ms,
    CAST(coalesce(event_count, 0) AS DOUBLE) AS service_log__event_rate,
    coalesce(error_count / nullif(event_count, 0), 0) AS service_log__error_ratio,
    coalesce(unique_templates / nullif(event_count, 0), 0) AS service_log__template_diversity
  FROM log_grid LEFT JOIN log_counts USING (case_id, service_name, timestamp_window_ms))"""


LOG_CHAIN = ",".join(
    [LINES, parsed_lines(0), "\nnormal_parsed AS (SELECT * FROM parsed WHERE case_id = 'Normal')"]
    + [templates_of("normal_parsed"), MATCHED]
)

FEATURES = [
    "endpoint_red__trace_request_count",
    "endpoint_red__trace_latency_p50",
    "endpoint_red__trace_latency_p95",
    "endpoint_red__trace_error_rate",
    "endpoint_red__trace_5xx_rate",
    "endpoint_red__client_request_count",
    "endpoint_red__client_latency_p95",
    "endpoint_red__client_error_rate",
    "endpoint_red__client_5xx_rate",
    "endpoint_red__latency_divergence",
    "service_metric__cpu_usage_rate",
    "service_metric__memory_usage_ratio",
    "service_metric__net_rx_error_rate",
    "service_metric__net_tx_error_rate",
    "service_metric__process_count",
    "service_log__event_rate",
    "service_log__error_ratio",
    "service_log__template_diversity",
]
RATES = [f for f in FEATURES if f.rsplit("_", 1)[-1] in ("rate", "ratio")]

PHASE = """CASE WHEN inject_start_ms IS NULL OR inject_end_ms IS NULL THEN 'normal'
  WHEN timestamp_window_ms > inject_end_ms THEN 'recover'
  WHEN timestamp_window_ms >= inject_start_ms THEN 'inject' ELSE 'baseline' END"""

WIDE_WINDOW = DAY_MS

KEPT_SAMPLES = """
kept_samples AS (
  SELECT s.* FROM samples s JOIN bounds b USING (case_id)
  WHERE s.ts >= b.start_ms / 1000e0 AND s.ts <= b.end_ms / 1000e0)"""

WIDE = ",".join(
    [
        red(WIDE_WINDOW),
        CASES,
        CELLS,
        BOUNDS,
        REPORTS,
        KEPT_SAMPLES,
        metric_tables("kept_samples", "('svc-order', 'svc-shop', 'svc-user')", WIDE_WINDOW),
        LOG_CHAIN,
        log_tables(WIDE_WINDOW),
        f"""
on_service AS (SELECT *, {SERVICE_OF_ENDPOINT} AS service_name FROM cells),
joined AS (
  SELECT * FROM on_service
  LEFT JOIN service_features USING (case_id, service_name, timestamp_window_ms)
  LEFT JOIN log_windows USING (case_id, service_name, timestamp_window_ms)
  LEFT JOIN cases USING (case_id)),
wide AS (
  SELECT case_id || '__' || endpoint_key || '__' || timestamp_window_ms AS sample_id,
    case_id, endpoint_key, service_name, timestamp_window_ms,
    strftime(make_timestamp(timestamp_window_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS window_str,
    {", ".join(FEATURES)},
    {PHASE} AS phase, {PHASE} = 'inject' AS is_anomaly, {PHASE} <> 'inject' AS is_train_eligible,
    inject_start_ms AS injection_start_ms, inject_end_ms AS injection_end_ms,
    target_service, anomaly_type, anomaly_level
  FROM joined)""",
    ]
)


def _minmax(feature: str) -> str:
    group = "endpoint_key" if feature.startswith("endpoint_red") else "service_name"
    table = "e" if group == "endpoint_key" else "s"
    value = f"w.{feature}"
    scaled = f"({value} - {table}.lo_{feature}) / greatest({table}.hi_{feature} - {table}.lo_{feature}, 1e-9)"
    value = f"CASE WHEN {table}.{group} IS NULL THEN {value} ELSE {scaled} END"
    if feature in RATES:
        return f"CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, 0), 1) END AS {feature}"
    return f"{value} AS {feature}"


def _ranges(prefix: tuple[str, ...]) -> str:
    picked = [f for f in FEATURES if f.startswith(prefix)]
    return ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in picked)


NORMALIZED = (
    WIDE
    + f""",
ends AS (SELECT endpoint_key, {_ranges(("endpoint_red",))} FROM wide WHERE anomaly_type LIKE 'Normal%' GROUP BY 1),
svcs AS (SELECT service_name, {_ranges(("service_",))} FROM wide WHERE anomaly_type LIKE 'Normal%' GROUP BY 1),
contract AS (
  SELECT w.* REPLACE ({", ".join(_minmax(f) for f in FEATURES)})
  FROM wide w LEFT JOIN ends e ON w.endpoint_key = e.endpoint_key
  LEFT JOIN svcs s ON w.service_name = s.service_name)"""
)


def rounds(columns: list[str], digits: int = 6) -> str:
    """Rounded columns; adding 0 turns a negative zero into zero."""
    return ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns)


def imputed(strategy: str) -> str:
    """The normalised table with missing features filled."""
    if strategy == "zero":
        fills = ", ".join(f"coalesce({f}, 0) AS {f}" for f in FEATURES)
        return NORMALIZED + f",\nfilled AS (SELECT * REPLACE ({fills}) FROM contract)"
    means = ", ".join(f"coalesce(avg({f}), 0) AS m_{f}" for f in FEATURES)
    fills = ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in FEATURES)
    return (
        NORMALIZED
        + f""",
means AS (SELECT {means} FROM contract WHERE anomaly_type LIKE 'Normal%'),
filled AS (SELECT contract.* REPLACE ({fills}) FROM contract, means)"""
    )
