"""Fixed values that results depend on."""

WINDOW_MS = 15_000

# Endpoint to service.
ENDPOINT_SERVICES = {
    "POST:/api/v1/preserveservice/preserve": "ts-preserve-service",
    "POST:/api/v1/orderservice/order/refresh": "ts-order-service",
    "POST:/api/v1/travelservice/trips/left": "ts-travel-service",
    "POST:/api/v1/travel2service/trips/left": "ts-travel2-service",
    "POST:/api/v1/travelplanservice/travelPlan/cheapest": "ts-travel-plan-service",
    "POST:/api/v1/travelplanservice/travelPlan/minStation": "ts-travel-plan-service",
    "POST:/api/v1/travelplanservice/travelPlan/quickest": "ts-travel-plan-service",
    "GET:/api/v1/routeservice/routes": "ts-route-service",
}

# Columns of the wide table.
ID_COLUMNS = [
    "sample_id",
    "case_id",
    "endpoint_key",
    "service_name",
    "timestamp_window_ms",
    "window_str",
]
LABEL_COLUMNS = [
    "phase",
    "is_anomaly",
    "is_train_eligible",
    "injection_start_ms",
    "injection_end_ms",
    "target_service",
    "anomaly_type",
    "anomaly_level",
]
ENDPOINT_FEATURES = [
    "trace_request_count",
    "trace_latency_p50",
    "trace_latency_p95",
    "trace_error_rate",
    "trace_5xx_rate",
    "client_request_count",
    "client_latency_p95",
    "client_error_rate",
    "client_5xx_rate",
    "latency_divergence",
]
METRIC_FEATURES = [
    "cpu_usage_rate",
    "memory_usage_ratio",
    "net_rx_error_rate",
    "net_tx_error_rate",
    "process_count",
]
LOG_FEATURES = ["event_rate", "error_ratio", "template_diversity"]
RATE_COLUMNS = [
    "endpoint_red__trace_error_rate",
    "endpoint_red__trace_5xx_rate",
    "endpoint_red__client_error_rate",
    "endpoint_red__client_5xx_rate",
    "service_metric__cpu_usage_rate",
    "service_metric__memory_usage_ratio",
    "service_metric__net_rx_error_rate",
    "service_metric__net_tx_error_rate",
    "service_log__event_rate",
    "service_log__error_ratio",
]

# Metric names of the long metric export.
CPU_COUNTER = "container_cpu_usage_seconds_total"
MEMORY_USAGE = "container_memory_usage_bytes"
MEMORY_LIMIT = "container_spec_memory_limit_bytes"
PROCESSES = "container_processes"
NET_RX_ERRORS = "container_network_receive_errors_total"
NET_TX_ERRORS = "container_network_transmit_errors_total"
POD_METRICS = [CPU_COUNTER, MEMORY_USAGE, MEMORY_LIMIT, PROCESSES]
HOST_METRICS = [NET_RX_ERRORS, NET_TX_ERRORS]

# Log line and pod name formats.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+([A-Z]+)\s+\d+\s+---"
POD_SUFFIX = r"-[a-z0-9]{6,10}-[a-z0-9]{5}$"
ERROR_LEVELS = ["ERROR", "FATAL"]
# Fixed value: the share of equal tokens at which the public template miner puts a line to a template.
TEMPLATE_SIMILARITY = 0.4
LOG_TIMEZONE = "Asia/Shanghai"

# Endpoint names of spans and the parts of a path.
ENTRY_ENDPOINT = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS):(/.*)"
UUID_SEGMENT = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Line types, first match wins; every other line is OTHER.
LINE_TYPES = [
    ("DEBUG", r"DEBUG"),
    ("INFO", r"INFO"),
    ("WARN", r"WARN"),
    ("ERROR", r"ERROR"),
    ("STACKTRACE", r"at\s+[\w\.$/_-]+\.[^(]+\([^)]*\)"),
    ("EXCEPTION", r"[\w\.]+Exception:"),
]

# File names that are expected to be empty.
EXPECTED_EMPTY = [
    "jaeger-container.log",
    "light-oauth2-mysqldb-1.log",
    "light-oauth2-node_exporter-1.log",
    "light-oauth2-prometheus-1.log",
    "traces_jaeger-all-in-one.csv",
    "traces_oauth2-client-service.csv",
    "traces_oauth2-code-service.csv",
    "traces_oauth2-key-service.csv",
    "traces_oauth2-refresh-token-service.csv",
    "traces_oauth2-service-service.csv",
    "traces_oauth2-token-service.csv",
    "traces_oauth2-user-service.csv",
]
HEADER_ONLY_CSV_BYTES = 58

# Service logs that are trimmed.
TRIMMED_LOGS = [
    "light-oauth2-oauth2-client-1.log",
    "light-oauth2-oauth2-code-1.log",
    "light-oauth2-oauth2-key-1.log",
    "light-oauth2-oauth2-refresh-token-1.log",
    "light-oauth2-oauth2-service-1.log",
    "light-oauth2-oauth2-token-1.log",
    "light-oauth2-oauth2-user-1.log",
]
RUN_FOLDER = "light-oauth2-data-"
SERVICE_LOG_PREFIX = "light-oauth2-oauth2-"
