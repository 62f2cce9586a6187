"""Telemetry tables derived from a star schema.

Every mapping takes all rows of its tables. An event is at once a client request, the server
span of that request, an agent report of six metrics and a log line. A line item is a metric
sample of a day, a text line a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowguard import constants as K

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

CASES = ["Normal", "Lv_P_slow", "Lv_S_kill", "Lv_D_pool"]
SERVICES = {"click": "svc-shop", "view": "svc-shop", "purchase": "svc-order", "signup": "svc-user"}
ENDPOINTS = {f"POST:/api/v1/{kind}": service for kind, service in SERVICES.items()}
SERVICE_NAMES = sorted(set(SERVICES.values()))

CASE_ROWS = """
    ('Normal', 'Normal', 'none', NULL, NULL, NULL),
    ('Lv_P_slow', 'Lv_P_slow', 'performance', 'svc-shop', 1704844800000, 1705708800000),
    ('Lv_S_kill', 'Lv_S_kill', 'service', 'svc-user', 1704412800000, 1705017600000),
    ('Lv_D_pool', 'Lv_D_pool', 'database', 'svc-order', 1705276800000, NULL)"""
CASE_COLUMNS = (
    "case_id, anomaly_type, anomaly_level, target_service, inject_start_ms, inject_end_ms"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cases(spark: SparkSession) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {CASE_ROWS} AS t({CASE_COLUMNS})")
    return rows.withColumns(
        {c: F.col(c).cast("long") for c in ("inject_start_ms", "inject_end_ms")}
    )


def _service(kind: Column) -> Column:
    pairs = [F.lit(text) for pair in SERVICES.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("svc-other"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with epoch ms, the number in their properties, case, endpoint and service."""
    case_names = F.array(*[F.lit(c) for c in CASES])
    case = F.get(case_names, (F.col("user_id") % len(CASES)).cast("int"))
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"),
        case.alias("case_id"),
        F.concat(F.lit("POST:/api/v1/"), "event_type").alias("endpoint_key"),
        _service(F.col("event_type")).alias("service_name"),
    )


def _status() -> Column:
    return F.when(F.col("k") >= 95, 500).when(F.col("k") >= 85, 404).otherwise(200)


def client_requests(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "case_id",
        "endpoint_key",
        "ts_ms",
        F.col("value").alias("latency_ms"),
        _status().alias("status_code"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Server spans: k seconds after the request, 80 % of its duration, some without a status."""
    return events(spark, folder).select(
        "case_id",
        "endpoint_key",
        (F.col("ts_ms") + F.col("k") * 1000).alias("ts_ms"),
        (F.col("value") * 0.8).alias("latency_ms"),
        (F.col("k") >= 90).alias("is_error"),
        F.when(F.col("k") >= 30, _status()).alias("status_code"),
    )


def metric_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Six metric samples per event: four of its pod, two of the host."""
    ev = events(spark, folder)
    pod = F.concat(
        F.col("service_name"),
        F.lit("-abcdef1-"),
        F.lpad((F.col("user_id") % 3).cast("string"), 5, "0"),
    )

    def sample(metric: str, value: Column, of_pod: bool) -> Column:
        return F.struct(
            F.lit(metric).alias("metric_name"),
            value.cast("double").alias("value"),
            F.when(F.lit(of_pod), pod).alias("pod"),
            F.when(F.lit(not of_pod), F.lit("eth0")).alias("interface"),
        )

    number = F.col("event_id").cast("double")
    samples = F.array(
        sample(K.CPU_COUNTER, number * 40, True),
        sample(K.MEMORY_USAGE, F.col("value") * 10 + 100, True),
        sample(K.MEMORY_LIMIT, F.when(F.col("k") < 50, 0.0).otherwise(2000.0), True),
        sample(K.PROCESSES, F.col("k"), True),
        sample(K.NET_RX_ERRORS, number * 3, False),
        sample(K.NET_TX_ERRORS, number * 5, False),
    )
    return ev.select(
        "case_id", (F.col("ts_ms") / F.lit(1000.0)).alias("timestamp"), F.inline(samples)
    ).select("case_id", "metric_name", "timestamp", "value", "pod", "interface")


def lineitem_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Metric samples by ship day: seven metrics by line number, pods and hosts by supplier."""
    names = F.array(
        *[F.lit(n) for n in (*K.POD_METRICS, *K.HOST_METRICS, "container_fs_reads_total")]
    )
    metric = F.get(names, (F.col("l_linenumber") - 1).cast("int"))
    service = F.concat(F.lit("svc"), (F.col("l_suppkey") % 5).cast("string"))
    pod = F.concat(
        service, F.lit("-abcdef1-"), F.lpad((F.col("l_suppkey") % 7).cast("string"), 5, "0")
    )
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("case"), F.col("l_returnflag")).alias("case_id"),
        metric.alias("metric_name"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("double").alias("timestamp"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linenumber") <= 4, pod).alias("pod"),
        F.when(F.col("l_linenumber") > 4, F.concat(F.lit("eth"), F.col("l_linestatus"))).alias("interface"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One formatted log line per event; clock times are UTC."""
    ev = events(spark, folder)
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN")
        .when(kind == "purchase", "FATAL").otherwise("INFO")
    )
    k = F.col("k").cast("string")
    payment = (
        F.when(F.col("k") < 30, F.concat(F.lit("at app.Pay.run(Pay.java:"), k, F.lit(")")))
        .when(F.col("k") < 60, F.concat(F.lit("java.io.IOException: lost "), k))
        .otherwise(F.concat(F.lit("payment "), k))
    )
    outage = (F.col("case_id") != "Normal") & (F.col("k") >= 95)
    message = (
        F.when(outage, F.concat(F.lit("broken pipe after "), k, F.lit(" of "), kind))
        .when(kind == "purchase", payment)
        .otherwise(F.concat(kind, F.lit(" by "), F.col("user_id").cast("string"), F.lit(" took "), k))
    )
    clock = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSS")
    line = F.concat(
        clock, F.lit("  "), level, F.lit(" 1 --- ["), kind, F.lit("] app.Main : "), message
    )
    return ev.select("case_id", "service_name", "event_id", "ts_ms", line.alias("line"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all documents with their position."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def conversation_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with the words of their normalised text."""
    text = F.regexp_replace(F.lower("text"), "[0-9]+", "0")
    return table(spark, folder, "conversations").select(
        "conv_id", "role", F.split(text, " ").alias("words")
    )


def embedding_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as ``array<double>`` with the label as class 0 against the rest."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") != 0).cast("int").alias("y_true"),
    )


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scored samples: the value of an event as score, a high number as truth."""
    return events(spark, folder).select(
        F.concat_ws("__", "case_id", "endpoint_key", "event_id").alias("sample_id"),
        F.col("value").alias("score"),
        (F.col("k") >= 85).cast("int").alias("y_true"),
        F.col("case_id").alias("anomaly_type"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("anomaly_level"),
    )


def page_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as files: the URL path below a correct or error run folder, with their size."""
    run = F.when(F.col("url").contains("/en/"), "correct").otherwise("error")
    name = F.concat(
        F.regexp_extract("url", r"^[a-z]+://([^/]+)/", 1),
        F.when(F.col("url").contains("?"), ".csv").otherwise(".log"),
    )
    return table(spark, folder, "pages").select(
        F.concat(F.lit("root/run-1/"), run, F.lit("/"), name).alias("path"),
        F.length("html").cast("long").alias("size"),
    )


def line_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as files: one folder per source and document, the line length as size."""
    lines = document_lines(spark, folder)
    kind = F.when(F.col("lang") == "en", ".csv").otherwise(".log")
    path = F.concat_ws(
        "/", "source", F.col("doc_id").cast("string"), F.concat(F.lit("part"), F.col("line_no"), kind)
    )
    return lines.select(path.alias("path"), F.length("line").cast("long").alias("size"))
