"""Queries over metric samples and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import intervals, logs, metrics, red, series
from windowguard.plans import sql as Q
from windowguard.plans.endpoint_queries import red_tables
from windowguard.plans.registry import query, rounded
from windowguard.session import stage
from windowguard.sources import tables as A

HOUR = A.HOUR_MS
LINEITEM_SERVICES = [f"svc{i}" for i in range(4)]
RANGE = (820_454_400_000, 915_148_800_000)


@query(
    f"""WITH {Q.LINEITEM_SAMPLES} SELECT count(*) AS rows_kept FROM samples
    WHERE CAST(trunc(ts) AS BIGINT) * 1000 BETWEEN {RANGE[0]} AND {RANGE[1]}"""
)
def time_range_count(spark, folder):
    """Samples in an epoch-ms range, reading only the time column."""
    return metrics.count_in_range(A.lineitem_samples(spark, folder), *RANGE)


FILTERED = f"""{Q.red(A.DAY_MS)}, {Q.CELLS}, {Q.BOUNDS}, {Q.REPORTS}, {Q.KEPT_SAMPLES}"""


@query(
    f"""WITH {FILTERED} SELECT case_id, metric_name, count(*) AS n, count(pod) AS n_pod,
    round(min(ts), 3) AS first_s, round(max(ts), 3) AS last_s, round(sum(value), 2) AS total
    FROM kept_samples GROUP BY 1, 2"""
)
def metric_filter(spark, folder):
    """Samples between the first and the last joined window of their case."""
    trace, client = red_tables(spark, folder, A.DAY_MS)
    bounds = red.case_bounds(red.endpoint_features(trace, client, A.ENDPOINTS))
    kept = metrics.filter_samples(A.metric_reports(spark, folder), stage(bounds, "bounds"))
    return kept.groupBy("case_id", "metric_name").agg(
        F.count("*").alias("n"),
        F.count("pod").alias("n_pod"),
        F.round(F.min("timestamp"), 3).alias("first_s"),
        F.round(F.max("timestamp"), 3).alias("last_s"),
        F.round(F.sum("value"), 2).alias("total"),
    )


@query(
    f"""WITH {Q.LINEITEM_SAMPLES} SELECT case_id, pod,
    {Q.bucket("CAST(trunc(ts) AS BIGINT) * 1000", A.DAY_MS)} AS timestamp_window_ms,
    {", ".join(f"round(avg(value) FILTER (metric_name = '{m}'), 6) AS {m}" for m in K.POD_METRICS)}
    FROM samples WHERE pod IS NOT NULL GROUP BY 1, 2, 3"""
)
def metric_pivot(spark, folder):
    """Daily means per pod, one column per metric."""
    return rounded(metrics.metric_pivot(A.lineitem_samples(spark, folder), K.POD_METRICS, A.DAY_MS))


SERVICE_SQL = (
    f"{Q.LINEITEM_SAMPLES}, "
    + Q.metric_tables("samples", "('svc0', 'svc1', 'svc2', 'svc3')", A.DAY_MS)
)


@query(
    f"""WITH {SERVICE_SQL} SELECT case_id, service_name, timestamp_window_ms,
    {Q.rounds(["service_metric__" + f for f in K.METRIC_FEATURES[:4]], 11)},
    round(service_metric__process_count, 6) AS service_metric__process_count FROM service_features"""
)
def metric_service_features(spark, folder):
    """The five service features per day from line-item samples."""
    samples = A.lineitem_samples(spark, folder)
    features = metrics.metric_features(samples, LINEITEM_SERVICES, A.DAY_MS)
    return rounded(features, 11, service_metric__process_count=6)


@query(
    f"""WITH {SERVICE_SQL} SELECT case_id, service_name, pod, timestamp_window_ms,
    round(cpu, 6) AS cpu, round(cpu_rate, 11) AS cpu_rate FROM pod_rates"""
)
def counter_rate(spark, folder):
    """CPU counter and its rate per pod and day."""
    pods = metrics.pod_windows(A.lineitem_samples(spark, folder), LINEITEM_SERVICES, A.DAY_MS)
    pods = stage(pods, "pod-windows")
    rated = metrics.counter_rate(pods, ["case_id", "pod"], "cpu", "cpu_rate", A.DAY_MS)
    columns = ["case_id", "service_name", "pod", "timestamp_window_ms", "cpu", "cpu_rate"]
    return rounded(rated.select(*columns), cpu_rate=11)


@query(
    f"""WITH {SERVICE_SQL} SELECT case_id, service_name, timestamp_window_ms,
    round(service_metric__net_rx_error_rate, 11) AS rx, round(service_metric__net_tx_error_rate, 11) AS tx
    FROM service_features"""
)
def host_rate_broadcast(spark, folder):
    """Host network error rates as every service of the window sees them."""
    samples = A.lineitem_samples(spark, folder)
    pods = samples.where(F.col("metric_name").isin(K.POD_METRICS) & (F.col("pod") != ""))
    window = S.bucket(F.col("timestamp").cast("long") * 1000, A.DAY_MS).alias("timestamp_window_ms")
    service = S.service_of_pod(F.col("pod")).alias("service_name")
    cells = pods.select("case_id", service, window).where(F.col("service_name").isin(LINEITEM_SERVICES)).distinct()
    features = metrics.with_host_rates(cells, metrics.host_rates(samples, A.DAY_MS))
    return features.select(
        "case_id",
        "service_name",
        "timestamp_window_ms",
        F.round("service_metric__net_rx_error_rate", 11).alias("rx"),
        F.round("service_metric__net_tx_error_rate", 11).alias("tx"),
    )


@query(
    f"""WITH {Q.LINEITEM_SAMPLES} SELECT regexp_replace(pod, '-[a-z0-9]{{6,10}}-[a-z0-9]{{5}}$', '')
    AS service_name, count(*) AS n, count(DISTINCT pod) AS pods FROM samples WHERE pod IS NOT NULL GROUP BY 1"""
)
def pod_to_service(spark, folder):
    """Samples and pods per service."""
    samples = A.lineitem_samples(spark, folder).where(F.col("pod").isNotNull())
    service = S.service_of_pod(F.col("pod")).alias("service_name")
    return samples.groupBy(service).agg(
        F.count("*").alias("n"), F.count_distinct("pod").alias("pods")
    )


def log_table(spark, folder):
    return A.log_lines(spark, folder).drop("ts_ms")


@query(
    f"""WITH {Q.EV}, {Q.LINES}, {Q.parsed_lines(8)}
    SELECT event_id, case_id, service_name, ts_ms, level, content FROM parsed"""
)
def log_parse(spark, folder):
    """Time, level and content of log lines whose clock is local time."""
    parsed = logs.parse_logs(log_table(spark, folder), K.LOG_TIMEZONE)
    return parsed.select("event_id", "case_id", "service_name", "ts_ms", "level", "content")


def _parsed(spark, folder):
    return logs.parse_logs(log_table(spark, folder), "UTC")


def condensed_logs(spark, folder, *extra):
    """Condensed lines and the templates of the Normal ones; the raw lines are read once."""
    lines = stage(logs.condense(_parsed(spark, folder), HOUR, *extra), "log-lines")
    return lines, stage(logs.fit_templates(lines.where(F.col("case_id") == "Normal")), "templates")


@query(
    f"""WITH {Q.EV}, {Q.LOG_CHAIN}, {Q.log_tables(HOUR)}
    SELECT case_id, service_name, timestamp_window_ms,
    {Q.rounds(["service_log__" + f for f in K.LOG_FEATURES])} FROM log_windows"""
)
def log_window_features(spark, folder):
    """Event count, error share and template diversity per service and hour."""
    return rounded(logs.log_features(*condensed_logs(spark, folder), HOUR))


@query(
    f"""WITH {Q.EV}, counts AS (SELECT case_id, service_name,
      {Q.bucket("ts_ms", HOUR)} AS timestamp_window_ms, count(*) AS n FROM ev GROUP BY ALL),
    grid AS (SELECT case_id, service_name,
      unnest(range(min(timestamp_window_ms), max(timestamp_window_ms) + {HOUR}, {HOUR})) AS timestamp_window_ms
      FROM counts GROUP BY 1, 2)
    SELECT case_id, service_name, timestamp_window_ms, coalesce(n, 0) AS n
    FROM grid LEFT JOIN counts USING (case_id, service_name, timestamp_window_ms)"""
)
def gap_fill(spark, folder):
    """Events per service and hour, hours without events as 0."""
    window = S.bucket(F.col("ts_ms"), HOUR).alias("timestamp_window_ms")
    keys = ["case_id", "service_name"]
    counts = A.events(spark, folder).groupBy(*keys, window).agg(F.count("*").alias("n"))
    counts = stage(counts, "counts")
    return series.fill_windows(counts, keys, "timestamp_window_ms", HOUR, ["n"])


@query(
    f"""WITH document_lines AS (SELECT unnest(string_split(text, chr(10))) AS content FROM documents),
    {Q.templates_of("document_lines")}
    SELECT n_tokens, first_token, template, template_id FROM templates
    UNION ALL SELECT 0, '', '', md5('') WHERE EXISTS (FROM document_lines WHERE regexp_matches(content, '^\\s*$'))"""
)
def template_fit(spark, folder):
    """Templates of the lines of all documents."""
    lines = A.document_lines(spark, folder)
    return logs.fit_templates(lines.select(F.col("line").alias("content")))


@query(
    f"""WITH {Q.EV}, {Q.LOG_CHAIN} SELECT case_id, template_id, count(*) AS n,
    min(content) AS first_content FROM matched GROUP BY 1, 2"""
)
def template_match(spark, folder):
    """Log lines per case and template fitted on Normal lines, -1 where none fits."""
    lines, templates = condensed_logs(spark, folder, F.min("content").alias("first_content"))
    return (
        logs.match_templates(lines, templates)
        .groupBy("case_id", "template_id")
        .agg(F.sum("n").alias("n"), F.min("first_content").alias("first_content"))
    )


NOTES = {
    0: ("order {k} was packed by {name} at once", "order <*> was packed by <*> at once"),
    1: ("order {k} could not be found in stock", "order <*> could not be found in stock"),
    2: ("order {k} left with carrier {name} this morning", "order <*> left with carrier <*> this morning"),
    3: ("stock of part {k} is low in {name}", "stock of part <*> is low in <*>"),
}
NAMES = {"A": "anna", "N": "nils", "R": "rosa"}


@query(
    f"""SELECT template, md5(template) AS template_id, count(*) AS n FROM (SELECT
      CASE l_linenumber % 4 {" ".join(f"WHEN {k} THEN '{t}'" for k, (_, t) in NOTES.items())} END AS template FROM lineitem) GROUP BY 1"""
)
def template_clusters(spark, folder):
    """Messages of known templates, three of them with one first word and as many tokens."""
    name = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))[F.col("l_returnflag")]
    kind, key = F.col("l_linenumber") % 4, F.col("l_orderkey").cast("string")
    text = F.coalesce(*(F.when(kind == k, F.lit(message)) for k, (message, _) in NOTES.items()))
    content = F.replace(F.replace(text, F.lit("{k}"), key), F.lit("{name}"), name)
    lines = A.table(spark, folder, "lineitem").select(content.alias("content"))
    templates = stage(logs.fit_templates(lines), "templates")
    matched = logs.match_templates(lines, templates).groupBy("template_id").agg(F.count("*").alias("n"))
    return templates.select("template", "template_id").join(matched, "template_id", "right")


MINUTE = 60_000
#: From every purchase of little value of a faulty case on, for minutes that grow with its key; many overlap.
INJECTIONS = f"""injections AS (SELECT case_id, ts_ms AS start_ms, ts_ms + k * {20 * MINUTE} AS end_ms FROM ev
  WHERE event_type = 'purchase' AND k % 9 = 0 AND case_id <> 'Normal')"""


def _injections(spark, folder):
    ev = A.events(spark, folder).where("event_type = 'purchase' and k % 9 = 0 and case_id <> 'Normal'")
    return ev.select("case_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + F.col("k") * 20 * MINUTE).alias("end_ms"))


@query(
    f"""WITH {Q.EV}, {INJECTIONS}, cells AS (SELECT DISTINCT case_id, endpoint_key, {Q.bucket("ts_ms", HOUR)} AS timestamp_window_ms FROM ev)
    SELECT case_id, endpoint_key, timestamp_window_ms,
      CASE WHEN NOT EXISTS (FROM injections i WHERE i.case_id = c.case_id) THEN 'normal'
        WHEN EXISTS (FROM injections i WHERE i.case_id = c.case_id AND c.timestamp_window_ms BETWEEN start_ms AND end_ms) THEN 'inject'
        WHEN timestamp_window_ms < (SELECT min(start_ms) FROM injections i WHERE i.case_id = c.case_id) THEN 'baseline'
        ELSE 'recover' END AS phase FROM cells c"""
)
def interval_phases(spark, folder):
    """Phases of all cells by many overlapping injections a case."""
    cells = A.events(spark, folder).select("case_id", "endpoint_key", S.bucket(F.col("ts_ms"), HOUR).alias("timestamp_window_ms"))
    return intervals.phases(cells.distinct(), _injections(spark, folder), HOUR)


@query(
    f"""WITH {Q.EV}, {INJECTIONS}, hits AS (SELECT e.case_id, e.event_id, count(*) AS n_intervals, max(end_ms - start_ms) AS longest_ms
      FROM ev e JOIN injections i ON e.case_id = i.case_id AND e.ts_ms BETWEEN i.start_ms AND i.end_ms GROUP BY 1, 2)
    SELECT * FROM hits"""
)
def interval_hits(spark, folder):
    """How many injections cover each event, and how long the longest is."""
    ev = A.events(spark, folder).select("case_id", "event_id", "ts_ms")
    # Overlapping injections are added up first, so an event meets one stretch and not each of them. Stretches are
    # disjoint: in bins of one millisecond and up, none shares a bin of its level with more than one other.
    covered = intervals.coverage(_injections(spark, folder), ["case_id"], "start_ms", "end_ms")
    met = intervals.inside(ev, covered, ["case_id"], "ts_ms", "start_ms", "end_ms", 1)
    longest = F.max("longest").alias("longest_ms")
    return met.groupBy("case_id", "event_id").agg(F.sum("n_intervals").alias("n_intervals"), longest)


@query(
    f"""WITH {Q.EV}, {Q.REPORTS}, {INJECTIONS} SELECT case_id, metric_name, count(*) AS n, round(sum(value), 2) AS total FROM samples s
    WHERE EXISTS (FROM injections i WHERE i.case_id = s.case_id AND s.ts BETWEEN start_ms / 1000 AND end_ms / 1000) GROUP BY 1, 2"""
)
def interval_samples(spark, folder):
    """Metric samples within any injection of their case."""
    kept = intervals.samples_inside(A.metric_reports(spark, folder), _injections(spark, folder), 60.0)
    return kept.groupBy("case_id", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
