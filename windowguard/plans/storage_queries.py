"""Queries that write tables in the layout of the sources, read them back and use them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import labels, metrics, normalize, profile, red
from windowguard.operators import evaluate as E
from windowguard.plans import sql as Q
from windowguard.plans.endpoint_queries import SIX_HOURS, red_tables
from windowguard.plans.registry import query, rounded
from windowguard.plans.scoring_queries import SCORES, STRATA
from windowguard.plans.service_queries import FILTERED
from windowguard.plans.text_queries import TYPED, _range_results, _typed
from windowguard.plans.wide_queries import WHOLE, wide_table
from windowguard.session import shared_dir, stage
from windowguard.sources import bucketed, cache, files, sinks
from windowguard.sources import tables as A


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"


def _write_cases(df: DataFrame, root: str, place: str) -> None:
    """One CSV per case, each in the folder of its case."""
    kept = stage(df, "cases")
    for case in A.CASES:
        own = kept.where(F.col("case_id") == case)
        sinks.write_csv(own, f"{root}/{case}/{place}")


def _all_columns(df: DataFrame, schema: T.StructType) -> list:
    return [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]


CELL = "case_id, endpoint_key, timestamp_window_ms"


@query(
    f"""WITH {Q.red(SIX_HOURS)} SELECT {CELL}, trace_request_count, round(trace_latency_p95, 6) AS trace_latency_p95,
    round(trace_5xx_rate, 6) AS trace_5xx_rate FROM trace"""
)
def trace_red_files(spark, folder):
    """Server RED tables written as CSV in case folders and read back."""
    root = _folder(spark)
    trace, _ = red_tables(spark, folder, SIX_HOURS)
    named = trace.withColumnRenamed("timestamp_window_ms", "timestamp_window")
    columns = _all_columns(named, files.schemas.TRACE_RED)
    _write_cases(named.select(*columns), root, f"_pipeline_out/{files.TRACE_RED_FILE}")
    back = files.read_trace_red(spark, root)
    names = ["case_id", "endpoint_key", "timestamp_window_ms", "trace_request_count"]
    return rounded(back.select(*names, "trace_latency_p95", "trace_5xx_rate"))


@query(
    f"""WITH {Q.red(SIX_HOURS)} SELECT {CELL}, request_count, round(latency_p95, 6) AS latency_p95,
    round(error_rate, 6) AS error_rate FROM client"""
)
def client_red_files(spark, folder):
    """Client RED tables written as CSV with ISO windows and read back."""
    root = _folder(spark)
    _, client = red_tables(spark, folder, SIX_HOURS)
    named = client.withColumn("timestamp_window", S.ms_to_iso(F.col("timestamp_window_ms")))
    columns = _all_columns(named, files.schemas.CLIENT_RED)
    _write_cases(named.select(*columns), root, f"_pipeline_out/{files.CLIENT_RED_FILE}")
    back = files.read_client_red(spark, root)
    names = ["case_id", "endpoint_key", "timestamp_window_ms", "request_count"]
    return rounded(back.select(*names, "latency_p95", "error_rate"))


@query(
    f"""WITH {Q.EV}, {Q.REPORTS}, filed AS (SELECT *, CASE WHEN pod IS NULL THEN 'host.csv' ELSE 'pods.csv' END AS metric_file
      FROM samples)
    SELECT case_id, metric_file, metric_name, count(*) AS n, count(value) AS n_values,
      round(sum(value), 2) AS total, round(min(ts), 3) AS first_s FROM filed GROUP BY ALL"""
)
def metric_files(spark, folder):
    """Samples in two files a case with differently ordered headers, read by name."""
    root = _folder(spark)
    samples = stage(A.metric_reports(spark, folder), "reports")
    pods = samples.where("pod is not null").select("case_id", "metric_name", "timestamp", "value", "pod", "interface")
    host = samples.where("pod is null").select("interface", "value", "pod", "case_id", "timestamp", "metric_name")
    _write_cases(pods, root, "metric_data/pods.csv")
    _write_cases(host, root, "metric_data/host.csv")
    back = files.read_metric_samples(spark, f"{root}/*/metric_data/*.csv")
    return back.groupBy("case_id", "metric_file", "metric_name").agg(
        F.count("*").alias("n"),
        F.count("value").alias("n_values"),
        F.round(F.sum("value"), 2).alias("total"),
        F.round(F.min("timestamp"), 3).alias("first_s"),
    )


@query(
    f"""WITH {Q.EV}, {Q.LINES} SELECT case_id, service_name, count(*) AS n, count(DISTINCT line) AS n_lines,
    min(line) AS first_line FROM lines GROUP BY ALL"""
)
def log_files(spark, folder):
    """Log lines written as text files of pods and read back."""
    root = _folder(spark)
    lines = stage(A.log_lines(spark, folder).select("case_id", "service_name", "line"), "lines")
    for case in A.CASES:
        for service in ("svc-order", "svc-other", "svc-shop", "svc-user"):
            own = lines.where((F.col("case_id") == case) & (F.col("service_name") == service)).select("line")
            sinks.write_text_files(own, f"{root}/{case}/log_data/{service}-abcdef1-00000", "app", ".log")
    return files.read_logs(spark, root).groupBy("case_id", "service_name").agg(
        F.count("*").alias("n"), F.count_distinct("line").alias("n_lines"), F.min("line").alias("first_line")
    )


@query(
    f"""WITH {Q.EV}, bounds AS (SELECT case_id, min(ts_ms) AS a, max(ts_ms) AS b FROM ev GROUP BY 1)
    SELECT case_id, case_id AS meta_case_id, CASE case_id WHEN 'Lv_D_pool' THEN 'Normal' ELSE case_id END AS anomaly_type,
      CASE case_id WHEN 'Normal' THEN 'none' ELSE 'level' END AS anomaly_level,
      CASE case_id WHEN 'Normal' THEN NULL ELSE 'svc-shop' END AS target_service,
      CASE case_id WHEN 'Normal' THEN NULL ELSE a END AS inject_start_ms,
      CASE case_id WHEN 'Normal' THEN NULL ELSE b END AS inject_end_ms, case_id = 'Normal' AS fit_normal FROM bounds"""
)
def case_metadata(spark, folder):
    """Cases found by their folders, with a document at the top, in trace_data, without a type, or none."""
    root = _folder(spark)
    bounds = A.events(spark, folder).groupBy("case_id").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    bounds = stage(bounds, "bounds")
    places = {"Normal": None, "Lv_P_slow": "", "Lv_S_kill": "trace_data/", "Lv_D_pool": ""}
    for case, place in places.items():
        own = bounds.where(F.col("case_id") == case)
        sinks.write_csv(own, f"{root}/{case}/_pipeline_out/{files.TRACE_RED_FILE}")
        if place is None:
            continue
        fields = [F.lit(case).alias("case_id"), F.lit(case).alias("anomaly_type"), F.lit("level").alias("anomaly_level")]
        if case == "Lv_D_pool":
            fields.pop(1)
        bounds_of = [F.lit("svc-shop").alias("target_service"), F.col("a").alias("inject_start_ms"), F.col("b").alias("inject_end_ms")]
        document = own.select(F.to_json(F.struct(*fields, *bounds_of)).alias("value"))
        sinks.write_text_files(document.coalesce(1), f"{root}/{case}/{place}".rstrip("/"), "case_metadata", ".json", numbered=False)
    return files.read_cases(spark, root)


@query(
    f"""WITH {Q.EV}, {Q.CLIENTS} SELECT replace(endpoint_key, '/v1/', '/{{param}}/') AS endpoint_key, status_code, count(*) AS n,
    round(sum(latency_ms), 4) AS total, min(ts_ms // 1000) AS first_s FROM clients GROUP BY ALL"""
)
def request_files(spark, folder):
    """Client requests written as JSON lines and read back."""
    path = f"{_folder(spark)}/requests.jsonl"
    requests = A.client_requests(spark, folder).select(
        S.ms_to_iso(F.col("ts_ms")).alias("timestamp"),
        F.lit("POST").alias("method"),
        F.regexp_replace("endpoint_key", "^POST:", "http://shop.example").alias("url"),
        "status_code",
        "latency_ms",
    )
    requests.write.json(path)
    back = files.read_requests(spark, path)
    key = S.endpoint_key(F.col("method"), F.col("url")).alias("endpoint_key")
    return back.groupBy(key, "status_code").agg(
        F.count("*").alias("n"),
        F.round(F.sum("latency_ms"), 4).alias("total"),
        F.floor(F.min(S.iso_to_ms(F.col("timestamp"))) / 1000).alias("first_s"),
    )


ORDERS_A_FILE = 4000


@query(
    """SELECT l_returnflag AS run_end, l_linestatus AS test_name, count(*) * 2 AS n,
    CAST(sum(l_partkey + l_suppkey) AS BIGINT) AS total FROM lineitem WHERE NOT l_tax > 0.07e0 AND l_returnflag <> 'N' GROUP BY 1, 2"""
)
def range_result_files(spark, folder):
    """Range results written as JSON documents in run and test folders; runs with a prefix are read."""
    root = _folder(spark)
    # Every result is turned into text once; a file's array is put together of those.
    text = F.to_json(F.struct("metric", "values")).alias("text")
    results = stage(_range_results(spark, folder).select("run_end", "test_name", "l_orderkey", text), "results")
    for run in ("A", "N", "R"):
        for test in ("F", "O"):
            own = results.where((F.col("run_end") == run) & (F.col("test_name") == test))
            # A file holds one array of results, here of the line items of a range of orders.
            bundled = own.groupBy(F.floor(F.col("l_orderkey") / ORDERS_A_FILE).alias("part")).agg(
                F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("value")
            )
            place = f"{root}/{'old-' if run == 'N' else 'run-'}{run}/{test}/metrics"
            bundled.select("value").write.option("maxRecordsPerFile", 1).text(place)
    back = profile.prom_long(files.read_range_results(spark, f"{root}/*/*/metrics", "run-"))
    return back.groupBy(F.substring("run_end", -1, 1).alias("run_end"), "test_name").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total")
    )


@query(
    """SELECT kind, count(*) AS n, count(DISTINCT "timestamp") AS n_times, min("timestamp") AS first, max(value) AS last FROM (
      SELECT 'order' AS kind, CAST(epoch_ms(o_orderdate) // 1000 AS VARCHAR) AS "timestamp", CAST(o_orderkey AS VARCHAR) AS value FROM orders
      UNION ALL SELECT 'line', CAST(epoch_ms(l_shipdate) // 1000 AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem)
    GROUP BY 1"""
)
def text_csv_files(spark, folder):
    """Two CSV exports read as one table of texts."""
    root = _folder(spark)

    def export(table: str, time: str, kind: str, value: str) -> str:
        rows = A.table(spark, folder, table).select(
            F.lit(kind).alias("kind"),
            F.unix_seconds(F.col(time).cast("timestamp")).alias("timestamp"),
            F.col(value).alias("value"),
        )
        sinks.write_csv(rows, f"{root}/{kind}.csv")
        return f"{root}/{kind}.csv"

    paths = [export("orders", "o_orderdate", "order", "o_orderkey"), export("lineitem", "l_shipdate", "line", "l_orderkey")]
    return files.read_text_csv(spark, paths).groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_distinct("timestamp").alias("n_times"),
        F.min("timestamp").alias("first"),
        F.max("value").alias("last"),
    )


@query(f"WITH {Q.WIDE} SELECT {WHOLE} FROM wide")
def contract_files(spark, folder):
    """The wide table written by case in total order and read back."""
    path = f"{_folder(spark)}/contract"
    sinks.write_contract(wide_table(spark, folder), path)
    return rounded(sinks.read_contract(spark, path)).select(*K.ID_COLUMNS, *K.LABEL_COLUMNS, *Q.FEATURES)


@query(
    f"""WITH {Q.WIDE} SELECT case_id, endpoint_key, timestamp_window_ms,
    row_number() OVER (PARTITION BY case_id ORDER BY endpoint_key, timestamp_window_ms) - 1 AS position FROM wide"""
)
def contract_order(spark, folder):
    """Where each row of the written wide table stands in the files of its case."""
    path = f"{_folder(spark)}/contract"
    sinks.write_contract(wide_table(spark, folder), path)
    return sinks.stored_order(spark, path).select("case_id", "endpoint_key", "timestamp_window_ms", "position")


@query(
    f"""WITH {Q.WIDE} SELECT sample_id, phase, is_anomaly,
    round(coalesce(endpoint_red__trace_latency_p95, 0) + coalesce(endpoint_red__client_latency_p95, 0), 6) AS score FROM wide"""
)
def colocated_scores(spark, folder):
    """Scores joined to the wide table by sample_id, both stored in the same buckets."""
    root = _folder(spark)
    wide = stage(wide_table(spark, folder), "wide")
    sides = [F.coalesce(f"endpoint_red__{side}_latency_p95", F.lit(0.0)) for side in ("trace", "client")]
    contract = bucketed.write_bucketed(wide, f"{root}/contract", "sample_id", 16)
    scores = wide.select("sample_id", (sides[0] + sides[1]).alias("score"))
    scores = bucketed.write_bucketed(scores, f"{root}/scores", "sample_id", 16)
    return rounded(contract.join(scores, "sample_id").select("sample_id", "phase", "is_anomaly", "score"))


@query(
    f"""WITH {Q.WIDE} SELECT {", ".join(K.ID_COLUMNS)}, anomaly_type, phase, {Q.rounds(Q.FEATURES)}
    FROM wide WHERE anomaly_type LIKE 'Normal%'"""
)
def training_files(spark, folder):
    """The Normal rows of the written wide table."""
    path = f"{_folder(spark)}/contract"
    sinks.write_contract(wide_table(spark, folder), path)
    back = sinks.read_contract(spark, path, train_only=True)
    return rounded(back).select(*K.ID_COLUMNS, "anomaly_type", "phase", *Q.FEATURES)


@query(f"WITH {SCORES} SELECT sample_id, score, y_true, anomaly_type, anomaly_level FROM scores")
def score_files(spark, folder):
    """Scores with diagnostics written and read back."""
    path = f"{_folder(spark)}/scores"
    sinks.write_scores(A.event_scores(spark, folder), path)
    return files.read_table(spark, path).select("sample_id", "score", "y_true", "anomaly_type", "anomaly_level")


@query(
    f"""WITH {FILTERED} SELECT case_id, metric_name, count(*) AS n, round(sum(value), 2) AS total
    FROM kept_samples GROUP BY 1, 2"""
)
def sample_cache(spark, folder):
    """Filtered samples materialised by case and time and read back."""
    trace, client = red_tables(spark, folder, A.DAY_MS)
    bounds = stage(red.case_bounds(red.endpoint_features(trace, client, A.ENDPOINTS)), "bounds")
    kept = metrics.filter_samples(A.metric_reports(spark, folder), bounds)
    back = sinks.materialize(kept, f"{_folder(spark)}/samples", ["case_id", "timestamp"])
    return back.groupBy("case_id", "metric_name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    f"""WITH {FILTERED} SELECT case_id, CASE WHEN pod IS NULL THEN 'host.csv' ELSE 'pods.csv' END AS metric_file, metric_name,
      count(*) AS n, round(sum(value), 2) AS total, CASE WHEN pod IS NULL THEN 2 ELSE 1 END AS run
    FROM kept_samples GROUP BY ALL"""
)
def sample_cache_refresh(spark, folder):
    """A cache filled from one file a case, refreshed after a second came; ``run`` filtered the file."""
    root = _folder(spark)
    trace, client = red_tables(spark, folder, A.DAY_MS)
    bounds = stage(red.case_bounds(red.endpoint_features(trace, client, A.ENDPOINTS)), "bounds")
    samples = stage(A.metric_reports(spark, folder), "reports")
    for name, chosen in (("pods.csv", "pod is not null"), ("host.csv", "pod is null")):
        _write_cases(samples.where(chosen), root, f"metric_data/{name}")
        manifest = cache.refresh(spark, f"{root}/*/metric_data/*.csv", bounds, f"{root}/cache")
    runs = manifest.select("case_id", F.regexp_extract("path", "/metric_data/([^/]+)", 1).alias("metric_file"), "run").distinct()
    counts = cache.read_samples(spark, f"{root}/cache").groupBy("case_id", "metric_file", "metric_name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
    return counts.join(runs, ["case_id", "metric_file"])


@query(
    f"""WITH {Q.EV}, {Q.CLIENTS} SELECT 'latency_ms' AS feature, 'per_endpoint' AS scope, endpoint_key AS group_key,
      round(min(latency_ms), 6) AS lo, round(max(latency_ms), 6) AS hi FROM clients WHERE case_id LIKE 'Normal%' GROUP BY 3
    UNION ALL SELECT 'status_code', 'global', '{normalize.GLOBAL_KEY}', min(status_code), max(status_code) FROM clients WHERE case_id LIKE 'Normal%'"""
)
def stats_files(spark, folder):
    """Normalisation ranges saved and loaded."""
    path = f"{_folder(spark)}/stats"
    normal = A.client_requests(spark, folder).where(S.is_normal(F.col("case_id")))
    sinks.write_stats(normalize.fit_minmax(normal, {"latency_ms": "per_endpoint", "status_code": "global"}), path)
    return rounded(sinks.read_stats(spark, path))


@query(
    f"""WITH {Q.EV}, {Q.LINES}, {TYPED} SELECT base_filename, log_type, CAST(count(*) AS VARCHAR) AS "count" FROM typed
    GROUP BY GROUPING SETS ((log_type), (base_filename), (base_filename, log_type))"""
)
def count_csv(spark, folder):
    """Counts of log types written as CSV and read as text."""
    path = f"{_folder(spark)}/counts"
    sinks.write_csv(profile.log_type_counts(_typed(spark, folder)), path)
    return files.read_text_csv(spark, path)


@query(
    f"""{STRATA} SELECT max(n_samples) FILTER (stratum = 'overall') AS n_samples,
    round(max(auroc) FILTER (stratum = 'overall'), 8) AS auroc, round(max(auprc) FILTER (stratum = 'overall'), 8) AS auprc,
    CAST(count(*) FILTER (stratum = 'by_anomaly_type') AS INT) AS n_types,
    CAST(count(*) FILTER (stratum = 'by_anomaly_level') AS INT) AS n_levels,
    round(sum(auroc) FILTER (stratum = 'by_anomaly_type'), 7) AS type_aurocs FROM metrics"""
)
def metrics_files(spark, folder):
    """The metrics document written, read and taken apart."""
    path = f"{_folder(spark)}/metrics"
    sinks.write_metrics(E.evaluate(A.event_scores(spark, folder)), path)
    strata = "map<string,struct<auroc:double,n_samples:long>>"
    doc = F.from_json(
        "value",
        f"n_samples long, auroc double, auprc double, stratified struct<by_anomaly_type:{strata},by_anomaly_level:{strata}>",
    )
    parsed = spark.read.text(path).select(doc.alias("d")).select("d.*")
    types, levels = F.col("stratified.by_anomaly_type"), F.col("stratified.by_anomaly_level")
    total = F.aggregate(F.map_values(types), F.lit(0.0), lambda a, s: a + F.coalesce(s["auroc"], F.lit(0.0)))
    return parsed.select(
        "n_samples",
        F.round("auroc", 8).alias("auroc"),
        F.round("auprc", 8).alias("auprc"),
        F.size(types).alias("n_types"),
        F.size(levels).alias("n_levels"),
        F.round(total, 7).alias("type_aurocs"),
    )


@query(
    f"""WITH {Q.EV}, {Q.CASES}, seen AS (SELECT DISTINCT case_id, endpoint_key, {Q.bucket("ts_ms", SIX_HOURS)} AS timestamp_window_ms FROM ev)
    SELECT phase, count(*) AS n FROM (SELECT {Q.PHASE} AS phase FROM seen LEFT JOIN cases USING (case_id)) GROUP BY 1"""
)
def phases_of_read_cases(spark, folder):
    """Phases of all cells by case documents that were written and read back."""
    root = _folder(spark)
    for row in A.cases(spark).collect():  # four cases
        own = A.cases(spark).where(F.col("case_id") == row["case_id"])
        sinks.write_csv(own, f"{root}/{row['case_id']}/_pipeline_out/{files.TRACE_RED_FILE}")
        document = own.select(F.to_json(F.struct("*")).alias("value"))
        sinks.write_text_files(document.coalesce(1), f"{root}/{row['case_id']}", "case_metadata", ".json", numbered=False)
    cells = A.events(spark, folder).select(
        "case_id", "endpoint_key", S.bucket(F.col("ts_ms"), SIX_HOURS).alias("timestamp_window_ms")
    )
    return labels.with_labels(cells.distinct(), files.read_cases(spark, root)).groupBy("phase").agg(F.count("*").alias("n"))
