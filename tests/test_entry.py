"""The driver contract: registered queries, their SQL, and the shape of their plans."""

import re

import duckdb
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError

import __spark_entry__ as entry_module
from windowguard.operators import red
from windowguard.sources import tables

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = [
    "tumbling_bucket", "client_red", "trace_red", "phase_labels", "url_normalize", "entry_span_filter",
    "gap_fill", "log_window_features", "metric_service_features", "auroc", "stratified_auroc", "score_stats",
    "oov_score", "run_sampling_distinct", "file_size_stats", "empty_breakdown", "metric_wide_pivot", "sliding_sequences",
]


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 100
    assert df.columns[:3] == ["case_id", "endpoint_key", "timestamp_window_ms"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    got = entry_module.queries()[name](spark, FOLDER).toPandas()
    want = con.sql(entry_module.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["client_red", "auroc", "oov_score", "template_match", "metric_filter", "topk_loadings"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry_module.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"):
        assert operator not in text


def test_endpoint_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "red")
    red.trace_red(tables.spans(spark, FOLDER), tables.DAY_MS).write.parquet(path)
    text = plan(red.trace_features(spark.read.parquet(path), tables.ENDPOINTS))
    assert re.search(r"PushedFilters: \[.*In\(endpoint_key", text)
    assert "trace_latency_p99" not in text


def test_time_range_count_reads_one_column(spark):
    text = plan(entry_module.queries()["time_range_count"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<l_shipdate:timestamp_ntz>", text)


def finished(spark, group):
    """Finished stages of a job group; a stage that was skipped has no attempt."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    done = []
    for stage in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}:
        try:
            attempt = store.lastStageAttempt(stage)
        except Py4JJavaError:
            continue
        if str(attempt.status()) == "COMPLETE":
            done.append(attempt)
    return done


def records_read(spark, df):
    """Input records of all stages that run for ``df``."""
    context = spark.sparkContext
    context.setJobGroup("records", "records")
    df.collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    return sum(a.inputRecords() for a in finished(spark, "records"))


def test_ranking_scans_its_input_once(spark):
    requests = tables.client_requests(spark, FOLDER)
    assert records_read(spark, red.client_red(requests, tables.DAY_MS)) == requests.count()


@pytest.mark.parametrize(
    ("name", "sources"),
    [
        ("counter_rate", ["lineitem"]),
        ("sliding_sequences", ["events"]),
        ("gap_fill", ["events"]),
        ("oov_score", ["conversations"]),
        ("rarity_score", ["conversations"]),
        ("oov_sweep", ["documents"]),
        ("text_vectors", ["conversations"]),
        ("log_window_features", ["events"]),
        ("template_match", ["events"]),
    ],
)
def test_queries_scan_their_input_once(spark, name, sources):
    """Staged copies are smaller than the input, so one more scan of it would show."""
    rows = sum(tables.table(spark, FOLDER, t).count() for t in sources)
    context = spark.sparkContext
    context.setJobGroup(name, name)
    entry_module.queries()[name](spark, FOLDER).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [a.inputRecords() for a in finished(spark, name)].count(rows) == 1


@pytest.mark.parametrize("name", ["minmax_apply", "rate_clip", "weak_labels", "metric_service_features"])
def test_small_sides_are_not_sort_merged(spark, name):
    """Between the size of the small sides and that of the wide table, the planner knows which is which."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        text = plan(entry_module.queries()[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for key in ("endpoint_key", "service_name"):
        assert not re.search(rf"SortMergeJoin \[(cast\()?{key}#\d+[^,\]]*\], \[group_key", text)
    if name == "metric_service_features":
        assert not re.search(r"SortMergeJoin \[case_id#\d+\]", text)


def test_staged_tables_are_removed(spark):
    from windowguard import session

    kept, session._STAGED[:] = session._STAGED[:], []
    try:
        frame = session.stage(spark.range(3), "probe")
        path = session._STAGED[0][1]
        assert frame.count() == 3
        session.remove_staged()
        assert not session._STAGED
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    finally:
        session._STAGED[:] = kept
