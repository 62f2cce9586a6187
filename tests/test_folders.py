"""Raw case folders to the wide table, scores and metrics."""

import gzip
import json
import re

import pytest

from windowguard import constants as K
from windowguard.operators import profile
from windowguard.plans import flow
from windowguard.sources import cache, files, headers, sinks

TRAVEL = "POST:/api/v1/travelservice/trips/left"
ROUTES = "GET:/api/v1/routeservice/routes"
N0, F0 = 1_780_972_185_000, 1_780_980_000_000
TRACE_HEADER = (
    "case_id,anomaly_type,timestamp_window,window_str,endpoint_key,method,normalized_path,trace_request_count,"
    "trace_latency_mean,trace_latency_p50,trace_latency_p95,trace_latency_p99,trace_error_rate,trace_5xx_rate,"
    "trace_4xx_rate,trace_status_coverage,weak_is_anomaly,label_confidence,latency_anomaly_signal,"
    "error_anomaly_signal,5xx_anomaly_signal,phase,injection_start_ms,injection_end_ms,target_service"
)
CLIENT_HEADER = (
    "case_id,anomaly_type,timestamp_window,endpoint_key,request_count,error_rate,latency_mean,latency_p50,"
    "latency_p95,latency_p99,status_2xx_rate,status_4xx_rate,status_5xx_rate,method,normalized_path"
)
METRIC_HEADER = "metric_name,timestamp,datetime,value,instance,interface,pod"


def iso(ms):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_case(root, name, start, trace, client, cpu, logs, metadata=None):
    """``trace`` and ``client`` map an endpoint to (count, p50, p95, 5xx) and (count, p95) per window."""
    out = root / name / "_pipeline_out"
    out.mkdir(parents=True)
    t_rows, c_rows = [], []
    for endpoint in trace:
        for i, (n, p50, p95, rate) in enumerate(trace[endpoint]):
            w = start + 15_000 * i
            t_rows.append(f"x,x,{w},{iso(w)},{endpoint},M,/p,{n},1.0,{p50},{p95},,0.0,{rate},0.0,1.0,0,normal,0,0,0,normal,,,")
        for i, (n, p95) in enumerate(client[endpoint]):
            c_rows.append(f"x,x,{iso(start + 15_000 * i)},{endpoint},{n},0.0,1.0,1.0,{p95},1.0,1.0,0.0,0.0,M,/p")
    (out / "tt_traces_red_15s.csv").write_text("\n".join([TRACE_HEADER, *t_rows]) + "\n")
    (out / "tt_endpoint_health_15s.csv").write_text("\n".join([CLIENT_HEADER, *c_rows]) + "\n")
    samples = [f"{K.CPU_COUNTER},{start // 1000 + t},,{v},host,,ts-travel-service-6f467bc998-jt5dd" for t, v in cpu]
    (root / name / "metric_data").mkdir()
    (root / name / "metric_data" / "m.csv").write_text("\n".join([METRIC_HEADER, *samples]) + "\n")
    for folder, lines in logs.items():
        pod = root / name / "log_data" / folder
        pod.mkdir(parents=True)
        (pod / "app.log").write_bytes(b"\n".join(lines) + b"\n")
    if metadata:
        place, document = metadata
        target = root / name / place
        target.mkdir(exist_ok=True)
        (target / "case_metadata.json").write_text(json.dumps(document))


def log_line(clock, level, text):
    return f"2026-06-09 {clock}  {level} 1 --- [main] c.e.Logger : {text}".encode()


@pytest.fixture(scope="module")
def data_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("cases")
    normal_log = [log_line("10:29:46.491", "INFO", "request 1 ok"), log_line("10:29:50.100", "ERROR", "request 2 ok"), b"\xff broken"]
    write_case(
        root, "Normal", N0,
        {TRAVEL: [(8, 1, 45595.0, 0.0), (10, 1, 42000.0, 0.0), (6, 1, 46000.0, 0.0)], ROUTES: [(12, 1, 950.0, "")] * 3},
        {TRAVEL: [(8, 46000.0), (10, 43000.0), (6, 47000.0)], ROUTES: [(12, 1000.0)] * 3},
        [(2, 100.0), (17, 105.0), (32, 110.0)],
        {"ts-travel-service-6f467bc998-jt5dd": normal_log, "ts-route-service-7a4b5c6d8e-ab9zx": normal_log},
    )
    write_case(
        root, "case two", F0,
        {TRAVEL: [(9, 1, 45000.0, 0.0), (11, 1, 98000.0, 0.2), (7, 1, 43000.0, 0.0)], ROUTES: [(12, 1, 950.0, "")] * 3},
        {TRAVEL: [(9, 46000.0), (11, 99000.0), (7, 44000.0)], ROUTES: [(12, 1000.0)] * 3},
        [(2, 100.0), (17, 105.0), (32, 110.0)],
        {"run1/ts-travel-service-6f467bc998-jt5dd": normal_log},
        ("trace_data", {"case_id": "Lv_P_DISKIO", "anomaly_type": "Lv_P_DISKIO", "target_service": None,
                        "inject_start_ms": 1_780_980_010_000, "inject_end_ms": 1_780_980_020_000}),
    )
    return str(root)


def test_cases(spark, data_root):
    got = {r["case_id"]: r for r in files.read_cases(spark, data_root).collect()}
    assert set(got) == {"Normal", "case two"}
    normal, fault = got["Normal"], got["case two"]
    assert (normal["anomaly_type"], normal["anomaly_level"], normal["inject_start_ms"]) == ("Normal", "none", None)
    assert (fault["meta_case_id"], fault["anomaly_type"], fault["anomaly_level"]) == ("Lv_P_DISKIO", "Lv_P_DISKIO", "none")
    assert (fault["target_service"], fault["inject_end_ms"]) == (None, 1_780_980_020_000)


def test_case_document_order_and_null(spark, tmp_path):
    for place, level in ((".", None), ("trace_data", "service")):
        folder = tmp_path / "c" / place
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "case_metadata.json").write_text(json.dumps({"case_id": "n", "anomaly_level": level}))
    (tmp_path / "c" / "_pipeline_out").mkdir()
    (tmp_path / "c" / "_pipeline_out" / "a.csv").write_text("x\n")
    got = files.read_cases(spark, str(tmp_path)).collect()
    assert [(r["meta_case_id"], r["anomaly_level"], r["anomaly_type"]) for r in got] == [("n", None, "Normal")]


def test_logs_of_both_layouts(spark, data_root):
    got = files.read_logs(spark, data_root).collect()
    assert {(r["case_id"], r["service_name"]) for r in got} == {
        ("Normal", "ts-travel-service"), ("Normal", "ts-route-service"), ("case two", "ts-travel-service"),
    }
    assert len(got) == 9 and "� broken" in {r["line"] for r in got}


def test_metric_files_are_read_by_their_own_header(spark, tmp_path, caplog):
    folder = tmp_path / "c" / "metric_data"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("metric_name,timestamp,value,pod,interface\nm,1,2,p,i\n")
    (folder / "b.csv").write_text("timestamp,metric_name,pod,value,interface,zone\n3,m,p,4,i,z\nx,m,p,5,i,z\n4,m,p,oops,i,z\n")
    (folder / "bad.csv").write_text("time,name\n1,2\n")
    (folder / "worse.csv").write_text("metric_name,value\nm,2\n")
    pattern = str(folder / "*.csv")
    got = sorted(
        (r["case_id"], r["metric_file"], r["metric_name"], r["timestamp"], r["value"], r["pod"], r["zone"])
        for r in files.read_metric_samples(spark, pattern).collect()
    )
    assert got == [
        ("c", "a.csv", "m", 1.0, 2.0, "p", None), ("c", "b.csv", "m", 3.0, 4.0, "p", "z"), ("c", "b.csv", "m", 4.0, None, "p", "z"),
    ]
    assert "2 metric files" in caplog.text
    usable = {r["path"].rsplit("/", 1)[-1]: r["usable"] for r in files.metric_headers(spark, pattern).collect()}
    assert usable == {"a.csv": True, "b.csv": True, "bad.csv": False, "worse.csv": False}


def test_odd_headers(spark, tmp_path):
    """Byte order mark, quotes, repeated and empty names, blank lines above, other case, signs of patterns in names."""
    folder = tmp_path / "c [1]" / "metric_data"
    folder.mkdir(parents=True)
    head = "metric_name,timestamp,value,pod,interface"
    (folder / "a{1}.csv").write_text("\ufeff" + head + ',"odd, name",pod,,Pod\nm,1,2,p,i,o,again,none,P\n', encoding="utf-8")
    (folder / "b*.csv").write_text(f"{head}\r\nm,2,3,q,i\r\n{head}\n")
    (folder / "empty.csv").write_text("")
    with gzip.open(folder / "c.csv.gz", "wt") as packed:
        packed.write(f"{head},zone\nm,3,4,r,i,z\n")
    got = files.read_metric_samples(spark, str(tmp_path / "*" / "metric_data"))
    rows = {(r["case_id"], r["metric_file"], r["timestamp"], r["pod"], r["odd, name"], r["zone"]) for r in got.collect()}
    assert rows == {
        ("c [1]", "a{1}.csv", 1.0, "p", "o", None), ("c [1]", "b*.csv", 2.0, "q", None, None), ("c [1]", "c.csv.gz", 3.0, "r", None, "z"),
    }
    assert files.read_metric_samples(spark, headers.literal_path(str(folder / "empty.csv"))).count() == 0


def test_a_header_is_found_in_the_first_bytes(spark, tmp_path):
    """A file without line ends is not read to its end."""
    (tmp_path / "long.csv").write_text("x" * (3 * headers.FIRST_BYTES))
    (line,) = headers.first_lines(spark, str(tmp_path)).values()
    assert 0 < len(line) <= headers.FIRST_BYTES


def test_metric_files_are_scanned_once_and_pruned(spark, tmp_path):
    from test_entry import plan, records_read

    folder = tmp_path / "c" / "metric_data"
    folder.mkdir(parents=True)
    names = ["metric_name", "timestamp", "value", "pod", "interface", *(f"label{i}" for i in range(17))]
    for n, order in enumerate((names, names[::-1])):
        for part in range(2):
            rows = [dict.fromkeys(names, "x") | {"metric_name": f"m{i % 4}", "timestamp": str(i), "value": "1"} for i in range(500)]
            lines = [",".join(order), *(",".join(r[c] for c in order) for r in rows)]
            (folder / f"f{n}{part}.csv").write_text("\n".join(lines) + "\n")
    spark.sparkContext.setJobGroup("opening", "opening")
    samples = files.read_metric_samples(spark, str(folder))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("opening")
    some = samples.where("metric_name in ('m1', 'm2')").select("metric_name", "timestamp", "value", "pod", "interface")
    text = plan(some)
    assert text.count("FileScan csv") == 2 and "label" not in text
    assert len(re.findall(r"PushedFilters: \[.*In\(metric_name, \[m1,m2\]\)", text)) == 2
    assert some.count() == 1000
    assert records_read(spark, some) <= 2000 + 4


def test_a_broken_case_document_is_an_error_that_names_the_case(spark, tmp_path):
    for case, text in (("good", "{}"), ("Lv_P_bad", '{"anomaly_type": "Lv_P')):
        (tmp_path / case / "_pipeline_out").mkdir(parents=True)
        (tmp_path / case / "_pipeline_out" / "a.csv").write_text("x\n")
        (tmp_path / case / "case_metadata.json").write_text(text)
    with pytest.raises(Exception, match="Lv_P_bad"):
        files.read_cases(spark, str(tmp_path)).collect()


def test_a_case_that_names_no_type_is_left_out_of_the_fit(spark, tmp_path):
    documents = {"none": None, "typed": {"anomaly_type": "Normal_1"}, "untyped": {"anomaly_level": "x"}, "null": {"anomaly_type": None}}
    for case, document in documents.items():
        (tmp_path / case / "_pipeline_out").mkdir(parents=True)
        (tmp_path / case / "_pipeline_out" / "a.csv").write_text("x\n")
        if document is not None:
            (tmp_path / case / "case_metadata.json").write_text(json.dumps(document))
    got = {r["case_id"]: (r["fit_normal"], r["anomaly_type"]) for r in files.read_cases(spark, str(tmp_path)).collect()}
    assert got == {"none": (True, "Normal"), "typed": (True, "Normal_1"), "untyped": (False, "Normal"), "null": (False, None)}


def test_absent_modality_folders(spark, data_root, tmp_path):
    import shutil

    for case in ("Normal", "case two"):
        shutil.copytree(f"{data_root}/{case}/_pipeline_out", tmp_path / case / "_pipeline_out")
    sources = flow.sources_from_folder(spark, str(tmp_path))
    assert sources.samples is None and sources.logs is None
    row = flow.build_wide(sources).first()
    assert row["service_metric__process_count"] is None and row["service_log__event_rate"] is None


def test_files_of_a_case_are_summed_up_apart(spark, data_root, tmp_path):
    import shutil

    for case in ("Normal", "case two"):
        shutil.copytree(f"{data_root}/{case}", tmp_path / case)
    first = tmp_path / "Normal" / "metric_data" / "m.csv"
    (first.parent / "again.csv").write_text(first.read_text())
    wide = flow.build_wide(flow.sources_from_folder(spark, str(tmp_path))).where("case_id = 'Normal'")
    alone = flow.build_wide(flow.sources_from_folder(spark, data_root)).where("case_id = 'Normal'")
    column = "service_metric__cpu_usage_rate"
    doubled = sorted(r[column] for r in wide.where(f"{column} is not null").select(column).collect())
    once = sorted(r[column] for r in alone.where(f"{column} is not null").select(column).collect())
    assert doubled == sorted(2 * once)
    from windowguard.operators import quality

    found = {(r["rule"], r["column"]): r["n_rows"] for r in quality.contract_violations(wide).collect()}
    assert found["duplicate", "sample_id"] == len(once)


@pytest.fixture(scope="module")
def built(spark, data_root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    flow.write_contract_from_folder(spark, data_root, out)
    return out


def test_contract(spark, built):
    rows = sinks.read_contract(spark, f"{built}/contract").collect()
    train = sinks.read_contract(spark, f"{built}/contract", train_only=True).collect()
    assert len(rows) == 12 and len(train) == 6 and {r["anomaly_type"] for r in train} == {"Normal"}
    fault = sorted((r for r in rows if r["case_id"] == "Lv_P_DISKIO" and r["endpoint_key"] == TRAVEL), key=lambda r: r["timestamp_window_ms"])
    assert [r["phase"] for r in fault] == ["baseline", "inject", "recover"]
    take = lambda column: [r[column] for r in fault]
    assert take("endpoint_red__trace_request_count") == [0.75, 1.25, 0.25]
    assert take("endpoint_red__trace_latency_p95")[1] == 14.0
    assert take("endpoint_red__trace_5xx_rate") == [0.0, 1.0, 0.0]
    assert take("endpoint_red__latency_divergence") == pytest.approx([1.0, 1.0, 1.0])
    assert take("service_metric__cpu_usage_rate") == [0.0, pytest.approx(1.0), None]
    assert take("service_log__event_rate") == [None, None, None]
    normal = next(r for r in train if r["endpoint_key"] == TRAVEL and r["timestamp_window_ms"] == N0)
    assert normal["sample_id"] == f"Normal__{TRAVEL}__{N0}"
    assert normal["service_log__error_ratio"] == 0.0 and normal["service_name"] == "ts-travel-service"


def test_logs_join_in_their_own_time_zone(spark, data_root):
    sources = flow.sources_from_folder(spark, data_root, timezone="Asia/Shanghai")
    wide = flow.build_wide(sources).where("case_id = 'Normal'").collect()
    first = [r for r in wide if r["timestamp_window_ms"] == N0]
    assert {(r["service_log__event_rate"], r["service_log__error_ratio"], r["service_log__template_diversity"]) for r in first} == {(2.0, 0.5, 0.5)}


def test_score_and_evaluate(spark, built, tmp_path):
    flow.write_scores_from_contract(spark, f"{built}/contract", str(tmp_path / "scores"))
    scores = files.read_table(spark, str(tmp_path / "scores"))
    assert scores.count() == 12 and scores.where("y_true = 1").count() == 2
    flow.write_metrics_from_scores(spark, str(tmp_path / "scores"), str(tmp_path / "metrics"))
    document = json.loads(spark.read.text(str(tmp_path / "metrics")).first()[0])
    assert document["n_samples"] == 12 and 0 <= document["auroc"] <= 1
    assert set(document["stratified"]["by_anomaly_type"]) == {"Normal", "Lv_P_DISKIO"}
    assert document["label_distribution"] == {"n_pos": 2, "n_neg": 10, "pos_rate": pytest.approx(1 / 6)}
    assert set(document["score_stats"]) == {"mean", "std", "min", "max", "p50", "p90", "p99"}


def test_missing_modalities_stay_null(spark, data_root):
    sources = flow.sources_from_folder(spark, data_root, with_metrics=False, with_logs=False)
    row = flow.build_wide(sources).first()
    assert all(row[f"service_metric__{f}"] is None for f in K.METRIC_FEATURES)


def test_no_normal_case_is_an_error(spark, data_root, tmp_path):
    import shutil

    shutil.copytree(f"{data_root}/case two", tmp_path / "case two")
    with pytest.raises(ValueError, match="Normal"):
        flow.write_contract_from_folder(spark, str(tmp_path), str(tmp_path / "out"))


def test_requests_traces_and_range_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"timestamp":"2026-06-09T02:29:46Z","method":"POST","url":"/a","status_code":200,"latency_ms":7.5}\n')
    assert files.read_requests(spark, str(tmp_path / "r.jsonl")).first()["latency_ms"] == 7.5
    (tmp_path / "t.json").write_text(json.dumps([{"trace_id": "1", "spans": [{"type": "Entry", "endpoint_name": "GET:/a"}], "summary": {"endpoint_names": []}}]))
    assert files.read_traces(spark, str(tmp_path / "t.json")).first()["spans"][0]["type"] == "Entry"
    folder = tmp_path / "run" / "test" / "metrics"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps([{"metric": {"__name__": "up", "job": "node"}, "values": [[10, "1"], [20.5, "2"]]}]))
    (folder / "bad.json").write_text("{oops")
    long = profile.prom_long(files.read_range_results(spark, str(folder / "*.json"))).orderBy("position").collect()
    assert [(r["run_end"], r["test_name"], r["metric_name"], r["timestamp"], r["value"]) for r in long] == [
        ("run", "test", "up", "10", "1"), ("run", "test", "up", "20.5", "2")]


def result_json(i):
    text = 'a "quoted" {"metric": [} text' if i % 5 == 0 else "plain ü"
    nested = {"metric": {"metric": {"metric": i}}, "list": [{"metric": 1}, {"metric": 2}]} if i % 7 == 0 else {}
    values = [[i, str(i)], [i + 0.5, "{}"]] * (i % 4)
    return {"metric": {"__name__": f"m{i}", "job": "node", "note": text}, "values": values, "more": nested}


@pytest.mark.parametrize("indent", [None, 1])
def test_large_json_arrays_are_read_by_many_tasks(spark, tmp_path, indent):
    """Nested records that open alike, braces in strings, a record longer than a split."""
    from test_entry import finished

    folder = tmp_path / "run" / "a test" / "metrics"
    folder.mkdir(parents=True)
    many = [result_json(i) for i in range(1, 400)]
    many.insert(200, {"metric": {"__name__": "wide", "job": "node", "note": "x" * 30_000}, "values": [[1, "1"]]})
    texts = {"many.json": json.dumps(many, indent=indent), "few.json": json.dumps(many[:3]), "one.json": json.dumps(many[0])}
    texts["cut.json"] = json.dumps(many[:100], indent=indent)[:-10]
    texts["broken.json"] = json.dumps(many[:100], indent=indent).replace("m50", 'm5"0', 1)
    texts["open.json"] = json.dumps(many[:100], indent=indent)[:-1]
    texts["commas.json"] = json.dumps(many[:100], indent=indent).replace("}, {", "},, {").replace("},\n {", "},,\n {")
    for name, text in texts.items():
        (folder / name).write_text(text)
    want = sorted((n, r["metric"]["__name__"], r["metric"]["note"], len(r["values"])) for n in ("many.json", "few.json") for r in json.loads(texts[n]))
    want += [("one.json", "m1", "plain ü", 2)]

    def read(split_bytes):
        back = files.read_range_results(spark, str(folder / "*.json"), "run", split_bytes)
        return back.where("file in ('many.json', 'few.json', 'one.json')" if split_bytes > 4000 else "true")

    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "8k")
    try:
        spark.sparkContext.setJobGroup("pieces", "pieces")
        got = read(4000)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        rows = got.selectExpr("file", "metric['__name__']", "metric['note']", "size(values)").collect()
        tasks = max(a.numTasks() for a in finished(spark, "pieces"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, rows)) == sorted(want)
    assert tasks > len(texts["many.json"]) / 8192
    whole = read(1 << 20).selectExpr("file", "metric['__name__']", "metric['note']", "size(values)").collect()
    assert sorted(map(tuple, whole)) == sorted(want)


def test_text_csv_round_trip_and_line_files(spark, tmp_path):
    df = spark.createDataFrame([("9", "a"), ("10", "b")], "timestamp string, v string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = files.read_text_csv(spark, str(tmp_path / "csv"))
    assert back.dtypes == [("timestamp", "string"), ("v", "string")] and back.count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x-1.log").write_text("INFO\n")
    got = files.read_line_files(spark, str(tmp_path / "d" / "*.log")).first()
    assert tuple(got) == ("d", "x-1.log", "INFO")


def test_materialize(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "t")
    got = sinks.materialize(df, str(tmp_path / "m"), ["t"])
    assert got.count() == 100 and got.dtypes == df.dtypes


def test_cache_reads_only_what_changed(spark, tmp_path):
    from test_entry import finished

    folder = tmp_path / "c" / "metric_data"
    folder.mkdir(parents=True)
    store, paths = str(tmp_path / "cache"), str(folder / "*.csv")
    head = "metric_name,timestamp,value,pod,interface,extra\n"

    def write(name, rows, value):
        (folder / name).write_text(head + "".join(f"m,{t},{value},p,i,x\n" for t in range(rows)))

    def run(end=1000, names=("m",)):
        group = f"cache-{len(list(tmp_path.glob('cache/manifest/*')))}-{end}"
        bounds = spark.createDataFrame([("c", 0, end * 1000)], "case_id string, start_ms long, end_ms long")
        spark.sparkContext.setJobGroup(group, group)
        manifest = cache.refresh(spark, paths, bounds, store, list(names))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        csv = [a.inputRecords() for a in finished(spark, group) if a.inputRecords() >= 50]
        sums = {r[0]: r[1] for r in cache.read_samples(spark, store).groupBy("metric_file").agg({"value": "sum"}).collect()}
        return sum(csv), {r["path"].rsplit("/", 1)[-1]: r["run"] for r in manifest.collect()}, sums

    with pytest.raises(FileNotFoundError):
        cache.read_samples(spark, store)
    write("a.csv", 100, 1)
    write("b.csv", 60, 1)
    read, runs, sums = run()
    assert runs == {"a.csv": 1, "b.csv": 1} and sums == {"a.csv": 100.0, "b.csv": 60.0} and 160 <= read <= 162
    assert run()[0] == 0
    write("new.csv", 70, 2)
    read, runs, sums = run()
    assert runs == {"a.csv": 1, "b.csv": 1, "new.csv": 3} and sums["new.csv"] == 140.0 and 70 <= read <= 71
    write("b.csv", 80, 3)
    (folder / "a.csv").unlink()
    read, runs, sums = run()
    assert runs == {"b.csv": 4, "new.csv": 3} and sums == {"b.csv": 240.0, "new.csv": 140.0}
    read, runs, sums = run(end=9)
    assert runs == {"b.csv": 5, "new.csv": 5} and sums == {"b.csv": 30.0, "new.csv": 20.0}
    assert cache.drop_old_versions(spark, store) == 4 and cache.drop_old_versions(spark, store) == 0
    assert run(end=9)[2] == {"b.csv": 30.0, "new.csv": 20.0}
    assert run(end=9, names=["other"])[2] == {}
    for last in sorted(tmp_path.glob("cache/manifest/run=*"), key=lambda p: int(p.name[4:]))[-1:]:
        (last / "_SUCCESS").unlink()  # a run that was cut off while writing its manifest
    assert {r["metric_file"] for r in cache.read_samples(spark, store).collect()} == {"b.csv", "new.csv"}


def test_what_a_path_says_is_worked_out_once_a_file(spark, tmp_path):
    from test_entry import plan

    folder = tmp_path / "case a+%41" / "metric_data"
    folder.mkdir(parents=True)
    (folder / "m 1.csv").write_text(",".join(files.METRIC_COLUMNS) + "\n" + ",".join("1" for _ in files.METRIC_COLUMNS) + "\n")
    samples = files.read_metric_samples(spark, str(tmp_path / "*" / "metric_data" / "*.csv"), source="_source")
    assert {(r["case_id"], r["metric_file"], r["_source"].split("/")[-3]) for r in samples.collect()} == {("case a+%41", "m 1.csv", "case a+%41")}
    (folder / "m").mkdir()
    (folder / "m" / "r 1.json").write_text('[{"metric": {"job": "node"}, "values": [["1", "2"]]}]')
    results = files.read_range_results(spark, str(folder / "m" / "*.json"))
    assert [tuple(r)[:3] for r in results.collect()] == [("case a+%41", "metric_data", "r 1.json")]
    for read in (samples, results):
        assert "url_decode" not in plan(read).lower() and "UrlCodec" not in plan(read)
