import hashlib
import itertools
import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import logs, metrics

T0 = 1_780_972_185
SAMPLE = "case_id string, metric_name string, timestamp double, value double, pod string, interface string"
ROUTE_1, ROUTE_2 = "ts-route-service-5cfc4ffd99-nxnpc", "ts-route-service-5cfc4ffd99-v444n"
ORDER = "ts-order-service-5cfc4ffd99-aaaaa"
SERVICES = ["ts-route-service", "ts-order-service"]


def samples(spark):
    out = []

    def add(metric, t, value, pod=None, interface=None):
        out.append(("c", metric, float(T0 + t), float(value), pod, interface))

    for t, one, two in ((0, 201.309582, 210.877123), (15, 203.149287, 212.291345)):
        add(K.CPU_COUNTER, t, one, ROUTE_1)
        add(K.CPU_COUNTER, t, two, ROUTE_2)
        add(K.CPU_COUNTER, t, 5, ORDER)
        add(K.CPU_COUNTER, t, 1, "kube-proxy-abcdef1-12345")
        add(K.CPU_COUNTER, t, 1, "")
        for interface in ("eth0", "eth1"):
            add(K.NET_RX_ERRORS, t, 1.095 if t == 0 else 1.215, None, interface)
    add(K.MEMORY_USAGE, 0, 200, ROUTE_1)
    add(K.MEMORY_LIMIT, 0, 500, ROUTE_1)
    add(K.MEMORY_USAGE, 0, 900, ROUTE_2)
    add(K.MEMORY_LIMIT, 0, 0, ROUTE_2)
    return spark.createDataFrame(out, SAMPLE)


def test_service_features(spark):
    got = {
        (r["service_name"], r["timestamp_window_ms"] // 1000 - T0): r
        for r in metrics.metric_features(samples(spark), SERVICES).collect()
    }
    assert set(got) == {(s, t) for s in SERVICES for t in (0, 15)}
    first, second = got["ts-route-service", 0], got["ts-route-service", 15]
    assert first["service_metric__cpu_usage_rate"] == 0
    assert second["service_metric__cpu_usage_rate"] == pytest.approx(0.1084642, abs=1e-7)
    assert first["service_metric__memory_usage_ratio"] == pytest.approx(0.2)
    assert second["service_metric__memory_usage_ratio"] == 0
    for service in SERVICES:
        row = got[service, 15]
        assert row["service_metric__net_rx_error_rate"] == pytest.approx(0.016)
        assert row["service_metric__net_tx_error_rate"] == 0
        assert row["service_metric__process_count"] == 0


def test_process_count_stays_missing_where_the_case_has_some(spark):
    extra = spark.createDataFrame([("c", K.PROCESSES, float(T0), 20.0, ROUTE_1, None)], SAMPLE)
    got = metrics.pod_features(samples(spark).unionByName(extra), SERVICES).collect()
    by = {(r["service_name"], r["timestamp_window_ms"] // 1000 - T0): r["service_metric__process_count"] for r in got}
    assert by["ts-route-service", 0] == 20
    assert by["ts-route-service", 15] is None and by["ts-order-service", 0] is None


def test_rate_ignores_gaps_and_drops(spark):
    data = [("c", "p", w, v) for w, v in ((0, 10.0), (15_000, None), (30_000, 40.0), (60_000, 60.0), (75_000, 5.0))]
    df = spark.createDataFrame(data, "case_id string, pod string, timestamp_window_ms long, cpu double")
    got = metrics.counter_rate(df, ["case_id", "pod"], "cpu", "rate").orderBy("timestamp_window_ms")
    assert [r["rate"] for r in got.collect()] == [0, 0, 0, pytest.approx(20 / 15), 0]


def test_samples_are_kept_inside_the_bounds(spark):
    bounds = spark.createDataFrame([("c", T0 * 1000, (T0 + 15) * 1000)], "case_id string, start_ms long, end_ms long")
    late = spark.createDataFrame(
        [("c", K.CPU_COUNTER, T0 + 15.5, 1.0, ROUTE_1, None), ("c", "other", T0 + 1.0, 1.0, ROUTE_1, None),
         ("d", K.CPU_COUNTER, T0 + 1.0, 1.0, ROUTE_1, None), ("c", K.CPU_COUNTER, T0 - 0.5, 1.0, ROUTE_1, None)],
        SAMPLE,
    )
    all_samples = samples(spark)
    assert metrics.filter_samples(all_samples.unionByName(late), bounds).count() == all_samples.count()


def test_count_in_range_truncates_seconds(spark):
    df = spark.createDataFrame([(1.0,), (2.9,), (3.0,)], "timestamp double")
    assert metrics.count_in_range(df, 1000, 2000).first()[0] == 2


@pytest.mark.parametrize(
    "pod, service",
    [
        (ROUTE_1, "ts-route-service"),
        ("ts-route-service", "ts-route-service"),
        ("-abcdef1-12345", "-abcdef1-12345"),
        ("nacos-0", "nacos-0"),
    ],
)
def test_service_of_pod(spark, pod, service):
    df = spark.createDataFrame([(pod,)], "p string")
    assert df.select(S.service_of_pod(F.col("p"))).first()[0] == service


def lines(spark, texts, case="Normal"):
    data = [(case, "ts-route-service", t) for t in texts]
    return spark.createDataFrame(data, "case_id string, service_name string, line string")


def test_parse_local_time(spark):
    texts = [
        "2026-06-09 10:41:43.491  INFO 1 --- [main] a.b.C   : hello world  ",
        "2026-06-09 10:41:43,491 INFO 1 --- no", "java.lang.X: y", "",
        "2026-13-09 10:41:43.491  INFO 1 --- [main] never",
    ]
    got = logs.parse_logs(lines(spark, texts)).collect()
    assert [(r["ts_ms"], r["level"], r["content"]) for r in got] == [
        (1_780_972_903_491, "INFO", "[main] a.b.C   : hello world")
    ]


def route_log(spark):
    texts = [f"2026-06-09 10:41:4{5 + i % 5}.{i:03d}  {'ERROR' if i < 2 else 'INFO'} 1 --- [m] r : Query id {i}" for i in range(30)]
    texts += [f"2026-06-09 10:42:1{5 + i % 5}.{i:03d}  WARN 1 --- [m] r : Query id {i}" for i in range(20)]
    return logs.parse_logs(lines(spark, texts))


def test_log_features_with_gap(spark):
    parsed = route_log(spark)
    got = logs.log_features(parsed, logs.fit_templates(parsed)).orderBy("timestamp_window_ms").collect()
    assert [r["service_log__event_rate"] for r in got] == [30.0, 0.0, 20.0]
    assert [r["service_log__error_ratio"] for r in got] == [pytest.approx(2 / 30), 0.0, 0.0]
    assert [r["service_log__template_diversity"] for r in got] == [pytest.approx(1 / 30), 0.0, pytest.approx(1 / 20)]
    steps = [r["timestamp_window_ms"] for r in got]
    assert steps[1] - steps[0] == steps[2] - steps[1] == 15_000


def test_unfitted_templates_count_as_one(spark):
    got = logs.log_features(route_log(spark), None).collect()
    assert sorted(r["service_log__template_diversity"] for r in got) == [0.0, pytest.approx(1 / 30), pytest.approx(1 / 20)]


def contents(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def test_templates(spark):
    fit = ["user 1 logged in", "user 2 logged in", "42 items left", "43 items left", "disk full", ""]
    templates = logs.fit_templates(contents(spark, fit))
    shuffled = logs.fit_templates(contents(spark, fit[::-1]).repartition(3))
    assert sorted(map(tuple, templates.collect())) == sorted(map(tuple, shuffled.collect()))
    texts = {r["template"]: r["template_id"] for r in templates.collect()}
    assert set(texts) == {"user <*> logged in", "<*> items left", "disk full", ""}
    probe = ["user 9 logged in", "7 items left", "user 9 logged out", "disk empty", "new one", ""]
    got = {r["content"]: r["template_id"] for r in logs.match_templates(contents(spark, probe), templates).collect()}
    assert got == {
        "user 9 logged in": texts["user <*> logged in"], "7 items left": texts["<*> items left"],
        "user 9 logged out": "-1", "disk empty": "-1", "new one": "-1", "": texts[""],
    }


def test_messages_with_one_first_word_stay_apart(spark):
    fit = ["user ada logged in from home", "user bob logged in from work", "user ada was sent two mails", "user eve was sent two parcels"]
    fit += ["job x ended", "job y ended", "task x ended"]
    templates = logs.fit_templates(contents(spark, fit))
    assert {r["template"] for r in templates.collect()} == {
        "user <*> logged in from <*>", "user <*> was sent two <*>", "job <*> ended", "task x ended",
    }
    strict = logs.fit_templates(contents(spark, fit), similarity=0.9)
    assert {r["template"] for r in strict.collect()} == set(fit)
    texts = {r["template"]: r["template_id"] for r in templates.collect()}
    probe = ["user zoe logged in from town", "user zoe was sent two logs", "user zoe was seen in town", "task x ended", "task y ended"]
    got = [r["template_id"] for r in logs.match_templates(contents(spark, probe), templates).orderBy("content").collect()]
    assert got == ["task x ended" and texts["task x ended"], "-1", texts["user <*> logged in from <*>"], "-1", texts["user <*> was sent two <*>"]]


def test_of_fitting_templates_the_most_constant_is_taken(spark):
    rows = [(3, "a", t, hashlib.md5(t.encode()).hexdigest()) for t in ("a <*> <*>", "a b <*>", "a <*> c")]
    templates = spark.createDataFrame(rows, "n_tokens int, first_token string, template string, template_id string")
    ids = {r[2]: r[3] for r in rows}
    got = {r["content"]: r["template_id"] for r in logs.match_templates(contents(spark, ["a b x", "a x c", "a x y", "a b c"]), templates).collect()}
    assert got == {"a b x": ids["a b <*>"], "a x c": ids["a <*> c"], "a x y": ids["a <*> <*>"], "a b c": min(ids["a b <*>"], ids["a <*> c"])}


def plain_templates(texts, similarity):
    """Single linkage of all pairs of a leaf."""
    lines = {tuple("<*>" if re.search(r"[0-9]", t) else t for t in text.split()) for text in texts}
    root = {line: line for line in lines}

    def find(line):
        while root[line] != line:
            line = root[line]
        return line

    for a, b in itertools.combinations(sorted(lines), 2):
        if len(a) == len(b) and a[:1] == b[:1]:
            equal = sum(x == y != "<*>" for x, y in zip(a, b, strict=True))
            if equal >= math.ceil(similarity * len(a) - 1e-9):
                root[find(b)] = find(a)
    groups = {}
    for line in lines:
        groups.setdefault(find(line), []).append(line)
    return {" ".join(t[0] if len(set(t)) == 1 else "<*>" for t in zip(*g, strict=True)) for g in groups.values()}


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.75])
def test_templates_equal_plain_linkage(spark, similarity):
    dice = random.Random(int(similarity * 100))
    words = ["in", "of", "the", "red", "blue", "open", "shut", "x1", "y2"]
    texts = [" ".join([dice.choice("pq"), *dice.choices(words, [9, 8, 7, 4, 3, 2, 1, 2, 2], k=dice.choice([4, 6, 9]))]) for _ in range(400)]
    texts += [f"r{i} {w} same" for i in range(3) for w in ("in", "of")] + ["", "solo"]
    got = logs.fit_templates(contents(spark, texts), similarity)
    assert Counter(r["template"] for r in got.collect()) == Counter(plain_templates(texts, similarity))


def test_templates_of_large_leaves(spark, monkeypatch):
    from windowguard.operators import logs

    dice = random.Random(3)
    texts = [" ".join(["p", *dice.choices("abcdefgh", [9, 8, 7, 4, 3, 2, 1, 1], k=dice.choice([4, 6, 9]))]) for _ in range(300)]
    monkeypatch.setattr(logs, "LEAF_CELLS", 900)
    got = logs.fit_templates(contents(spark, texts), 0.5)
    assert Counter(r["template"] for r in got.collect()) == Counter(plain_templates(texts, 0.5))


def test_templates_leave_few_tables(spark):
    from windowguard.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    texts = [f"start {a} {b} {c} end{c}x" for a in ("red", "blue") for b in ("fox", "hen", "cow") for c in "uvw"]
    texts += ["start over again my friend", "user ada logged in", "user bob logged in", "alone as it is"]
    got = logs.fit_templates(contents(spark, texts)).collect()
    assert sorted(r["template"] for r in got) == ["alone as it is", "start <*> <*> <*> <*>", "start over again my friend", "user <*> logged in"]
    # Of texts there are the lines and the templates; a line of a leaf of its own is nowhere twice.
    left = {p.name.rsplit("-", 1)[0]: p for p in set(folder.iterdir()) - before}
    assert set(left) == {"log-lines", "log-varied", "log-leaves", "log-whole", "log-mixed"}
    assert "tokens" not in spark.read.parquet(str(left["log-lines"])).columns


def test_frames_written_one_after_the_other_are_one_table(spark):
    from windowguard.session import stage_alone

    got = stage_alone(lambda: [spark.range(3), spark.range(3, 5)], "parts")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_connected_groups(spark):
    from windowguard.operators.components import connected

    pairs = [(i, i + 1) for i in range(60) if i != 29] + [(100 + 3 * i, 100) for i in range(20)] + [(7, 7), (None, 3), (5, 2), (2, 5)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    want = {i: 0 for i in range(30)} | {i: 30 for i in range(30, 61)} | {100 + 3 * i: 100 for i in range(20)}
    assert got == want
    assert connected(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").count() == 0


def test_keys_and_links_of_templates_hold_no_text(spark, monkeypatch):
    from windowguard.operators import logs

    texts = [f"start {a} {b} {c} end{c}x" for a in ("red", "blue") for b in ("fox", "hen", "cow") for c in "uvw"]
    texts += ["start over again my friend"]
    staged = {}
    stage = logs.stage
    monkeypatch.setattr(logs, "stage", lambda df, name: staged.setdefault(name, df) and stage(df, name))
    got = logs.fit_templates(spark.createDataFrame([(t,) for t in texts], "content string")).collect()
    assert sorted(r["template"] for r in got) == ["start <*> <*> <*> <*>", "start over again my friend"]
    for name in ("log-keys", "log-links", "log-rooted"):
        assert {t for _, t in staged[name].dtypes} <= {"int", "bigint"}, name
