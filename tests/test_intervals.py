"""Points against many intervals a key."""

import random

import pytest
from pyspark.sql import functions as F

from windowguard.operators import intervals


def frames(spark, seed):
    dice = random.Random(seed)
    points = [(dice.choice(["a", "b", "c"]), i, dice.choice([dice.randrange(50_000), dice.randrange(-300, 300)])) for i in range(400)]
    points += [(None, 1, 5), ("a", 2, None)]
    spans = []
    for n in range(40):
        start = dice.randrange(-100, 50_000)
        spans.append((dice.choice(["a", "b", "none"]), n, start, start + dice.choice([0, 3, 64, 65, 700, 45_000])))
    spans += [("a", 90, 10, 5), ("a", 91, None, 5), ("b", 92, 5, None), (None, 93, 0, 10**6), spans[0]]
    return points, spans, (
        spark.createDataFrame(points, "k string, id int, t long"),
        spark.createDataFrame(spans, "k string, n int, s long, e long"),
    )


@pytest.mark.parametrize("width", [1, 10, 5000])
def test_inside_equals_all_pairs(spark, width):
    points, spans, (left, right) = frames(spark, width)
    got = intervals.inside(left, right, ["k"], "t", "s", "e", width)
    assert got.columns == ["k", "id", "t", "n", "s", "e"]
    want = [
        (k, i, t, n, s, e) for k, i, t in points for q, n, s, e in spans
        if None not in (k, t, q, s, e) and k == q and s <= t <= e
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    pieces = right.where("s <= e")
    assert got.count() > 0 and pieces.count() > 0


def test_merged(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 2, 3), ("a", 20, 30), ("a", 25, 26), ("b", 1, 1), ("b", 9, 3), ("b", None, 3)]
    got = intervals.merged(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e")
    assert sorted(map(tuple, got.collect())) == [("a", 0, 9), ("a", 20, 30), ("b", 1, 1)]


def test_phases(spark):
    cells = spark.createDataFrame([("f", t) for t in (0, 10, 20, 30, 40, 50)] + [("n", 10)], "case_id string, timestamp_window_ms long")
    spans = spark.createDataFrame([("f", 10, 12), ("f", 11, 20), ("f", 40, 40)], "case_id string, start_ms long, end_ms long")
    got = {(r["case_id"], r["timestamp_window_ms"]): r["phase"] for r in intervals.phases(cells, spans, 10).collect()}
    assert got == {
        ("f", 0): "baseline", ("f", 10): "inject", ("f", 20): "inject", ("f", 30): "recover", ("f", 40): "inject", ("f", 50): "recover",
        ("n", 10): "normal",
    }
    assert {r["phase"] for r in intervals.phases(cells, spans.limit(0), 10).collect()} == {"normal"}


def test_no_nested_loops_and_few_rows_an_interval(spark):
    from test_entry import plan

    _, _, (left, right) = frames(spark, 3)
    text = plan(intervals.inside(left, right, ["k"], "t", "s", "e", 1))
    assert "NestedLoop" not in text and "Cartesian" not in text
    long = spark.createDataFrame([("a", 0, 10**9)], "k string, s long, e long")
    probe = spark.range(0, 10**9, 10**8).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    assert intervals.inside(probe, long, ["k"], "t", "s", "e", 1).count() == 10


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_equals_all_pairs(spark, seed):
    points, spans, (left, right) = frames(spark, seed)
    stretches = intervals.coverage(right, ["k"], "s", "e")
    rows = sorted(map(tuple, stretches.collect()))
    assert all(a[2] < b[1] for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0])
    assert len(rows) <= 2 * len(spans)
    met = intervals.inside(left, stretches, ["k"], "t", "s", "e", 1)
    got = {(r["k"], r["id"]): (r["n_intervals"], r["longest"]) for r in met.collect()}
    want = {}
    for k, i, t in points:
        over = [e - s for q, _, s, e in spans if None not in (k, t, q, s, e) and k == q and s <= t <= e]
        if over:
            want[k, i] = (len(over), max(over))
    assert got == want and met.count() == len(want)
    assert intervals.coverage(right.limit(0), ["k"], "s", "e").isEmpty()


def test_interval_hits_meets_no_more_rows_than_events(spark, tmp_path, monkeypatch):
    from windowguard.plans import service_queries

    # Purchases of one user at one time: every one of the 600 events lies in 300 injections.
    ev = spark.range(600).select(
        F.lit("Lv_S_kill").alias("case_id"), F.col("id").alias("event_id"), (F.col("id") * 2).alias("ts_ms"),
        F.when(F.col("id") < 300, "purchase").otherwise("view").alias("event_type"), F.lit(9).alias("k"),
    )
    met = []
    inside = intervals.inside
    monkeypatch.setattr(service_queries.A, "events", lambda *_: ev)
    monkeypatch.setattr(intervals, "inside", lambda *a: met.append(inside(*a)) or met[-1])
    rows = service_queries.interval_hits(spark, "").collect()
    assert met[0].count() == 600
    assert {r["event_id"]: r["n_intervals"] for r in rows} == {i: min(i + 1, 300) for i in range(600)}
