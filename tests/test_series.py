import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowguard.operators import series


def skewed(n=3000, seed=7):
    """Values of three groups, one holding most rows and one value a third of them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if i % 10 < 8 else ("warm" if i % 10 == 8 else "cold")
        value = 5.0 if i % 3 == 0 else round(rng.lognormvariate(1, 1), 2)
        out.append((group, value, rng.randint(0, 1)))
    return out


@pytest.mark.parametrize("heavy_rows", [1, 50, 10**9])
@pytest.mark.parametrize("keys", [["g"], []])
def test_prefix_sums_equal_brute_force(spark, heavy_rows, keys):
    data = skewed()
    df = spark.createDataFrame(data, "g string, v double, y int")
    counts = df.groupBy(*keys, "v").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    got = series.prefix_sums(counts, keys, "v", ["n", "p"], heavy_rows).collect()
    groups = defaultdict(list)
    for g, v, y in data:
        groups[g if keys else ""].append((v, y))
    assert len(got) == sum(len({v for v, _ in rows}) for rows in groups.values())
    for r in got:
        rows = groups[r["g"] if keys else ""]
        assert r["n_before"] == sum(1 for v, _ in rows if v < r["v"])
        assert r["p_before"] == sum(y for v, y in rows if v < r["v"])
        assert r["n_total"] == len(rows)
        assert r["p_total"] == sum(y for _, y in rows)


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_quantiles_equal_numpy(spark, heavy_rows):
    data = skewed(1001)
    df = spark.createDataFrame(data, "g string, v double, y int")
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for r in series.quantiles(df, ["g"], "v", probs, heavy_rows).collect():
        values = [v for g, v, _ in data if g == r["g"]]
        for name, q in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, q))


def test_quantiles_skip_null_and_null_groups(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), (None, 9.0)], "g string, v double")
    assert rows(series.quantiles(df, ["g"], "v", {"m": 0.5})) == [("a", 2.0)]


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(skewed(), "g string, v double, y int")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = series.quantiles(df.repartition(int(n)), ["g"], "v", {"m": 0.5, "p": 0.9}, 10)
        results.append(sorted(map(tuple, got.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


WINDOWS = [0, 10, 20, 50, 60, 110, 120, 130, 300]


@pytest.mark.parametrize("chunk", [1, 2, 3, 1000])
def test_previous_row_crosses_chunks(spark, chunk):
    data = [(k, w, float(w)) for k in ("a", "b") for w in WINDOWS]
    df = spark.createDataFrame(data, "k string, w long, v double")
    got = series.previous_row(df, ["k"], "w", ["v"], 10, chunk).orderBy("k", "w").collect()
    assert len(got) == 2 * len(WINDOWS)
    expected = [None, *map(float, WINDOWS[:-1])]
    assert [r["previous_v"] for r in got] == expected * 2


def test_previous_row_keeps_a_missing_value_missing(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 10, None), ("a", 20, 3.0)], "k string, w long, v double")
    for chunk in (1, 10):
        got = series.previous_row(df, ["k"], "w", ["v"], 10, chunk).orderBy("w").collect()
        assert [r["previous_v"] for r in got] == [None, 1.0, None]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
@pytest.mark.parametrize("length", [1, 2, 4, 9])
def test_sequences_are_whole_across_chunks(spark, chunk, length):
    data = [("a", w, w * 2) for w in WINDOWS] + [("b", 0, 0), ("b", 10, 20)]
    df = spark.createDataFrame(data, "k string, w long, v long")
    got = series.sequences(df, ["k"], "w", ["v"], length, 10, chunk).collect()
    found = sorted((r["k"], tuple((s["w"], s["v"]) for s in r["steps"])) for r in got)
    expected = []
    for key in ("a", "b"):
        own = [(w, v) for k, w, v in data if k == key]
        expected += [(key, tuple(own[i : i + length])) for i in range(len(own) - length + 1)]
    assert found == sorted(expected)


def test_sequence_counts_and_length_check(spark):
    data = [("a", w) for w in range(5)] + [("b", w) for w in range(2)]
    df = spark.createDataFrame(data, "k string, w long")
    got = series.sequences(df, ["k"], "w", [], 4, 1)
    assert got.groupBy("k").count().collect()[0]["count"] == 2
    assert got.where("k = 'b'").count() == 0
    with pytest.raises(ValueError):
        series.sequences(df, ["k"], "w", [], 0, 1)


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_fill_windows(spark, rows, chunk):
    df = spark.createDataFrame([("a", 0, 3), ("a", 30, 1), ("b", 50, 2)], "k string, w long, n long")
    got = series.fill_windows(df, ["k"], "w", 10, ["n"], chunk)
    assert rows(got, "k", "w", "n") == sorted(
        [("a", 0, 3), ("a", 10, 0), ("a", 20, 0), ("a", 30, 1), ("b", 50, 2)], key=lambda r: tuple(map(str, r))
    )


def test_every_heavy_group_is_split(spark):
    df = spark.range(6000).selectExpr("id % 1500 as g", "cast(id div 1500 as double) as v", "id + 1 as n")
    got = series.prefix_sums(df, ["g"], "v", ["n"], heavy_rows=2)
    bad = got.where("n_before != v * (g + 1) + 1500 * v * (v - 1) / 2 or n_total != 4 * (g + 1) + 9000")
    assert got.count() == 6000 and bad.count() == 0


def test_numbered_rows_with_a_frequent_value(spark):
    df = spark.range(2000).selectExpr("cast(if(id % 3 = 0, 7, id) as string) as v", "id % 2 as w").repartition(5)
    got = series.numbered(df, ["v", "w"]).collect()
    assert sorted(r["position"] for r in got) == list(range(2000))
    in_order = [(r["v"], r["w"]) for r in sorted(got, key=lambda r: r["position"])]
    assert in_order == sorted(in_order)
    assert series.numbered(df.limit(0), ["v"]).count() == 0
