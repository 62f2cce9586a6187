"""Messages, token counts, run sampling, profiles, exports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowguard.functions import scalars as S
from windowguard.operators import profile, textmodels


def test_message_features(spark):
    df = spark.createDataFrame([("Took 120 ms at 07é",), (None,)], "m string")
    got = textmodels.message_features(df, "m").collect()
    assert len(got) == 1
    row = got[0]
    assert (row["e_message_len"], row["e_message_normalized"]) == (18, "took 0 ms at 0é")
    assert row["e_words"] == ["took", "0", "ms", "at", "0é"]
    text = row["e_message_normalized"]
    assert row["e_trigrams"] == [text[i : i + 3] for i in range(len(text) - 2)]
    by_word = textmodels.message_features(df, "m", "word").first()["e_trigrams"]
    assert by_word == ["took 0 ms", "0 ms at", "ms at 0é"]
    short = spark.createDataFrame([("ab",), ("",)], "m string")
    assert [r["e_trigrams"] for r in textmodels.message_features(short, "m").collect()] == [[], []]


def tokens(spark, data):
    rows = [(seq, text.split()) for seq, text in data]
    return textmodels.sequence_tokens(spark.createDataFrame(rows, "seq string, words array<string>"), "seq", "words")


def test_oov_and_rarity(spark):
    train = tokens(spark, [("a", "x y y"), ("a", "z"), ("b", "x")])
    test = tokens(spark, [("t", "x y new new"), ("u", "x"), ("v", "odd")])
    assert sorted(map(tuple, train.collect())) == [("a", "x", 1), ("a", "y", 2), ("a", "z", 1), ("b", "x", 1)]
    oov = {r["seq"]: (r["n_tokens"], r["oov_count"]) for r in textmodels.oov_score(train, test, "seq").collect()}
    assert oov == {"t": (4, 2), "u": (1, 0), "v": (1, 1)}
    rarity = {r["seq"]: r["rarity"] for r in textmodels.rarity_score(train, test, "seq").collect()}
    assert rarity["t"] == pytest.approx(math.log(2)) and rarity["u"] == 0 and rarity["v"] == 0


def test_scores_by_group(spark):
    train = tokens(spark, [("a", "x"), ("b", "x y")]).withColumn("g", F.lit(1))
    train = train.unionByName(tokens(spark, [("c", "q")]).withColumn("g", F.lit(2)))
    test = tokens(spark, [("t", "x q")])
    test = test.withColumn("g", F.explode(F.array(F.lit(1), F.lit(2))))
    oov = textmodels.oov_score(train, test, "seq", ["g"]).collect()
    assert sorted((r["g"], r["oov_count"]) for r in oov) == [(1, 1), (2, 1)]
    rarity = textmodels.rarity_score(train, test, "seq", ["g"]).collect()
    assert {r["g"]: r["rarity"] for r in rarity} == {1: 0.0, 2: 0.0}


def test_split_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, test = textmodels.split_by_hash(df, "k", 0.5)
    again = textmodels.split_by_hash(df.repartition(7), "k", 0.5)[1]
    assert train.count() + test.count() == 1000 and 400 < test.count() < 600
    assert {r[0] for r in test.collect()} == {r[0] for r in again.collect()}


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_vocabulary_index_is_dense(spark, heavy_rows):
    train = tokens(spark, [("a", " ".join(f"w{i}" for i in range(50)))])
    got = textmodels.indexed_vocabulary(train, heavy_rows).collect()
    assert sorted(r["index"] for r in got) == list(range(50))


def test_vectors(spark):
    train = tokens(spark, [("a", "x y y"), ("b", "x")])
    test = tokens(spark, [("t", "y y y new"), ("v", "odd")])
    index = {r["token"]: r["index"] for r in textmodels.indexed_vocabulary(train).collect()}
    counted, probe = textmodels.vectorize(train, test, "seq", "count")
    rows = {r["seq"]: r["features"].toArray() for r in counted.unionByName(probe).collect()}
    assert rows["a"][index["y"]] == 2 and rows["a"][index["x"]] == 1
    assert rows["t"][index["y"]] == 3 and rows["t"].sum() == 3 and rows["v"].sum() == 0
    tfidf = {r["seq"]: r["features"].toArray() for r in textmodels.vectorize(train, test, "seq")[0].collect()}
    y, x = 2 * (math.log(3 / 2) + 1), 1.0
    assert tfidf["a"][index["y"]] == pytest.approx(y / math.hypot(x, y))
    assert np.linalg.norm(tfidf["a"]) == pytest.approx(1)
    with pytest.raises(ValueError):
        textmodels.vectorize(train, test, "seq", "other")


@pytest.mark.parametrize("model", ["kmeans", "tree", "logistic"])
def test_models_rank_anomalies_first(spark, model):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense([0.1 * (i % 3), 0.0]), 0.0) for i in range(20)]
    rows += [(Vectors.dense([5.0, 5.0 + i % 2]), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, ["features", "label"])
    train = df.where("label = 0") if model == "kmeans" else df
    got = textmodels.fit_predict(train, df, model).collect()
    normal = max(r["score"] for r in got if r["label"] == 0)
    assert min(r["score"] for r in got if r["label"] == 1) > normal
    with pytest.raises(ValueError):
        textmodels.fit_predict(train, df, "forest")


def run_index(spark):
    data = [(f"r{r}", t, s) for r in range(6) for t in ("correct", "e1", "e2", "e3", "e4") for s in ("token", "user")]
    return spark.createDataFrame(data, "run string, test_name string, service string")


def test_run_sampling(spark):
    index = run_index(spark)
    chosen = textmodels.sample_runs(index, 3, 2).collect()
    by_run = {}
    for r in chosen:
        by_run.setdefault(r["run"], set()).add(r["test_name"])
    assert len(by_run) == 3 and len(chosen) == 3 * 3 * 2
    assert all("correct" in tests and len(tests) == 3 for tests in by_run.values())
    again = textmodels.sample_runs(index.repartition(5), 3, 2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))
    single = textmodels.sample_runs(index, 2, 1, error_type="e2", service="user").collect()
    assert {r["test_name"] for r in single} == {"correct", "e2"} and {r["service"] for r in single} == {"user"}
    distinct = textmodels.sample_runs(index, 2, 2, dup_errors=False).where("test_name <> 'correct'")
    kinds = distinct.groupBy("test_name").agg(F.count_distinct("run").alias("runs")).collect()
    assert len(kinds) == 4 and all(k["runs"] == 1 for k in kinds)


@pytest.mark.parametrize(
    "line, kind",
    [
        ("x DEBUG INFO", "DEBUG"), ("WARN: INFO", "INFO"), ("WARN", "WARN"), ("an ERROR", "ERROR"),
        ("  at com.a.B$1.run(B.java:10)", "STACKTRACE"), ("java.io.IOException: no", "EXCEPTION"), ("else", "OTHER"),
    ],
)
def test_line_type(spark, line, kind):
    assert spark.createDataFrame([(line,)], "l string").select(S.line_type(F.col("l"))).first()[0] == kind


def test_log_type_counts_and_pivot(spark):
    data = [("light-oauth2-oauth2-user-1.log", "INFO a"), ("light-oauth2-oauth2-user-1.log", "INFO b"),
            ("light-oauth2-oauth2-key-1.log", "b"), ("light-oauth2-oauth2-key-1.log", "  ")]
    typed = profile.log_types(spark.createDataFrame(data, "file_name string, line string"))
    user, key = "light-oauth2-oauth2-user", "light-oauth2-oauth2-key"
    got = {(r["base_filename"], r["log_type"]): r["count"] for r in profile.log_type_counts(typed).collect()}
    assert got == {(None, "INFO"): 2, (None, "OTHER"): 1, (user, None): 2, (key, None): 1, (user, "INFO"): 2, (key, "OTHER"): 1}
    pivot = profile.log_type_pivot(typed)
    assert pivot.columns == ["log_type", "key", "user"]
    assert [tuple(r) for r in pivot.collect()] == [("INFO", 0, 2), ("OTHER", 1, 0)]


def test_file_size_stats(spark):
    data = [("d/light-oauth2-data-1/correct/a.log", 1024), ("d/light-oauth2-data-1/err/a.log", 2048),
            ("d/light-oauth2-data-2/err/a.log", 4096), ("d/light-oauth2-data-1/err/b.log", 512),
            ("d/light-oauth2-data-1/err/metric_x.json", 9), ("d/light-oauth2-data-1/err/last_fetch_time.txt", 9), ("other/a.log", 7)]
    df = spark.createDataFrame(data, "path string, size long")
    got = [tuple(r) for r in profile.file_size_stats(df, "error").collect()]
    assert got == [("a.log", 2, 3.0, 3.0, pytest.approx(2**0.5), 2.0, 4.0), ("b.log", 1, 0.5, 0.5, 0.0, 0.5, 0.5)]
    assert [r["count"] for r in profile.file_size_stats(df, "both").collect()] == [3, 1]
    assert [r["count"] for r in profile.file_size_stats(df, "correct").collect()] == [1]
    with pytest.raises(ValueError):
        profile.file_size_stats(df, "none")


def test_empty_profile(spark):
    data = [("run/t1/a.log", 0), ("run/t1/b.CSV", 58), ("run/t2/a.log", 5), ("run/t2/x/c.csv", 58),
            ("run/t2/jaeger-container.log", 0), ("run/.git/y.log", 0), ("run/t3/", 0), ("run/t2/d.log", 58)]
    df = spark.createDataFrame(data, "path string, size long")
    got = {r["name"]: (r["count"], r["type"]) for r in profile.empty_profile(df).collect()}
    assert got == {"a.log": (1, "file"), "b.CSV": (1, "file"), "c.csv": (1, "file"), "jaeger-container.log": (1, "file"),
                   "y.log": (1, "file"), "t1": (1, "dir"), "x": (1, "dir"), "t3": (1, "dir")}
    assert profile.empty_breakdown(df).first().asDict() == {
        "empty_dirs": 3, "empty_csv_files": 2, "other_empty_files": 3, "expected_empty": 1, "unexpected_empty": 7}


def test_trim_lines(spark):
    name = "light-oauth2-oauth2-user-1.log"
    data = [(f"r/{t}/{name}", i, f"l{i}") for t in ("correct", "error", "metrics") for i in range(115)]
    data += [("r/error/other.log", i, "x") for i in range(200)]
    df = spark.createDataFrame(data, "path string, line_no int, line string")
    got = {}
    for r in profile.trim_lines(df).collect():
        got.setdefault(r["path"], []).append(r["line_no"])
    assert {k: sorted(v) for k, v in got.items()} == {f"r/correct/{name}": [100, 101], f"r/error/{name}": list(range(100, 115))}


def test_prometheus_export(spark):
    data = [
        ("r", "t", {"__name__": "up", "job": "node", "instance": "i", "mode": "idle", "cpu": "0"}, [["10", "1"], ["20", "2"]]),
        ("r", "t", {"__name__": "up", "job": "node", "group": "g"}, [["10", "5"]]),
        ("r", "t", {"__name__": "up", "job": "node"}, [["10", "6"]]),
        ("r", "t", {"__name__": "up", "job": "other"}, [["10", "9"]]),
        ("r", "t", None, None),
    ]
    df = spark.createDataFrame(data, "run_end string, test_name string, metric map<string,string>, values array<array<string>>")
    long = profile.prom_long(df)
    assert {r["metric_name"] for r in long.collect()} == {"up&mode=idle&cpu=0", "up"}
    numbered = long.withColumn("file", F.col("value"))
    wide = profile.prom_wide(numbered, ["run_end", "test_name"], ["file", "position"]).orderBy("timestamp")
    assert wide.columns == ["run_end", "test_name", "timestamp", "up", "up&mode=idle&cpu=0"]
    assert [tuple(r) for r in wide.collect()] == [("r", "t", "10", "6", "1"), ("r", "t", "20", None, "2")]


def test_merge_is_sorted_as_text_or_number(spark):
    a = spark.createDataFrame([("9", "x"), ("10", "y")], "timestamp string, v string")
    b = spark.createDataFrame([("z", "8")], "v string, timestamp string")
    assert [r["timestamp"] for r in profile.merge_sorted([a, b], "timestamp").collect()] == ["10", "8", "9"]
    assert [r["timestamp"] for r in profile.merge_sorted([a, b], "timestamp", numeric=True).collect()] == ["8", "9", "10"]


def test_positional_split(spark):
    df = spark.range(30).withColumn("t", F.floor(F.col("id") / 4))
    got = profile.positional_split(df, ["t", "id"], 13).collect()
    assert {r["id"] for r in got if r["part"] == "head"} == set(range(13))
    few = profile.positional_split(df.where("id < 5"), ["id"], 13)
    assert few.where("part = 'tail'").count() == 0


def test_pca_and_loadings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * np.array([5.0, 1.0, 0.2])
    df = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>")
    loadings, variance = profile.fit_pca(df, "v", ["a", "b", "c"])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = variance.orderBy("component").collect()
    assert [r["ratio"] for r in got] == pytest.approx(values / values.sum())
    assert got[-1]["cumulative"] == pytest.approx(1)
    top = profile.top_loadings(loadings, 2, 1).orderBy("component").collect()
    assert [r["feature"] for r in top] == ["a", "b"]
    assert [r[0] for r in profile.selected_features(loadings, 2, 1).collect()] == ["a", "b"]


def test_service_logs_skip_metrics_folders_and_other_files(spark):
    rows = [("run/a", "svc-shop-1.log", "x"), ("run/metrics", "svc-shop-1.log", "x"), ("run/a", "svc-shop.txt", "x"), ("run/a", "other-1.log", "x")]
    lines = spark.createDataFrame(rows, "subdirectory string, file_name string, line string")
    assert [tuple(r) for r in profile.service_logs(lines, "shop").collect()] == [rows[0]]


def test_nearest_center_of_sparse_and_dense_vectors(spark):
    from pyspark.ml.linalg import Vectors

    centers = [[0.0, 3.0, 0.0], [1.0, 0.0, -4.0]]
    points = [Vectors.sparse(3, [1], [3.0]), Vectors.dense([1.0, 0.0, 0.0]), Vectors.sparse(3, [], [])]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)], ["id", "features"])
    got = {r["id"]: r["score"] for r in textmodels.nearest_center(rows, centers).collect()}
    want = {i: min(sum((a - b) ** 2 for a, b in zip(p.toArray(), c)) ** 0.5 for c in centers) for i, p in enumerate(points)}
    assert got == pytest.approx(want)


def test_vectors_are_stored_and_sparse(spark):
    train = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 1)], "s long, token string, n long")
    test = spark.createDataFrame([(3, "a", 1), (3, "z", 5), (4, "z", 1)], "s long, token string, n long")
    made, other = textmodels.vectorize(train, test, "s", "count")
    assert sorted(sum(r["features"].toArray()) for r in made.collect()) == [1.0, 3.0]
    vectors = {r["s"]: r["features"] for r in other.collect()}
    assert vectors[3].size == 2 and list(vectors[3].values) == [1.0] and len(vectors[4].values) == 0
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_wide_lines_of_very_many_series(spark):
    import csv

    rows = [("r", f"m{i:05d}", t, f"{i}.{t}", 0) for t in range(3) for i in range(t, 20_000, t * 7_000 + 1)]
    rows += [("r", "m00000", 0, "later", 1), ("s", 'odd,"name"', 5, 'a"b', 0), ("s", "m00007", 6, None, 0)]
    schema = "run string, metric_name string, timestamp string, value string, position int"
    long = spark.createDataFrame([(r, n, str(t), v, p) for r, n, t, v, p in rows], schema)
    names = profile.prom_dictionary(long)
    lines = profile.prom_wide_lines(long, ["run"], ["position"], names)
    assert len(lines._jdf.queryExecution().executedPlan().toString()) < 100_000
    header = next(csv.reader([profile.prom_header(names).first()["line"]]))
    assert header == ["timestamp", *sorted({r[1] for r in rows})] and len(header) == 20_002
    got = {(r["run"], r["timestamp"]): next(csv.reader([r["line"]])) for r in lines.collect()}
    want = {}
    for run, name, time, value, _ in rows:
        want.setdefault((run, str(time)), {})[name] = value
    assert set(got) == set(want)
    for key, cells in got.items():
        assert cells[0] == key[1] and cells[1:] == [want[key].get(n) or "" for n in header[1:]]


def test_words_unseen_are_found_without_sorting_the_cells(spark):
    from test_entry import plan

    train = spark.createDataFrame([("s", 1, "a", 1), ("s", 1, "b", 2)], "source string, seq int, token string, n int")
    test = spark.createDataFrame([("s", 2, "a", 1), ("s", 2, "c", 3), ("t", 3, "a", 2), ("s", 4, None, 1)], "source string, seq int, token string, n int")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        scored = textmodels.oov_score(train, test, "seq", ["source"])
        text = plan(scored)
    finally:
        spark.conf.unset(threshold)
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    assert {tuple(r) for r in scored.collect()} == {("s", 2, 4, 3), ("t", 3, 2, 2), ("s", 4, 1, 1)}


def test_logistic_regression_in_a_session_that_has_observed_a_table(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = spark.createDataFrame([(Vectors.dense([float(i)]), float(i > 5 or i == 2)) for i in range(10)], ["features", "label"])
    got = textmodels.fit_predict(rows, rows, "logistic").orderBy("score").collect()
    assert [r["features"][0] for r in got] == [float(i) for i in range(10)]
