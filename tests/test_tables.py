"""Labels, normalisation, imputation, validators, scores and metrics."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import evaluate as E
from windowguard.operators import labels, modalities, normalize, oneclass, quality
from windowguard.schemas import ContractConfig, ModalitySpec
from windowguard.sources import sinks

T0 = 1_780_980_000_000


def test_phases_and_labels(spark):
    cells = spark.createDataFrame(
        [(c, "e", T0 + d) for c in ("fault", "Normal", "open", "unknown") for d in (0, 10_000, 20_000, 30_000)],
        "case_id string, endpoint_key string, timestamp_window_ms long",
    )
    cases = spark.createDataFrame(
        [("fault", "Lv_P_x", "performance", "svc", T0 + 10_000, T0 + 20_000),
         ("Normal", "Normal", "none", None, None, None), ("open", "Lv_S_x", None, None, T0, None)],
        "case_id string, anomaly_type string, anomaly_level string, target_service string, inject_start_ms long, inject_end_ms long",
    )
    got = labels.with_identity(labels.with_labels(cells, cases)).orderBy("timestamp_window_ms").collect()
    of = lambda case, column: [r[column] for r in got if r["case_id"] == case]
    assert of("fault", "phase") == ["baseline", "inject", "inject", "recover"]
    assert of("fault", "is_anomaly") == [False, True, True, False]
    assert of("fault", "is_train_eligible") == [True, False, False, True]
    assert set(of("Normal", "phase")) == set(of("open", "phase")) == set(of("unknown", "phase")) == {"normal"}
    assert set(of("open", "anomaly_level")) == {None}
    assert set(of("unknown", "anomaly_type")) == {"Normal"} and set(of("unknown", "anomaly_level")) == {"none"}
    assert of("fault", "window_str")[0] == "2026-06-09T04:40:00Z"
    assert of("fault", "sample_id")[1] == f"fault__e__{T0 + 10_000}"
    counts = labels.phase_counts(labels.with_labels(cells, cases)).where("case_id = 'fault'").first()
    assert (counts["normal"], counts["baseline"], counts["inject"], counts["recover"], counts["total"]) == (0, 1, 2, 1, 4)


def test_anomaly_family(spark):
    names = {"Normal_x": "Normal", "Lv_P_a": "Performance", "Lv_S_a": "Service", "Lv_D_a": "Database", "Lv_C_a": "Code", "z": None}
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = df.select("c", S.anomaly_family(F.col("c"))).collect()
    assert {r[0]: r[1] for r in got} == names


RED = "endpoint_key string, trace_latency_p95 double, trace_error_rate double, trace_5xx_rate double"


def test_mad_baseline_and_weak_labels(spark):
    normal = spark.createDataFrame(
        [("a", v, 0.0, None) for v in (10.0, 12.0, 14.0, 100.0)] + [("b", 5.0, 0.2, 0.1)] * 3, RED
    )
    base = labels.mad_baseline(normal)
    got = {r["endpoint_key"]: r for r in base.collect()}
    assert (got["a"]["p95_median"], got["a"]["p95_mad"]) == (13.0, 2.0)
    assert got["a"]["latency_threshold"] == 19.0 and got["a"]["s5xx_threshold"] is None
    assert got["b"]["latency_threshold"] == pytest.approx(5.5)
    assert got["b"]["error_threshold"] == pytest.approx(0.3) and got["b"]["s5xx_threshold"] == pytest.approx(0.2)
    red = spark.createDataFrame(
        [("a", 20.0, 0.05, 0.9), ("b", 6.0, 0.4, 0.3), ("b", None, 0.4, None), ("new", 1e6, 1.0, 0.5), ("new", 1.0, 1.0, 0.4)],
        RED,
    )
    rows = labels.weak_labels(red, base).collect()
    signals = [
        (r["endpoint_key"], r["latency_anomaly_signal"], r["error_anomaly_signal"], r["5xx_anomaly_signal"], r["weak_is_anomaly"], r["label_confidence"])
        for r in rows
    ]
    assert sorted(signals) == sorted(
        [("a", 1, 0, 0, 1, "low"), ("b", 1, 1, 1, 1, "high"), ("b", 0, 1, 0, 1, "low"),
         ("new", 0, 0, 1, 1, "low"), ("new", 0, 0, 0, 0, "normal")]
    )
    none = labels.weak_labels(red, base.where("false")).collect()
    assert {(r["weak_is_anomaly"], r["label_confidence"]) for r in none} == {(0, "unknown")}


def frame(spark, data):
    return spark.createDataFrame(data, "endpoint_key string, service_name string, x double, y double, z double")


RULES = {"x": "per_endpoint", "y": "per_service", "z": "global"}


def test_minmax(spark, tmp_path):
    normal = frame(spark, [("ep1", "s", float(v), None, 4.0) for v in (0, 10, 20, 30)] + [("ep2", None, 1.0, 5.0, 8.0)])
    stats = normalize.fit_minmax(normal, RULES)
    sinks.write_stats(stats, str(tmp_path / "stats"))
    stats = sinks.read_stats(spark, str(tmp_path / "stats"))
    stored = {(r["feature"], r["group_key"]): (r["lo"], r["hi"]) for r in stats.collect()}
    assert stored == {("x", "ep1"): (0, 30), ("x", "ep2"): (1, 1), ("y", "s"): (None, None), ("z", "__global__"): (4, 8)}
    probe = frame(spark, [("ep1", "s", 10.0, 7.0, 6.0), ("ep1", None, 60.0, 7.0, None), ("new", "t", 60.0, 7.0, 4.0), ("ep2", "s", 1.5, None, 8.0)])
    got = sorted((tuple(r) for r in normalize.apply_minmax(probe, stats, RULES).collect()), key=str)
    expected = [
        ("ep1", "s", pytest.approx(1 / 3), None, 0.5), ("ep1", None, 2.0, 7.0, None),
        ("ep2", "s", pytest.approx(0.5 / 1e-9), None, 1.0), ("new", "t", 60.0, 7.0, 0.0),
    ]
    assert len(got) == 4 and all(row in got for row in expected)
    assert [tuple(r) for r in normalize.unseen_groups(probe, stats, "per_endpoint").collect()] == [("new", 1)]
    with pytest.raises(ValueError):
        normalize.fit_minmax(normal, {"x": "per_planet"})


def test_clip_and_impute(spark):
    df = frame(spark, [("a", "s", -1.0, None, None), ("a", "s", 2.0, 3.0, None), ("a", "s", None, 5.0, None)])
    assert [r["x"] for r in normalize.clip_rates(df, ["x", "absent"]).collect()] == [0.0, 1.0, None]
    mean = normalize.impute(df, ["x", "y", "z"], "mean").collect()
    assert [(r["x"], r["y"], r["z"]) for r in mean] == [(-1.0, 4.0, 0.0), (2.0, 3.0, 0.0), (0.5, 5.0, 0.0)]
    other = frame(spark, [("b", "t", 100.0, 100.0, 7.0)])
    assert [r["z"] for r in normalize.impute(df, ["x", "y", "z"], "mean", fit=other).collect()] == [7.0] * 3
    assert [r["y"] for r in normalize.impute(df, ["x", "y"], "zero").collect()] == [0.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        normalize.impute(df, ["x"], "median")


def contract(spark, **changes):
    config = ContractConfig()
    values = {c: 0.5 for c in config.feature_columns}
    row = {
        "sample_id": "a", "case_id": "c", "endpoint_key": "e", "service_name": "s", "timestamp_window_ms": 1,
        "window_str": "w", **values, "phase": "normal", "is_anomaly": False, "is_train_eligible": True,
        "injection_start_ms": 1, "injection_end_ms": 2, "target_service": "s", "anomaly_type": "Normal", "anomaly_level": "none",
    }
    second = {**row, "sample_id": "b", **changes}
    return spark.createDataFrame([row, second])


def broken(df):
    return sorted(tuple(r) for r in df.collect())


def test_contract_violations(spark):
    assert broken(quality.contract_violations(contract(spark))) == []
    quality.require_valid(quality.contract_violations(contract(spark)), "contract")
    assert broken(quality.contract_violations(contract(spark, sample_id="a"))) == [("duplicate", "sample_id", 1)]
    rate = "endpoint_red__client_error_rate"
    assert broken(quality.contract_violations(contract(spark, **{rate: 1.5}))) == [("outside_0_1", rate, 1)]
    assert broken(quality.contract_violations(contract(spark, **{rate: float("nan")}))) == []
    assert broken(quality.contract_violations(contract(spark, phase="inject"))) == [("phase_mismatch", "is_anomaly", 1)]
    feature = "service_log__event_rate"
    assert broken(quality.contract_violations(contract(spark).drop(feature))) == [("missing_column", feature, 1)]
    assert broken(quality.contract_violations(contract(spark, sample_id="a").drop("phase"))) == [("missing_column", "phase", 1)]
    both = quality.contract_violations(contract(spark, sample_id="a", phase="inject"))
    with pytest.raises(quality.ContractError, match="duplicate sample_id.*; phase_mismatch"):
        quality.require_valid(both, "contract")


def scores(spark, data, schema="sample_id string, score double, y_true int"):
    return spark.createDataFrame(data, schema)


def test_scores_violations(spark):
    check = lambda data, *a: broken(quality.scores_violations(scores(spark, data, *a)))
    assert check([("a", 1.0, 0), ("b", 2.0, 1)]) == []
    assert check([]) == [("empty", "", 1)]
    assert check([("a", float("nan"), 0)]) == [("null", "score", 1)]
    assert check([("a", float("inf"), 0)]) == [("infinite", "score", 1)]
    assert check([("a", 1.0, 2)]) == [("outside_0_1", "y_true", 1)]
    assert check([("a", 1.0, 0), ("a", 1.0, 0), (None, 1.0, 0), (None, 1.0, 0)]) == [("duplicate", "sample_id", 2), ("null", "sample_id", 2)]
    half = "sample_id string, score double, y_true double"
    assert check([("a", 1.0, 0.5)], half) == [("not_integral", "y_true", 1), ("outside_0_1", "y_true", 1)]
    assert check([("a", "x", "1")], "sample_id string, score string, y_true string") == [
        ("not_a_number", "score", 1), ("not_numeric", "y_true", 1)]
    assert check([(1, 1.0, 0)], "sample_id int, score double, y_true int") == [("not_a_string", "sample_id", 1)]
    assert check([("a", 1.0)], "sample_id string, score double") == [("missing_column", "y_true", 1)]


def test_metrics_violations(spark):
    schema = "protocol_version string, higher_is_more_anomalous boolean, n_samples long, has_labels boolean, auroc double, auprc double"
    check = lambda *row: broken(quality.metrics_violations(spark.createDataFrame([row], schema)))
    assert check("v0", True, 3, True, 0.5, 0.5) == []
    assert check("v0", True, 3, False, None, None) == []
    assert check("v1", False, 0, True, 1.5, None) == [
        ("not_positive", "n_samples", 1), ("not_true", "higher_is_more_anomalous", 1), ("outside_0_1", "auprc", 1),
        ("outside_0_1", "auroc", 1), ("wrong_version", "protocol_version", 1)]
    assert check("v0", True, 3, False, 0.5, None) == [("set_without_labels", "auroc", 1)]
    typed = spark.createDataFrame([("v0", 1, True, 1, 0.5, 0.5)], "protocol_version string, higher_is_more_anomalous int, n_samples boolean, has_labels int, auroc double, auprc double")
    assert [r[0] for r in broken(quality.metrics_violations(typed))] == ["not_an_integer", "not_boolean", "not_boolean"]
    assert broken(quality.metrics_violations(typed.drop("auprc"))) == [("missing_column", "auprc", 1)]


def test_config():
    config = ContractConfig()
    assert len(config.feature_columns) == 18 and set(K.RATE_COLUMNS) < set(config.feature_columns)
    with pytest.raises(ValueError):
        ModalitySpec((), "global_min_max")
    with pytest.raises(ValueError):
        ModalitySpec(("a",), "per_planet")
    with pytest.raises(ValueError):
        ContractConfig.from_dict({"contract_version": "v0", "window_size_s": 15})
    small = ContractConfig.from_dict(
        {"contract_version": "v0", "window_size_s": 5, "modalities": {"m": {"features": ["a"], "normalization": "global_min_max"}}}
    )
    assert small.rules == {"m__a": "global"}


def brute(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    if not pos or not neg:
        return None, None
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    ap = 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        chosen = [y for s, y in pairs if s >= t]
        ap += sum(1 for p in pos if p == t) / len(pos) * sum(chosen) / len(chosen)
    return wins / len(pos) / len(neg), ap


@pytest.mark.parametrize("heavy_rows", [1, 10**9])
def test_ranking_metrics_equal_brute_force(spark, heavy_rows):
    data = [("a" if i % 4 else "b", float((i * 37) % 23), int((i * 7) % 5 == 0)) for i in range(300)]
    data += [("c", 1.0, 1), ("c", 2.0, 1)]
    df = spark.createDataFrame(data, "g string, score double, y_true int")
    for r in E.ranking_metrics(df, by=["g"], heavy_rows=heavy_rows).collect():
        auroc, ap = brute([(s, y) for g, s, y in data if g == r["g"]])
        assert r["auroc"] == (auroc if auroc is None else pytest.approx(auroc))
        assert r["auprc"] == (ap if ap is None else pytest.approx(ap))
    overall = E.ranking_metrics(df, heavy_rows=heavy_rows).first()
    assert (overall["auroc"], overall["auprc"]) == pytest.approx(brute([(s, y) for _, s, y in data]))


def test_perfect_and_constant_scores(spark):
    perfect = [(0.1, 0)] * 10 + [(0.9, 1)] * 10
    flat = [(0.5, 0)] * 10 + [(0.5, 1)] * 10
    for data, expected in ((perfect, 1.0), (flat, 0.5)):
        got = E.ranking_metrics(spark.createDataFrame(data, "score double, y_true int")).first()
        assert (got["auroc"], got["auprc"]) == (expected, expected)


def strata_frame(spark):
    data = [(0.1, 0, "A", "p"), (0.9, 1, "A", "p"), (0.2, 0, "B", None), (0.3, 0, "B", "q")]
    return spark.createDataFrame(data, "score double, y_true int, anomaly_type string, anomaly_level string")


def test_strata_and_document(spark, tmp_path):
    tidy = E.evaluate(strata_frame(spark))
    got = {(r["stratum"], r["key"]): (r["n_samples"], r["has_labels"], r["auroc"]) for r in tidy.collect()}
    assert got == {
        ("overall", ""): (4, True, 1.0), ("by_anomaly_type", "A"): (2, True, 1.0), ("by_anomaly_type", "B"): (2, False, None),
        ("by_anomaly_level", "p"): (2, True, 1.0), ("by_anomaly_level", "q"): (1, False, None),
    }
    sinks.write_metrics(tidy, str(tmp_path / "m"))
    document = json.loads(spark.read.text(str(tmp_path / "m")).first()[0])
    assert document["auroc"] == 1.0 and document["n_samples"] == 4 and document["has_labels"] is True
    assert document["stratified"]["by_anomaly_type"] == {"A": {"auroc": 1.0, "n_samples": 2}, "B": {"auroc": None, "n_samples": 2}}
    without = E.evaluate(strata_frame(spark).drop("anomaly_level"))
    assert without.where("stratum = 'by_anomaly_level'").count() == 0


def test_single_class(spark):
    one = strata_frame(spark).where("y_true = 0")
    assert E.evaluate(one).where("stratum = 'overall'").first()["auroc"] is None
    with pytest.raises(ValueError, match="single class"):
        E.evaluate(one, on_single_class="error")
    with pytest.raises(ValueError):
        E.evaluate(one, on_single_class="ignore")


def test_score_stats_and_labels(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(11)], "score double, y_true int")
    got = E.score_stats(df).first()
    assert (got["mean"], got["min"], got["max"], got["p50"], got["p90"]) == (5.0, 0.0, 10.0, 5.0, 9.0)
    assert got["std"] == pytest.approx(10**0.5) and got["p99"] == pytest.approx(9.9)
    assert tuple(E.label_distribution(df).first()) == (5, 6, pytest.approx(5 / 11))
    assert tuple(E.label_distribution(df.where("false")).first()) == (0, 0, 0.0)


def vectors(spark):
    data = [("n1", [0.05, -0.05, 0.0, 0.5], 0), ("n2", [0.05, -0.05, 0.0, 0.5], 0), ("x", [1.1, -0.1, 0.1, 0.5], 1)]
    return spark.createDataFrame(data, "id string, v array<double>, y int")


def test_center_and_scores(spark):
    df = vectors(spark)
    center = oneclass.fit_center(df.where("y = 0"), "v", 4)
    assert center.first()["center"] == pytest.approx([0.1, -0.1, 0.1, 0.5])
    got = {r["id"]: r["score"] for r in oneclass.score_sq(df, center, "v", 4).collect()}
    assert got["x"] == pytest.approx(1.0) and got["n1"] == pytest.approx(0.05**2 + 0.05**2 + 0.01)
    mean = oneclass.mean_vector(df.where("y = 0"), "v", 4)
    assert {r["id"]: r["score"] for r in oneclass.score_l2(df, mean, "v", 4).collect()}["n1"] == 0


def test_encoder(spark):
    df = spark.createDataFrame([([1.0, -2.0],)], "v array<double>")
    layers = [[[1, 0], [0, 1]], [[2, 5], [-3, 5]]]
    assert df.select(S.encode(F.col("v"), layers)).first()[0] == [2.0, -3.0]


def test_fusion_checks_its_modalities(spark):
    dims = {"endpoint_red": 10, "service_metric": 5, "service_log": 3}
    fusion = modalities.EarlyConcat(dims)
    assert fusion.output_dim == 18
    with pytest.raises(ValueError):
        modalities.EarlyConcat({"endpoint_red": 10})
    with pytest.raises(ValueError):
        S.early_concat({"a": F.lit(1)}, ["a", "b"])
    fused = oneclass.fused_vector(contract(spark), ContractConfig()).first()["features"]
    assert fused == [0.5] * 18
    columns = [c for m in (modalities.TraceModality(), modalities.ClientModality(), modalities.MetricModality(), modalities.LogModality()) for c in m.feature_columns]
    assert columns == ContractConfig().feature_columns


def test_score_table_uses_normal_rows_only(spark):
    df = contract(spark, anomaly_type="Lv_P_x", phase="inject", is_anomaly=True, endpoint_red__trace_request_count=2.5)
    got = {r["sample_id"]: r for r in oneclass.score_table(df).collect()}
    assert got["a"]["score"] == 0 and got["b"]["score"] == pytest.approx(4.0)
    assert (got["a"]["y_true"], got["b"]["y_true"]) == (0, 1)


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    from test_entry import plan
    from windowguard.sources import bucketed

    left = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.col("id").alias("a"))
    right = spark.range(0, 5000, 2).select(F.concat(F.lit("s"), "id").alias("sample_id"), (F.col("id") * 2).alias("b"))
    paths = [str(tmp_path / n) for n in ("l's", "r")]
    both = [bucketed.write_bucketed(df, p, "sample_id", 8) for df, p in zip((left, right), paths, strict=True)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = both[0].join(both[1], "sample_id")
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
        assert joined.count() == 2500 and joined.where("b <> 2 * a").count() == 0
        counted = both[0].groupBy("sample_id").count()
        assert "Exchange" not in plan(counted)
        for df, path in zip((left, right), paths, strict=True):
            spark.sql(f"DROP TABLE {bucketed._name(path, 'sample_id', 8)}")
        again = [bucketed.read_bucketed(spark, p, df.schema, "sample_id", 8) for df, p in zip((left, right), paths, strict=True)]
        joined = again[0].join(again[1], "sample_id")
        assert "Exchange" not in plan(joined) and joined.count() == 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    replaced = bucketed.write_bucketed(right, paths[1], "sample_id", 8)
    assert replaced.count() == 2500


def test_checks_count_while_the_table_is_written(spark, tmp_path):
    from test_entry import finished, plan

    rows = [("a", 0.5, 1.0)] * 3 + [(None, 1.0, 0.0)] * 2 + [("b", None, 2.0), ("c", float("inf"), 0.5), ("d", 1.0, None)]
    rows += [(f"s{i}", float(i), float(i % 2)) for i in range(500)]
    scores = spark.createDataFrame(rows, "sample_id string, score double, y_true double")
    source = str(tmp_path / "source")
    scores.repartition(3).write.parquet(source)
    stored = spark.read.parquet(source)
    watched = quality.watched_scores(stored)
    spark.sparkContext.setJobGroup("watched", "watched")
    watched.df.write.parquet(str(tmp_path / "out"))
    found = watched.violations
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found) == sorted(map(tuple, quality.scores_violations(stored).collect()))
    assert ("duplicate", "sample_id", 3) in found
    assert sum(a.inputRecords() for a in finished(spark, "watched")) == len(rows)
    assert spark.read.parquet(str(tmp_path / "out")).columns == scores.columns
    with pytest.raises(quality.ContractError, match="duplicate sample_id"):
        sinks.write_scores_checked(stored, str(tmp_path / "checked"))
    assert not (tmp_path / "checked").exists() and not list(tmp_path.glob("checked-*"))
    good = stored.where("sample_id like 's%' and score is not null")
    for _ in range(2):
        sinks.write_scores_checked(good, str(tmp_path / "checked"))
    assert spark.read.parquet(str(tmp_path / "checked")).count() == 500
    keys = spark.createDataFrame([("c", "e", 1, 1)], "case_id string, endpoint_key string, timestamp_window_ms long, x int")
    dealt = quality.Watched(sinks.ordered_contract(keys), sinks.CONTRACT_ORDER, lambda d, n: [quality._rule("duplicate", "key", n)])
    assert plan(dealt.df).count("Exchange") == 1
    no_key = quality.watched_scores(stored.drop("sample_id"))
    no_key.df.write.format("noop").mode("overwrite").save()
    assert no_key.violations == [("missing_column", "sample_id", 1)]


def test_stages_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from windowguard.operators import stages

    rows = [("Normal", "e", float(i), 0.5) for i in range(11)] + [("Lv_P_x", "e", 20.0, 0.9), ("Lv_P_x", "f", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "anomaly_type string, endpoint_key string, x double, rate double")
    scaler = stages.NormalScaler(rules=["x:per_endpoint"], rates=["rate"])
    scaler.save(str(tmp_path / "scaler"))
    again = stages.NormalScaler.load(str(tmp_path / "scaler"))
    assert again.by_feature() == {"x": "per_endpoint"} and again.uid == scaler.uid
    model = Pipeline(stages=[again]).fit(df)
    model.save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    want = normalize.clip_rates(normalize.apply_minmax(df, normalize.fit_minmax(df.where("anomaly_type = 'Normal'"), {"x": "per_endpoint"}), {"x": "per_endpoint"}), ["rate"])
    assert sorted(map(str, loaded.transform(df).collect())) == sorted(map(str, want.collect()))
    assert loaded.stages[0].getOrDefault("rates") == ["rate"]
    parsed = spark.createDataFrame(
        [("Normal", "s", 1000 * i, "INFO", f"job {i} done") for i in range(5)] + [("Lv_P_x", "s", 0, "ERROR", "job 9 done"), ("Lv_P_x", "s", 1, "INFO", "odd")],
        "case_id string, service_name string, ts_ms long, level string, content string",
    )
    fitted = stages.LogTemplates(windowMs=60_000).fit(parsed)
    fitted.save(str(tmp_path / "logs"))
    got = stages.LogTemplatesModel.load(str(tmp_path / "logs")).transform(parsed)
    assert {tuple(r) for r in got.collect()} == {("Normal", "s", 0, 5.0, 0.0, 0.2), ("Lv_P_x", "s", 0, 2.0, 0.5, 1.0)}
