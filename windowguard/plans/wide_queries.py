"""Queries over the wide table, its normalisation, scores and sequences."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import logs, normalize, oneclass, quality, series, stages
from windowguard.plans import flow
from windowguard.plans import sql as Q
from windowguard.plans.endpoint_queries import red_tables
from windowguard.plans.registry import query, rounded
from windowguard.plans.service_queries import log_table
from windowguard.schemas import ContractConfig
from windowguard.session import shared_dir, stage
from windowguard.sources import sinks
from windowguard.sources import tables as A

CONFIG = ContractConfig()
ID_LABELS = K.ID_COLUMNS + K.LABEL_COLUMNS
WHOLE = ", ".join(ID_LABELS) + ", " + Q.rounds(Q.FEATURES)


def wide_table(spark, folder, with_logs: bool = True) -> DataFrame:
    window = A.DAY_MS
    trace, client = red_tables(spark, folder, window)
    sources = flow.Sources(
        trace_red=trace,
        client_red=client,
        cases=A.cases(spark),
        endpoints=A.ENDPOINTS,
        samples=A.metric_reports(spark, folder),
        logs=logs.parse_logs(log_table(spark, folder).drop("event_id"), "UTC") if with_logs else None,
    )
    return flow.build_wide(sources, CONFIG, window)


def contract_table(spark, folder) -> DataFrame:
    """Normalised wide table; staged, as is the raw one, because what follows reads it again."""
    wide = stage(wide_table(spark, folder), "wide")
    normal = wide.where(S.is_normal(F.col("anomaly_type")))
    stats = stage(normalize.fit_minmax(normal, CONFIG.rules), "stats")
    return stage(flow.normalize_wide(wide, CONFIG, stats), "contract")


@query(f"WITH {Q.WIDE} SELECT {WHOLE} FROM wide")
def contract_wide(spark, folder):
    """The wide table before normalisation."""
    return rounded(wide_table(spark, folder))


NO_LOGS = ", ".join(ID_LABELS) + ", " + Q.rounds(Q.FEATURES[:15])


@query(
    f"WITH {Q.WIDE} SELECT {NO_LOGS}, {', '.join(f'CAST(NULL AS DOUBLE) AS {f}' for f in Q.FEATURES[15:])} FROM wide"
)
def contract_without_logs(spark, folder):
    """The wide table of cases without logs: the log features are there and missing."""
    return rounded(wide_table(spark, folder, with_logs=False))


@query(f"WITH {Q.NORMALIZED} SELECT {WHOLE} FROM contract")
def rate_clip(spark, folder):
    """The wide table scaled by Normal ranges, rates limited to [0, 1]."""
    return rounded(contract_table(spark, folder))


@query(f"WITH {Q.NORMALIZED} SELECT {WHOLE} FROM contract")
def scaler_stage(spark, folder):
    """The wide table scaled by a pipeline that was fitted, saved and loaded."""
    wide = stage(wide_table(spark, folder), "wide")
    scaler = stages.NormalScaler(rules=[f"{f}:{scope}" for f, scope in CONFIG.rules.items()])
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    Pipeline(stages=[scaler]).fit(wide).save(path)
    return rounded(PipelineModel.load(path).transform(wide))


@query(
    f"""WITH {Q.EV}, {Q.LOG_CHAIN}, {Q.log_tables(A.DAY_MS)} SELECT case_id, service_name, timestamp_window_ms,
    {Q.rounds(["service_log__" + f for f in K.LOG_FEATURES])} FROM log_windows"""
)
def log_stage(spark, folder):
    """Log features of a model that was fitted, saved and loaded."""
    parsed = logs.parse_logs(log_table(spark, folder).drop("event_id"), "UTC")
    path = f"{shared_dir(spark)}/templates-{uuid.uuid4().hex}"
    stages.LogTemplates(windowMs=A.DAY_MS).fit(parsed).save(path)
    return rounded(stages.LogTemplatesModel.load(path).transform(parsed))


@query(
    f"""WITH {Q.WIDE} SELECT case_id, round(avg(CASE WHEN service_log__event_rate IS NOT NULL
    THEN 1 ELSE 0 END), 6) AS hit_rate FROM wide GROUP BY 1"""
)
def join_hit_rate(spark, folder):
    """Share of rows with log features per case."""
    return rounded(quality.hit_rate(wide_table(spark, folder), "service_log__event_rate"))


BROKEN = f"""WITH {Q.WIDE}, twice AS (SELECT * FROM wide UNION ALL SELECT * FROM wide WHERE phase = 'recover'),
    found AS (
      SELECT 'duplicate' AS rule, 'sample_id' AS "column", count(*) - count(DISTINCT sample_id) AS n_rows FROM twice
      {" ".join(f"UNION ALL SELECT 'outside_0_1', '{r}', count(*) FILTER ({r} < 0 OR {r} > 1) FROM twice" for r in K.RATE_COLUMNS)}
      UNION ALL SELECT 'phase_mismatch', 'is_anomaly', count(*) FILTER (phase = 'recover') FROM twice)
    SELECT rule, "column", CAST(n_rows AS BIGINT) AS n_rows FROM found WHERE n_rows > 0"""


def _broken(spark, folder) -> DataFrame:
    """A wide table with repeated rows, raw rates and wrong flags."""
    wide = stage(wide_table(spark, folder), "wide")
    recover = F.col("phase") == "recover"
    return wide.unionByName(wide.where(recover)).withColumn("is_anomaly", F.col("is_anomaly") | recover)


@query(BROKEN)
def contract_violations(spark, folder):
    """Broken rules of a wide table with repeated rows, raw rates and wrong flags."""
    return quality.contract_violations(_broken(spark, folder), CONFIG)


@query(BROKEN)
def contract_violations_written(spark, folder):
    """The same rules, counted while the table is written in its order."""
    watched = quality.watched_contract(sinks.ordered_contract(_broken(spark, folder)), sinks.CONTRACT_ORDER, CONFIG)
    watched.df.write.parquet(f"{shared_dir(spark)}/watched-{uuid.uuid4().hex}")
    return spark.createDataFrame(watched.violations, "rule string, column string, n_rows long")


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem")
def duplicate_count(spark, folder):
    """Rows beyond the first of their key."""
    return quality.duplicate_rows(A.table(spark, folder, "lineitem"), "l_orderkey")


@query(f"WITH {Q.imputed('mean')} SELECT sample_id, {Q.rounds(Q.FEATURES)} FROM filled")
def mean_impute(spark, folder):
    """Missing features filled by the means of the Normal rows."""
    contract = contract_table(spark, folder)
    normal = contract.where(S.is_normal(F.col("anomaly_type")))
    filled = normalize.impute(contract, CONFIG.feature_columns, "mean", fit=normal)
    return rounded(filled.select("sample_id", *CONFIG.feature_columns))


@query(f"WITH {Q.imputed('zero')} SELECT sample_id, {Q.rounds(Q.FEATURES)} FROM filled")
def zero_impute(spark, folder):
    """Missing features filled with 0."""
    filled = normalize.impute(contract_table(spark, folder), CONFIG.feature_columns, "zero")
    return rounded(filled.select("sample_id", *CONFIG.feature_columns))


def _weighted(columns: list[str]) -> str:
    return " + ".join(f"{i + 1} * {c}" for i, c in enumerate(columns))


GROUPS = [Q.FEATURES[:10], Q.FEATURES[10:15], Q.FEATURES[15:]]


def _sum_by_place(vector: str):
    places = F.sequence(F.lit(1), F.size(vector))
    products = F.zip_with(F.col(vector), places, lambda x, i: x * i)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


@query(
    f"""WITH {Q.imputed("zero")} SELECT sample_id,
    {", ".join(f"{len(g)} AS dim_{n}, round({_weighted(g)}, 4) + 0 AS sum_{n}" for n, g in zip(oneclass.MODALITY_ORDER, GROUPS))}
    FROM filled"""
)
def modality_vectors(spark, folder):
    """Length and place-weighted sum of each modality vector."""
    filled = normalize.impute(contract_table(spark, folder), CONFIG.feature_columns, "zero")
    vectors = oneclass.modality_vectors(filled, CONFIG)
    columns = []
    for name in oneclass.MODALITY_ORDER:
        columns += [
            F.size(name).alias(f"dim_{name}"),
            F.round(_sum_by_place(name), 4).alias(f"sum_{name}"),
        ]
    return vectors.select("sample_id", *columns)


@query(
    f"""WITH {Q.imputed("zero")} SELECT sample_id, 18 AS dim,
    round({_weighted(Q.FEATURES)}, 4) + 0 AS weighted_sum FROM filled"""
)
def early_concat(spark, folder):
    """Length and place-weighted sum of the fused vector."""
    filled = normalize.impute(contract_table(spark, folder), CONFIG.feature_columns, "zero")
    fused = oneclass.fused_vector(filled, CONFIG)
    return fused.select(
        "sample_id",
        F.size("features").alias("dim"),
        F.round(_sum_by_place("features"), 4).alias("weighted_sum"),
    )


def _pushed(c: str) -> str:
    return f"CASE WHEN abs({c}) < 0.1e0 AND {c} < 0 THEN -0.1e0 WHEN abs({c}) < 0.1e0 THEN 0.1e0 ELSE {c} END"


CENTER_SQL = (
    Q.imputed("mean")
    + f""",
raw_center AS (SELECT {", ".join(f"avg({f}) AS a{i}" for i, f in enumerate(Q.FEATURES))}
  FROM filled WHERE anomaly_type LIKE 'Normal%'),
center AS (SELECT {", ".join(f"{_pushed(f'a{i}')} AS c{i}" for i in range(len(Q.FEATURES)))} FROM raw_center)"""
)


@query(
    f"""WITH {CENTER_SQL}, parts AS ({" UNION ALL ".join(f"SELECT {i} AS position, c{i} AS value FROM center" for i in range(18))})
    SELECT position, round(value, 6) AS value FROM parts"""
)
def one_class_center(spark, folder):
    """Centre of the Normal rows, components near 0 pushed away from it."""
    contract = contract_table(spark, folder)
    normal = contract.where(S.is_normal(F.col("anomaly_type")))
    filled = normalize.impute(normal, CONFIG.feature_columns, "mean")
    center = oneclass.fit_center(oneclass.fused_vector(filled, CONFIG), "features", 18)
    parts = center.select(F.posexplode("center").alias("position", "value"))
    return rounded(parts)


@query(
    f"""WITH {CENTER_SQL} SELECT sample_id,
    round({" + ".join(f"({f} - c{i}) * ({f} - c{i})" for i, f in enumerate(Q.FEATURES))}, 5) AS score,
    CAST(is_anomaly AS INT) AS y_true, case_id, endpoint_key, phase, anomaly_type, anomaly_level
    FROM filled, center"""
)
def one_class_score(spark, folder):
    """Squared distance of every row to the centre."""
    return rounded(oneclass.score_table(contract_table(spark, folder), CONFIG), 5)


SEQUENCE = 4


@query(
    f"""WITH {Q.EV}, {Q.CLIENTS}, cells AS (SELECT case_id, endpoint_key,
      {Q.bucket("ts_ms", 6 * A.HOUR_MS)} AS w, count(*) AS n, sum(latency_ms) AS total FROM clients GROUP BY ALL),
    runs AS (SELECT case_id, endpoint_key, w, count(*) OVER f AS len, last_value(w) OVER f AS last_w,
      sum(n) OVER f AS rows_in, first_value(n) OVER f AS first_n FROM cells
      WINDOW f AS (PARTITION BY case_id, endpoint_key ORDER BY w ROWS BETWEEN CURRENT ROW AND {SEQUENCE - 1} FOLLOWING))
    SELECT case_id, endpoint_key, w AS first_timestamp_window_ms, last_w, CAST(rows_in AS BIGINT) AS rows_in, first_n,
      CAST({SEQUENCE} AS INT) AS steps FROM runs WHERE len = {SEQUENCE}"""
)
def sliding_sequences(spark, folder):
    """Runs of four consecutive windows per case and endpoint."""
    window = S.bucket(F.col("ts_ms"), 6 * A.HOUR_MS).alias("timestamp_window_ms")
    keys = ["case_id", "endpoint_key"]
    cells = A.client_requests(spark, folder).groupBy(*keys, window).agg(F.count("*").alias("n"))
    cells = stage(cells, "cells")
    runs = series.sequences(
        cells, keys, "timestamp_window_ms", ["n"], SEQUENCE, 6 * A.HOUR_MS, chunk_windows=64
    )
    rows = F.aggregate("steps", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    return runs.select(
        *keys,
        "first_timestamp_window_ms",
        F.element_at("steps", -1)["timestamp_window_ms"].alias("last_w"),
        rows.alias("rows_in"),
        F.get("steps", F.lit(0))["n"].alias("first_n"),
        F.size("steps").alias("steps"),
    )
