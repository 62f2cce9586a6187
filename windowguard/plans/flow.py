"""The three flows: build the wide table, score it, evaluate the scores."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import labels, logs, metrics, normalize, oneclass, quality, red
from windowguard.operators.evaluate import evaluate, label_distribution, score_stats
from windowguard.schemas import ContractConfig
from windowguard.session import stage
from windowguard.sources import files, sinks

LOG = logging.getLogger(__name__)
LOW_LOG_HIT_RATE = 0.5


@dataclass
class Sources:
    """Inputs of the wide table. RED tables are windowed; samples and parsed logs may be absent."""

    trace_red: DataFrame
    client_red: DataFrame
    cases: DataFrame
    endpoints: dict[str, str]
    samples: DataFrame | None = None
    logs: DataFrame | None = None


def _with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = {c: F.lit(None).cast("double") for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


def build_wide(
    sources: Sources, config: ContractConfig | None = None, window_ms: int = K.WINDOW_MS
) -> DataFrame:
    """The wide table before normalisation: one row per (case, endpoint, window).

    Only cells on both the server and the client side exist. Metric and log features join by
    service and stay NULL where a service has none. The cells, the case bounds and the templates
    are staged: they are read again, and with a known size the joins with the raw samples and
    lines are planned as broadcasts only where that side is small. So are the kept samples, about
    one in fifty, and the condensed lines, so that raw samples and lines are scanned once.
    """
    config = config or ContractConfig()
    cells = stage(
        red.endpoint_features(sources.trace_red, sources.client_red, sources.endpoints), "cells"
    )
    wide = red.with_service(cells, sources.endpoints)
    on_service = ["case_id", "service_name", "timestamp_window_ms"]
    if sources.samples is not None:
        bounds = stage(red.case_bounds(cells), "bounds")
        kept = stage(metrics.filter_samples(sources.samples, bounds), "samples")
        services = sorted(set(sources.endpoints.values()))
        wide = wide.join(metrics.metric_features(kept, services, window_ms), on_service, "left")
    if sources.logs is not None:
        says = F.col("fit_normal") if "fit_normal" in sources.cases.columns else S.is_normal(F.col("anomaly_type"))
        normal = sources.cases.where(says).select("case_id")
        lines = stage(logs.condense(sources.logs, window_ms), "log-lines")
        normal_lines = lines.join(normal, "case_id", "left_semi")
        templates = stage(logs.fit_templates(normal_lines), "templates")
        wide = wide.join(logs.log_features(lines, templates, window_ms), on_service, "left")
    wide = _with_missing(wide, config.feature_columns)
    wide = labels.with_labels(wide, sources.cases)
    if "meta_case_id" in sources.cases.columns:
        named = sources.cases.select("case_id", F.col("meta_case_id").alias("_meta"))
        wide = wide.join(named, "case_id", "left").withColumn(
            "case_id", F.coalesce("_meta", "case_id")
        )
    order = K.ID_COLUMNS + config.feature_columns + K.LABEL_COLUMNS
    return labels.with_identity(wide).select(*order)


def normalize_wide(
    wide: DataFrame, config: ContractConfig | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Scale by stats of the Normal rows (fitted here unless given) and clip the rates."""
    config = config or ContractConfig()
    if stats is None:
        normal = wide.where(S.is_normal(F.col("anomaly_type")))
        stats = normalize.fit_minmax(normal, config.rules)
    return normalize.clip_rates(normalize.apply_minmax(wide, stats, config.rules), K.RATE_COLUMNS)


def build_contract(
    sources: Sources, config: ContractConfig | None = None, window_ms: int = K.WINDOW_MS
) -> tuple[DataFrame, DataFrame]:
    """Normalised wide table and the stats used.

    The raw wide table and the stats are staged, so that the scans of the raw sources run once
    and not once more for the fit.
    """
    config = config or ContractConfig()
    wide = stage(build_wide(sources, config, window_ms), "wide")
    normal = wide.where(S.is_normal(F.col("anomaly_type")))
    stats = stage(normalize.fit_minmax(normal, config.rules), "stats")
    return normalize_wide(wide, config, stats), stats


def sources_from_folder(
    spark: SparkSession,
    root: str,
    endpoints: dict[str, str] | None = None,
    timezone: str = K.LOG_TIMEZONE,
    with_metrics: bool = True,
    with_logs: bool = True,
) -> Sources:
    """All cases below ``root``, read by folder layout; a modality without any folder is absent."""
    with_metrics = with_metrics and files.any_file(spark, f"{root}/*/metric_data/*.csv")
    with_logs = with_logs and files.any_file(spark, f"{root}/*/log_data")
    return Sources(
        trace_red=files.read_trace_red(spark, root),
        client_red=files.read_client_red(spark, root),
        cases=stage(files.read_cases(spark, root), "cases"),
        endpoints=dict(endpoints or K.ENDPOINT_SERVICES),
        samples=files.read_metric_samples(spark, f"{root}/*/metric_data/*.csv") if with_metrics else None,
        logs=logs.parse_logs(files.read_logs(spark, root), timezone) if with_logs else None,
    )


def write_contract_from_folder(
    spark: SparkSession, root: str, out: str, config: ContractConfig | None = None, **options
) -> None:
    """Raw case folders to a validated wide table and its stats below ``out``."""
    config = config or ContractConfig()
    sources = sources_from_folder(spark, root, **options)
    normal = sources.cases.where(S.is_normal(F.col("anomaly_type")))
    if normal.isEmpty():
        raise ValueError("no Normal case, the normaliser cannot be fitted")
    contract, stats = build_contract(sources, config, config.window_size_s * 1000)
    contract = stage(contract, "contract")
    if sources.logs is not None:
        rates = quality.hit_rate(contract, config.columns("service_log")[0])
        missed = rates.where(F.col("hit_rate") < LOW_LOG_HIT_RATE).count()
        if missed:
            LOG.warning("%d cases have log features in less than half of their rows", missed)
    sinks.write_contract_checked(contract, f"{out}/contract", config)
    sinks.write_stats(stats, f"{out}/normalization_stats")


def write_scores_from_contract(
    spark: SparkSession, contract_path: str, out: str, config: ContractConfig | None = None
) -> None:
    """Wide table to validated one-class scores."""
    sinks.write_scores_checked(oneclass.score_table(sinks.read_contract(spark, contract_path), config), out)


def write_metrics_from_scores(
    spark: SparkSession, scores_path: str, out: str, on_single_class: str = "null"
) -> None:
    """Scores to a validated metrics document."""
    scores = files.read_table(spark, scores_path)
    quality.require_valid(quality.scores_violations(scores), "scores")
    tidy = stage(evaluate(scores, on_single_class=on_single_class), "metrics")
    quality.require_valid(quality.metrics_violations(tidy), "metrics")
    sinks.write_metrics(tidy, out, score_stats(scores), label_distribution(scores))
