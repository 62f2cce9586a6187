"""Min-max normalisation fitted on Normal rows, clipping and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.functions import scalars as S

GROUP_COLUMNS = {"per_endpoint": "endpoint_key", "per_service": "service_name", "global": None}
GLOBAL_KEY = "__global__"
MIN_WIDTH = 1e-9


def _by_scope(rules: dict[str, str]) -> dict[str, list[str]]:
    unknown = set(rules.values()) - set(GROUP_COLUMNS)
    if unknown:
        raise ValueError(f"unknown scopes {sorted(unknown)}, use {sorted(GROUP_COLUMNS)}")
    return {
        scope: [c for c, s in rules.items() if s == scope]
        for scope in GROUP_COLUMNS
        if scope in rules.values()
    }


def fit_minmax(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Stats (feature, scope, group_key, lo, hi) of ``df``; rows with a NULL group are left out.

    ``rules`` maps a feature column to per_endpoint, per_service or global.
    """
    parts = []
    for scope, features in _by_scope(rules).items():
        group = GROUP_COLUMNS[scope]
        ranges = [
            F.struct(
                F.lit(f).alias("feature"),
                F.min(f).cast("double").alias("lo"),
                F.max(f).cast("double").alias("hi"),
            )
            for f in features
        ]
        if group is None:
            grouped = df.agg(F.array(*ranges).alias("_stats"))
            key = F.lit(GLOBAL_KEY)
        else:
            known = df.where(F.col(group).isNotNull())
            grouped = known.groupBy(group).agg(F.array(*ranges).alias("_stats"))
            key = F.col(group).cast("string")
        parts.append(
            grouped.select(key.alias("group_key"), F.explode("_stats").alias("s")).select(
                "s.feature", F.lit(scope).alias("scope"), "group_key", "s.lo", "s.hi"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def apply_minmax(df: DataFrame, stats: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Scale each feature by the stats of its group.

    A group without stats keeps its raw values; a group whose range is missing gives NULL; a
    range narrower than 1e-9 counts as 1e-9.
    """
    out = df
    for scope, features in _by_scope(rules).items():
        group = GROUP_COLUMNS[scope]
        wide = (
            stats.where((F.col("scope") == scope) & F.col("feature").isin(features))
            .groupBy("group_key")
            .agg(
                *[
                    F.max(F.when(F.col("feature") == f, F.struct("lo", "hi"))).alias(f"_r{i}")
                    for i, f in enumerate(features)
                ],
                F.lit(True).alias(f"_seen_{scope}"),
            )
        )
        if group is None:
            row = [f"_r{i}" for i in range(len(features))]
            out = out.withColumn("_global", wide.select(F.struct(*row)).scalar())
            ranges = [F.col("_global")[r] for r in row]
            seen = F.lit(True)
        else:
            match = out[group].cast("string") == wide["group_key"]
            out = out.join(wide, match, "left").drop("group_key")
            ranges = [F.col(f"_r{i}") for i in range(len(features))]
            seen = F.col(f"_seen_{scope}").isNotNull()
        scaled = {}
        for feature, bounds in zip(features, ranges):
            value = F.col(feature).cast("double")
            width = F.greatest(bounds["hi"] - bounds["lo"], F.lit(MIN_WIDTH))
            scaled[feature] = F.when(seen, (value - bounds["lo"]) / width).otherwise(value)
        out = out.withColumns(scaled).drop(
            *[f"_r{i}" for i in range(len(features))], f"_seen_{scope}", "_global"
        )
    return out.select(*df.columns)


def unseen_groups(df: DataFrame, stats: DataFrame, scope: str) -> DataFrame:
    """Groups of ``df`` without stats, with their row count: these keep raw values."""
    group = GROUP_COLUMNS[scope]
    fitted = stats.where(F.col("scope") == scope).select(F.col("group_key").alias(group)).distinct()
    rows = df.groupBy(group).agg(F.count("*").alias("n_rows"))
    return rows.join(fitted, group, "left_anti")


def clip_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Limit rate columns to [0, 1]; missing stays missing."""
    return df.withColumns({c: S.clip(F.col(c), 0.0, 1.0) for c in columns if c in df.columns})


def feature_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean of each column; 0 for a column without any value."""
    return df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def impute(
    df: DataFrame, columns: list[str], strategy: str = "zero", fit: DataFrame | None = None
) -> DataFrame:
    """Fill missing features with 0 or with the means of ``fit`` (of ``df`` itself by default)."""
    if strategy == "zero":
        return df.fillna(0.0, subset=columns)
    if strategy != "mean":
        raise ValueError(f"unknown strategy {strategy!r}, use 'mean' or 'zero'")
    means = feature_means(df if fit is None else fit, columns).select(F.struct(*columns)).scalar()
    filled = {c: F.coalesce(F.col(c), F.col("_means")[c]) for c in columns}
    return df.withColumn("_means", means).withColumns(filled).drop("_means")
