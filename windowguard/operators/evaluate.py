"""AUROC, average precision and score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.operators.series import HEAVY_ROWS, prefix_sums, quantiles


def ranking_metrics(
    scores: DataFrame,
    score: str = "score",
    label: str = "y_true",
    by: list[str] | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """n_samples, n_pos, auroc and auprc per group; both metrics NULL for a single class.

    Rows are merged per distinct score, so that ties are exact (they count half in the AUROC and
    share one threshold in the AP). The ranks come from ``prefix_sums``.
    """
    by = by or []
    counts = scores.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    ranked = prefix_sums(counts, by, "_score", ["n", "pos"], heavy_rows)

    def num(name: str):
        return F.col(name).cast("double")

    neg = num("n") - num("pos")
    neg_before = num("n_before") - num("pos_before")
    wins = F.sum(num("pos") * (neg_before + neg / 2))
    hits_from_here = num("pos_total") - num("pos_before")
    rows_from_here = num("n_total") - num("n_before")
    precision = F.sum(num("pos") * hits_from_here / rows_from_here)
    positives = F.max(num("pos_total"))
    negatives = F.max(num("n_total")) - positives
    return ranked.groupBy(*by).agg(
        F.max("n_total").alias("n_samples"),
        F.max("pos_total").alias("n_pos"),
        F.try_divide(wins, positives * negatives).alias("auroc"),
        F.when(negatives > 0, F.try_divide(precision, positives)).alias("auprc"),
    )


def auroc(scores: DataFrame, score: str = "score", label: str = "y_true", by=None) -> DataFrame:
    return ranking_metrics(scores, score, label, by).drop("auprc")


def auprc(scores: DataFrame, score: str = "score", label: str = "y_true", by=None) -> DataFrame:
    return ranking_metrics(scores, score, label, by).drop("auroc")


def stratified(
    scores: DataFrame,
    strata: tuple[str, ...] = ("anomaly_type", "anomaly_level"),
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Metrics overall and per value of each stratum column, one row per (stratum, key).

    A stratum column the table lacks is skipped, and so are rows whose key is NULL.
    """
    present = [c for c in strata if c in scores.columns]
    pairs = [F.struct(F.lit("overall").alias("stratum"), F.lit("").alias("key"))]
    pairs += [
        F.struct(F.lit(f"by_{c}").alias("stratum"), F.col(c).cast("string").alias("key"))
        for c in present
    ]
    spread = scores.select("score", "y_true", F.inline(F.array(*pairs)))
    return ranking_metrics(spread, by=["stratum", "key"], heavy_rows=heavy_rows)


def evaluate(
    scores: DataFrame,
    strata: tuple[str, ...] = ("anomaly_type", "anomaly_level"),
    on_single_class: str = "null",
) -> DataFrame:
    """Tidy metrics table (protocol v0). A single class overall gives NULL metrics or an error."""
    if on_single_class not in ("null", "error"):
        raise ValueError("on_single_class must be 'null' or 'error'")
    if on_single_class == "error":
        dist = label_distribution(scores).first()
        if not dist["n_pos"] or not dist["n_neg"]:
            raise ValueError(f"single class: pos={dist['n_pos']} neg={dist['n_neg']}")
    return stratified(scores, strata).select(
        F.lit("v0").alias("protocol_version"),
        F.lit(True).alias("higher_is_more_anomalous"),
        "stratum",
        "key",
        "n_samples",
        F.col("auroc").isNotNull().alias("has_labels"),
        "auroc",
        "auprc",
    )


def score_stats(scores: DataFrame, score: str = "score", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Mean, population standard deviation, extremes and three quantiles, one row."""
    moments = scores.agg(
        F.struct(
            F.avg(score).alias("mean"),
            F.stddev_pop(score).alias("std"),
            F.min(score).alias("min"),
            F.max(score).alias("max"),
        ).alias("m")
    )
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ranked = quantiles(scores, [], score, probs, heavy_rows)
    return ranked.withColumn("m", moments.scalar()).select("m.*", *probs)


def label_distribution(scores: DataFrame, label: str = "y_true") -> DataFrame:
    """Positives, negatives and the positive rate (0 for an empty table)."""
    y = F.col(label).cast("int")
    pos, neg = F.count(F.when(y == 1, 1)), F.count(F.when(y == 0, 1))
    return scores.agg(
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        F.coalesce(F.try_divide(pos, pos + neg), F.lit(0.0)).alias("pos_rate"),
    )
