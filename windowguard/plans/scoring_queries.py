"""Queries over scores: ranking metrics, statistics, validators and embedding models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.functions import scalars as S
from windowguard.operators import evaluate as E
from windowguard.operators import oneclass, profile, quality, textmodels
from windowguard.plans import sql as Q
from windowguard.plans.registry import query, rounded
from windowguard.session import stage
from windowguard.sources import sinks
from windowguard.sources import tables as A

SCORES = f"""{Q.EV}, scores AS (
  SELECT case_id || '__' || endpoint_key || '__' || event_id AS sample_id, value AS score,
    CAST(k >= 85 AS INT) AS y_true, case_id AS anomaly_type,
    CASE WHEN event_type <> 'error' THEN event_type END AS anomaly_level FROM ev)"""


def _ranking(source: str, by: str) -> str:
    """CTE ``metrics`` with both ranking metrics of (by, score, y_true) rows."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    before = f"OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
counts AS (SELECT {keys}score, count(*) AS n, sum(y_true) AS pos FROM {source} GROUP BY ALL),
ranks AS (SELECT *, coalesce(sum(n) {before}, 0) AS n_before, coalesce(sum(pos) {before}, 0) AS pos_before,
  sum(n) OVER ({part}) AS n_total, sum(pos) OVER ({part}) AS pos_total FROM counts),
metrics AS (SELECT {keys}CAST(max(n_total) AS BIGINT) AS n_samples, CAST(max(pos_total) AS BIGINT) AS n_pos,
  sum(pos * (n_before - pos_before + (n - pos) / 2e0)) / nullif(max(pos_total) * (max(n_total) - max(pos_total)), 0) AS auroc,
  CASE WHEN max(n_total) > max(pos_total) THEN sum(pos * ((pos_total - pos_before) / (n_total - n_before)))
    / nullif(max(pos_total), 0) END AS auprc
  FROM ranks {f"GROUP BY {by}" if by else ""})"""


OVERALL = f"WITH {SCORES}, {_ranking('scores', '')}"
STRATA = f"""WITH {SCORES}, spread AS (
  SELECT 'overall' AS stratum, '' AS key, score, y_true FROM scores
  UNION ALL SELECT 'by_anomaly_type', anomaly_type, score, y_true FROM scores
  UNION ALL SELECT 'by_anomaly_level', anomaly_level, score, y_true FROM scores WHERE anomaly_level IS NOT NULL),
{_ranking("spread", "stratum, key")}"""


@query(f"{OVERALL} SELECT n_samples, n_pos, round(auroc, 8) AS auroc FROM metrics")
def auroc(spark, folder):
    """AUROC of event values, ties counting half."""
    return rounded(E.auroc(A.event_scores(spark, folder)), 8)


@query(f"{OVERALL} SELECT n_samples, n_pos, round(auprc, 8) AS auprc FROM metrics")
def auprc(spark, folder):
    """Average precision of event values, one threshold per distinct value."""
    return rounded(E.auprc(A.event_scores(spark, folder)), 8)


@query(
    f"""{STRATA} SELECT 'v0' AS protocol_version, true AS higher_is_more_anomalous, stratum, key, n_samples,
    auroc IS NOT NULL AS has_labels, round(auroc, 8) AS auroc, round(auprc, 8) AS auprc FROM metrics"""
)
def stratified_auroc(spark, folder):
    """Tidy metrics table: overall, by anomaly type and by level."""
    return rounded(E.evaluate(A.event_scores(spark, folder)), 8)


@query(
    f"""WITH {SCORES} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
    min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.5), 6) AS p50,
    round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99 FROM scores"""
)
def score_stats(spark, folder):
    """Moments, extremes and exact quantiles of the scores."""
    return rounded(E.score_stats(A.event_scores(spark, folder)))


@query(
    f"""WITH {SCORES} SELECT count(*) FILTER (y_true = 1) AS n_pos, count(*) FILTER (y_true = 0) AS n_neg,
    round(avg(y_true), 8) AS pos_rate FROM scores"""
)
def label_distribution(spark, folder):
    """Positive and negative samples."""
    return rounded(E.label_distribution(A.event_scores(spark, folder)), 8)


@query(
    f"""WITH {Q.EV}, s AS (SELECT CASE WHEN k >= 2 THEN case_id || ts_ms // 60000 END AS sample_id,
      CASE WHEN k = 5 THEN NULL WHEN k = 6 THEN 'infinity'::DOUBLE WHEN k = 7 THEN 'nan'::DOUBLE ELSE value END AS score,
      CASE WHEN k >= 95 THEN 2.0e0 WHEN k = 50 THEN 0.5e0 WHEN k = 51 THEN NULL WHEN k >= 85 THEN 1e0 ELSE 0e0 END AS y_true
      FROM ev),
    found AS (
      SELECT 'null' AS rule, 'sample_id' AS "column", count(*) FILTER (sample_id IS NULL) AS n_rows FROM s
      UNION ALL SELECT 'duplicate', 'sample_id', count(*) - count(DISTINCT sample_id)
        - CASE WHEN count(*) > count(sample_id) THEN 1 ELSE 0 END FROM s
      UNION ALL SELECT 'null', 'score', count(*) FILTER (score IS NULL OR isnan(score)) FROM s
      UNION ALL SELECT 'infinite', 'score', count(*) FILTER (isinf(score)) FROM s
      UNION ALL SELECT 'null', 'y_true', count(*) FILTER (y_true IS NULL) FROM s
      UNION ALL SELECT 'not_integral', 'y_true', count(*) FILTER (y_true <> floor(y_true)) FROM s
      UNION ALL SELECT 'outside_0_1', 'y_true', count(*) FILTER (y_true NOT IN (0, 1)) FROM s)
    SELECT rule, "column", CAST(n_rows AS BIGINT) AS n_rows FROM found WHERE n_rows > 0"""
)
def scores_violations(spark, folder):
    """Broken rules of a scores table with missing, repeated and impossible entries."""
    k = F.col("k")
    minute = F.floor(F.col("ts_ms") / 60000).cast("string")
    broken = A.events(spark, folder).select(
        F.when(k >= 2, F.concat("case_id", minute)).alias("sample_id"),
        F.when(k == 5, None)
        .when(k == 6, float("inf"))
        .when(k == 7, float("nan"))
        .otherwise(F.col("value"))
        .alias("score"),
        F.when(k >= 95, 2.0)
        .when(k == 50, 0.5)
        .when(k == 51, None)
        .when(k >= 85, 1.0)
        .otherwise(0.0)
        .alias("y_true"),
    )
    return quality.scores_violations(broken)


@query(
    f"""{STRATA}, broken AS (SELECT CASE WHEN stratum = 'overall' THEN 'v0' ELSE 'v1' END AS protocol_version,
      n_samples - 1900 AS n_samples, stratum <> 'by_anomaly_level' AS has_labels, auroc * 2 AS auroc, auprc FROM metrics),
    found AS (
      SELECT 'wrong_version' AS rule, 'protocol_version' AS "column",
        count(*) FILTER (protocol_version <> 'v0') AS n_rows FROM broken
      UNION ALL SELECT 'not_positive', 'n_samples', count(*) FILTER (n_samples <= 0) FROM broken
      UNION ALL SELECT 'outside_0_1', 'auroc', count(*) FILTER (has_labels AND NOT coalesce(auroc BETWEEN 0 AND 1, false)) FROM broken
      UNION ALL SELECT 'set_without_labels', 'auroc', count(*) FILTER (NOT has_labels AND auroc IS NOT NULL) FROM broken
      UNION ALL SELECT 'outside_0_1', 'auprc', count(*) FILTER (has_labels AND NOT coalesce(auprc BETWEEN 0 AND 1, false)) FROM broken
      UNION ALL SELECT 'set_without_labels', 'auprc', count(*) FILTER (NOT has_labels AND auprc IS NOT NULL) FROM broken)
    SELECT rule, "column", CAST(n_rows AS BIGINT) AS n_rows FROM found WHERE n_rows > 0"""
)
def metrics_violations(spark, folder):
    """Broken rules of a metrics table with wrong versions, counts and ranges."""
    tidy = E.evaluate(A.event_scores(spark, folder))
    version = F.when(F.col("stratum") == "overall", "v0").otherwise("v1")
    broken = tidy.withColumns(
        {
            "protocol_version": version,
            "n_samples": F.col("n_samples") - 1900,
            "has_labels": F.col("stratum") != "by_anomaly_level",
            "auroc": F.col("auroc") * 2,
        }
    )
    return quality.metrics_violations(broken)


@query()
def metrics_document(spark, folder):
    """The metrics table as one JSON document."""
    return sinks.metrics_document(E.evaluate(A.event_scores(spark, folder)))


DIM = 64


def _vector(alias: str = "features") -> str:
    return f"list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS {alias}"


EMBEDDED = f"e AS (SELECT vec_id, label, {_vector()} FROM embeddings)"
MEAN_CENTER = """parts AS (SELECT unnest(features) AS x, generate_subscripts(features, 1) AS i FROM e WHERE label = 0),
  dims AS (SELECT i, avg(x) AS m FROM parts GROUP BY 1),
  pairs AS (SELECT vec_id, label, unnest(features) AS x, generate_subscripts(features, 1) AS i FROM e)"""


@query(
    f"""WITH {EMBEDDED}, {MEAN_CENTER} SELECT vec_id, label, CAST(label <> 0 AS INT) AS y_true,
    round(sqrt(sum((x - m) * (x - m))), 6) AS score FROM pairs JOIN dims USING (i) GROUP BY vec_id, label"""
)
def l2_score(spark, folder):
    """Distance of every embedding to the mean of label 0."""
    rows = A.embedding_scores(spark, folder)
    center = oneclass.mean_vector(rows.where(F.col("label") == 0), "features", DIM)
    scored = oneclass.score_l2(rows, center, "features", DIM)
    return rounded(scored.select("vec_id", "label", "y_true", "score"))


@query(
    f"""WITH {EMBEDDED}, {MEAN_CENTER}, scored AS (
      SELECT vec_id, label, CAST(label <> 0 AS INT) AS y_true,
        round(sum((x - CASE WHEN abs(m) < 0.1e0 AND m < 0 THEN -0.1e0 WHEN abs(m) < 0.1e0 THEN 0.1e0 ELSE m END) ** 2), 9) AS score
      FROM pairs JOIN dims USING (i) GROUP BY vec_id, label),
    {_ranking("scored", "")} SELECT n_samples, n_pos, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM metrics"""
)
def one_class_auroc(spark, folder):
    """Ranking metrics of the squared distance to the clamped centre of label 0."""
    rows = A.embedding_scores(spark, folder)
    center = oneclass.fit_center(rows.where(F.col("label") == 0), "features", DIM)
    scored = stage(rounded(oneclass.score_sq(rows, center, "features", DIM), 9), "scores")
    return rounded(E.ranking_metrics(scored))


def layer(rows: int, columns: int) -> list[list[float]]:
    """Small encoder weights made by a rule."""
    return [[((7 * i + 3 * j) % 5 - 2) / 10 for j in range(columns)] for i in range(rows)]


LAYERS = [layer(8, DIM), layer(6, 8), layer(4, 6)]


def _layer_sql(name: str, source: str, vector: str, matrix: list[list[float]], relu: bool) -> str:
    def unit(row: list[float]) -> str:
        weights = "[" + ", ".join(f"{w}e0" for w in row) + "]"
        dot = f"list_inner_product({vector}, {weights}::DOUBLE[])"
        return f"greatest({dot}, 0e0)" if relu else dot

    return f"{name} AS (SELECT vec_id, [{', '.join(unit(r) for r in matrix)}] AS z FROM {source})"


@query(
    f"""WITH {EMBEDDED}, {_layer_sql("a", "e", "features", LAYERS[0], True)},
    {_layer_sql("b", "a", "z", LAYERS[1], True)}, {_layer_sql("c", "b", "z", LAYERS[2], False)}
    SELECT vec_id, {", ".join(f"round(z[{i + 1}], 8) + 0 AS z{i}" for i in range(4))} FROM c"""
)
def encoder_inference(spark, folder):
    """Output of a bias-free three-layer encoder for every embedding."""
    encoded = A.embedding_scores(spark, folder).withColumn(
        "z", S.encode(F.col("features"), LAYERS)
    )
    return rounded(
        encoded.select("vec_id", *[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(4)]), 8
    )


def _label_means(spark, folder) -> DataFrame:
    rows = A.embedding_scores(spark, folder)
    cells = rows.select("label", F.posexplode("features").alias("place", "x"))
    return cells.groupBy("label", "place").agg(F.avg("x").alias("loading")).select(
        F.col("label").alias("component"),
        F.concat(F.lit("f"), F.lpad(F.col("place").cast("string"), 2, "0")).alias("feature"),
        F.round("loading", 9).alias("loading"),
    )


@query(
    f"""WITH {EMBEDDED}, cells AS (SELECT label, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS i FROM e),
    means AS (SELECT label AS component, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, round(avg(x), 9) AS loading
      FROM cells GROUP BY label, i),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS INT) AS rank
      FROM means WHERE component < 3)
    SELECT component, feature, loading, rank FROM ranked WHERE rank <= 5"""
)
def topk_loadings(spark, folder):
    """The five largest absolute loadings of the first three components."""
    return profile.top_loadings(_label_means(spark, folder), 3, 5)


@query()
def pca_variance(spark, folder):
    """Explained variance of all principal components of the embeddings."""
    names = [f"f{i}" for i in range(DIM)]
    return profile.fit_pca(A.embedding_scores(spark, folder), "features", names)[1]


PAIR = """p AS (SELECT l_quantity AS x, l_linenumber * 8e0 AS y, l_returnflag, l_partkey % 2 = 0 AS head FROM lineitem)"""


def _eigen(rows: str, name: str) -> str:
    """Explained variance of two columns in closed form."""
    return f"""SELECT '{name}' AS subset, unnest([0, 1]) AS component,
      round(unnest([(t / 2 + r) / t, (t / 2 - r) / t]), 8) AS ratio, round(unnest([(t / 2 + r) / t, 1e0]), 8) AS cumulative
    FROM (SELECT a + c AS t, sqrt((a - c) * (a - c) / 4 + b * b) AS r FROM (
      SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM {rows}))"""


def _pair(spark, folder) -> DataFrame:
    return A.table(spark, folder, "lineitem").select(
        F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber") * 8.0).alias("v"),
        (F.col("l_partkey") % 2 == 0).alias("head"),
    )


@query(f"WITH {PAIR} {_eigen('p', 'all')} UNION ALL {_eigen('p WHERE head', 'head')} UNION ALL {_eigen('p WHERE NOT head', 'tail')}")
def pca_subsets(spark, folder):
    """Explained and cumulative variance of two columns, over all rows and over two subsets."""
    rows = stage(_pair(spark, folder), "pairs")
    return rounded(profile.pca_by_subset(rows, "v", ["x", "y"], {"all": F.lit(True), "head": F.col("head"), "tail": ~F.col("head")}), 8)


@query(
    f"""WITH {PAIR}, m AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p),
    e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM m),
    v AS (SELECT abs(b) / sqrt(b * b + (l - a) * (l - a)) AS vx, abs(l - a) / sqrt(b * b + (l - a) * (l - a)) AS vy FROM e),
    loads AS (SELECT 0 AS component, 'x' AS feature, vx AS size FROM v UNION ALL SELECT 0, 'y', vy FROM v
      UNION ALL SELECT 1, 'x', vy FROM v UNION ALL SELECT 1, 'y', vx FROM v)
    SELECT component, feature, round(size, 6) AS size, CAST(row_number() OVER (PARTITION BY component ORDER BY size DESC, feature) AS INT) AS rank
    FROM loads"""
)
def pca_loadings(spark, folder):
    """Ranked absolute loadings of the principal components of two columns."""
    loadings, _ = profile.fit_pca(_pair(spark, folder), "v", ["x", "y"])
    ranked = profile.top_loadings(loadings, 2, 2)
    return ranked.select("component", "feature", F.round(F.abs("loading"), 6).alias("size"), "rank")


@query(
    f"""WITH {EMBEDDED}, moved AS (SELECT vec_id, label >= 5 AS far, list_transform(features, lambda x: x + CASE WHEN label >= 5 THEN 100 ELSE 0 END) AS f FROM e),
    pairs AS (SELECT vec_id, far, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM moved),
    means AS (SELECT far, i, avg(x) AS m FROM pairs GROUP BY ALL)
    SELECT vec_id, round(sqrt(sum((x - m) * (x - m))), 5) AS score FROM pairs JOIN means USING (far, i) GROUP BY 1"""
)
def kmeans_groups(spark, folder):
    """Distance to the nearest of two centres where two groups lie far apart: that of the own group's mean."""
    shift = F.when(F.col("label") >= 5, 100.0).otherwise(0.0)
    rows = A.embedding_scores(spark, folder).withColumn("features", F.transform("features", lambda x: x + shift))
    rows = rows.withColumn("features", array_to_vector("features"))
    return rounded(textmodels.fit_predict(rows, rows, "kmeans").select("vec_id", "score"), 5)


@query()
def kmeans_distance(spark, folder):
    """Distance of every embedding to the nearest centre of label 0."""
    rows = A.embedding_scores(spark, folder).withColumn("features", array_to_vector("features"))
    scored = textmodels.fit_predict(rows.where(F.col("label") == 0), rows, "kmeans")
    return scored.select("vec_id", "y_true", "score")
