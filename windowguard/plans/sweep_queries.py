"""The sweep of trees over all pairs of an error type and a service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard.operators import sweep, textmodels
from windowguard.operators.evaluate import ranking_metrics
from windowguard.plans.registry import query, rounded
from windowguard.session import stage
from windowguard.sources import tables as A

PLAN = sweep.Sweep(n_runs=12, max_depth=3)
PAIR = "error_type, service"


def _level(depth: int) -> str:
    """CTEs of one level: counts, the best split of each node, and the members below it."""
    return f"""
here{depth} AS (SELECT {PAIR}, node, count(*) AS n, sum(label)::BIGINT AS p FROM members{depth} WHERE in_train GROUP BY ALL
  HAVING sum(label) BETWEEN 1 AND count(*) - 1),
counts{depth} AS (SELECT {PAIR}, node, token, bin, count(*) AS n, sum(label)::BIGINT AS p
  FROM members{depth} JOIN binned USING (doc_id) WHERE in_train GROUP BY ALL),
sides{depth} AS (SELECT {PAIR}, node, token, bin, h.n, h.p, (sum(c.n) OVER w)::BIGINT AS nr, (sum(c.p) OVER w)::BIGINT AS pr
  FROM counts{depth} c JOIN here{depth} h USING ({PAIR}, node) WINDOW w AS (PARTITION BY {PAIR}, node, token ORDER BY bin DESC)),
splits{depth} AS (SELECT {PAIR}, node, token, bin, n, p FROM (
  SELECT *, row_number() OVER (PARTITION BY {PAIR}, node ORDER BY
    (pr * pr + (nr - pr) * (nr - pr))::DOUBLE / nr + ((p - pr) * (p - pr) + (n - nr - p + pr) * (n - nr - p + pr))::DOUBLE / (n - nr) DESC, token, bin) AS place
  FROM sides{depth} WHERE n > nr AND pr * n <> p * nr) WHERE place = 1),
members{depth + 1} AS (SELECT {PAIR}, m.doc_id, label, in_train,
    CASE WHEN s.token IS NULL THEN node ELSE 2 * node + (coalesce(b.bin >= s.bin, false))::INT END AS node
  FROM members{depth} m LEFT JOIN splits{depth} s USING ({PAIR}, node) LEFT JOIN binned b ON m.doc_id = b.doc_id AND s.token = b.token)"""


SEQUENCES = """sequences AS (SELECT doc_id, source AS run, lang AS service,
    CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN regexp_matches(text, '[#|$]') THEN 'symbols'
      WHEN length(text) > 6000 THEN 'long' WHEN length(text) < 600 THEN 'short' ELSE 'correct' END AS test_name FROM documents)"""

TREES = f"""WITH {SEQUENCES},
tokens AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents) GROUP BY ALL),
sizes AS (SELECT token, n, count(*) AS cells FROM tokens GROUP BY ALL),
ranked AS (SELECT token, n, coalesce(sum(cells) OVER (PARTITION BY token ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
    (sum(cells) OVER (PARTITION BY token))::BIGINT AS total, row_number() OVER (PARTITION BY token ORDER BY n) - 1 AS place,
    count(*) OVER (PARTITION BY token) AS kinds FROM sizes),
binned AS (SELECT doc_id, token, (CASE WHEN kinds <= {PLAN.max_bins} THEN place ELSE floor(below * {PLAN.max_bins} / total) END)::INT + 1 AS bin
  FROM tokens JOIN ranked USING (token, n)),
errors AS (SELECT doc_id, run, service, test_name AS error_type FROM sequences WHERE test_name <> 'correct'),
drawn AS (SELECT {PAIR}, run FROM (SELECT *, row_number() OVER (PARTITION BY {PAIR}
    ORDER BY md5('{PLAN.seed}|' || error_type || '|' || service || '|' || run), run) AS place
  FROM (SELECT DISTINCT {PAIR}, run FROM errors)) WHERE place <= {PLAN.n_runs}),
members0 AS (SELECT {PAIR}, doc_id, label, 1 AS node, substring(md5('{PLAN.seed}:' || doc_id), 1, 8) >= '80000000' AS in_train FROM (
  SELECT {PAIR}, doc_id, 1 AS label FROM errors JOIN drawn USING ({PAIR}, run)
  UNION ALL SELECT error_type, service, doc_id, 0 FROM sequences JOIN drawn USING (service, run) WHERE test_name = 'correct')),
{",".join(_level(d) for d in range(PLAN.max_depth))},
leaves AS (SELECT {PAIR}, node, sum(label) / count(*) AS score FROM members{PLAN.max_depth} WHERE in_train GROUP BY ALL)"""


def _swept(spark, folder) -> tuple[DataFrame, DataFrame]:
    docs = A.table(spark, folder, "documents")
    cut = docs.withColumn("words", F.split(F.lower("text"), " "))
    tokens = stage(textmodels.sequence_tokens(cut, "doc_id", "words"), "tokens")
    kind = (
        F.when(F.lower("text").contains("license"), "license")
        .when(F.col("text").rlike("[#|$]"), "symbols")
        .when(F.length("text") > 6000, "long")
        .when(F.length("text") < 600, "short")
        .otherwise(PLAN.normal)
    )
    sequences = docs.select("doc_id", F.col("source").alias("run"), F.col("lang").alias("service"), kind.alias("test_name"))
    return sweep.tree_sweep(tokens, stage(sequences, "sequences"), "doc_id", PLAN)


@query(
    f"""{TREES} SELECT {PAIR}, doc_id, label::DOUBLE AS label, round(score, 8) AS score
    FROM members{PLAN.max_depth} LEFT JOIN leaves USING ({PAIR}, node) WHERE NOT in_train"""
)
def model_sweep(spark, folder):
    """Test scores of one tree per kind of document and language, all trees grown at once."""
    return rounded(_swept(spark, folder)[0], 8)


@query(
    f"""{TREES} {" UNION ALL ".join(f"SELECT {PAIR}, node::BIGINT AS node, token, bin, n, p AS positive FROM splits{d}" for d in range(PLAN.max_depth))}"""
)
def model_sweep_trees(spark, folder):
    """The splits of those trees."""
    return _swept(spark, folder)[1]


@query(
    f"""{TREES}, scored AS (SELECT {PAIR}, label, score FROM members{PLAN.max_depth} JOIN leaves USING ({PAIR}, node) WHERE NOT in_train),
    totals AS (SELECT {PAIR}, count(*) AS n_samples, sum(label)::BIGINT AS n_positive FROM scored GROUP BY ALL),
    wins AS (SELECT {PAIR}, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS won
      FROM scored a JOIN scored b USING ({PAIR}) WHERE a.label = 1 AND b.label = 0 GROUP BY ALL)
    SELECT {PAIR}, n_samples, round(won / (n_positive * (n_samples - n_positive)), 8) AS auroc FROM totals LEFT JOIN wins USING ({PAIR})"""
)
def model_sweep_rates(spark, folder):
    """AUROC of every tree of the sweep."""
    scored = stage(_swept(spark, folder)[0].where("score is not null"), "sweep-scores")
    rates = ranking_metrics(scored, "score", "label", sweep.PAIR)
    return rounded(rates.select(*sweep.PAIR, "n_samples", "auroc"), 8)
