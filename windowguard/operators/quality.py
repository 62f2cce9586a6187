"""Validators: every broken rule is counted in one pass and reported together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowguard import constants as K
from windowguard.schemas import ContractConfig

NUMERIC = (T.NumericType, T.BooleanType)


class ContractError(ValueError):
    """A table breaks its contract."""


def _rule(name: str, column: str, rows: Column) -> Column:
    return F.struct(
        F.lit(name).alias("rule"), F.lit(column).alias("column"), rows.cast("long").alias("n_rows")
    )


def _hits(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _repeats(column: str) -> Column:
    """Rows beyond the first of their value; NULLs equal each other."""
    value = F.col(column)
    some_null = F.when(_hits(value.isNull()) > 0, 1).otherwise(0)
    return F.count("*") - F.count_distinct(value) - some_null


def _report(df: DataFrame, rules: list[Column]) -> DataFrame:
    counted = df.agg(F.array(*rules).alias("rules"))
    return counted.select(F.inline("rules")).where(F.col("n_rows") > 0)


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    return df.agg(_repeats(key).alias("n_duplicates"))


def _contract_rules(df: DataFrame, config: ContractConfig, repeats: Column) -> list[Column]:
    must = K.ID_COLUMNS + K.LABEL_COLUMNS
    missing = [c for c in [*must, *config.feature_columns] if c not in df.columns]
    rules = [_rule("missing_column", c, F.lit(1)) for c in missing]
    if set(missing) & set(must):
        return rules
    rules.append(_rule("duplicate", "sample_id", repeats))
    for column in [c for c in K.RATE_COLUMNS if c in df.columns]:
        value = F.col(column)
        outside = ~F.isnan(value) & ((value < 0) | (value > 1))
        rules.append(_rule("outside_0_1", column, _hits(outside)))
    injected = F.coalesce(F.col("phase") == "inject", F.lit(False))
    rules.append(
        _rule("phase_mismatch", "is_anomaly", _hits(~injected.eqNullSafe(F.col("is_anomaly"))))
    )
    return rules


def contract_violations(df: DataFrame, config: ContractConfig | None = None) -> DataFrame:
    """Rows (rule, column, n_rows) for every broken rule of the wide table.

    Missing columns count once per column; if an id or label column is missing only that is
    reported.
    """
    return _report(df, _contract_rules(df, config or ContractConfig(), _repeats("sample_id")))


def _score_rules(df: DataFrame, repeats: Column) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    empty = _rule("empty", "", F.when(F.count("*") == 0, 1).otherwise(0))
    missing = [c for c in ("sample_id", "score", "y_true") if c not in types]
    if missing:
        return [empty, *[_rule("missing_column", c, F.lit(1)) for c in missing]]
    rules = [empty]
    if not isinstance(types["sample_id"], T.StringType):
        rules.append(_rule("not_a_string", "sample_id", F.lit(1)))
    rules.append(_rule("null", "sample_id", _hits(F.col("sample_id").isNull())))
    rules.append(_rule("duplicate", "sample_id", repeats))

    raw = F.col("score")
    score = raw.try_cast("double")
    rules.append(_rule("not_a_number", "score", _hits(raw.isNotNull() & score.isNull())))
    rules.append(_rule("null", "score", _hits(raw.isNull() | F.isnan(score))))
    infinite = score.isin(float("inf"), float("-inf"))
    rules.append(_rule("infinite", "score", _hits(infinite)))

    if not isinstance(types["y_true"], NUMERIC):
        rules.append(_rule("not_numeric", "y_true", F.lit(1)))
    else:
        y = F.col("y_true").cast("double")
        absent = y.isNull() | F.isnan(y)
        rules.append(_rule("null", "y_true", _hits(absent)))
        rules.append(_rule("not_integral", "y_true", _hits(~absent & (y != F.floor(y)))))
        rules.append(_rule("outside_0_1", "y_true", _hits(~absent & ~y.isin(0.0, 1.0))))
    return rules


def scores_violations(df: DataFrame) -> DataFrame:
    """Rows (rule, column, n_rows) for every broken rule of the scores table."""
    return _report(df, _score_rules(df, _repeats("sample_id")))


NTH = "_nth_of_key"


class Watched:
    """A table to be written, whose broken rules are counted by the write itself.

    ``df`` is what to write; ``violations`` has the counts once it has been written. Repeats are told by
    numbering the rows of a key, for which the rows of a key have to meet: a table that is already dealt
    out and sorted by the key needs no exchange for that.
    """

    def __init__(self, df: DataFrame, key: list[str], rules_of: Callable[[DataFrame, Column], list[Column]]):
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
        numbered = df.withColumn(NTH, nth) if set(key) <= set(df.columns) else df.withColumn(NTH, F.lit(1))
        self._seen = Observation()
        rules = rules_of(df, _hits(F.col(NTH) > 1))
        self.df = numbered.observe(self._seen, F.array(*rules).alias("rules")).drop(NTH)

    @property
    def violations(self) -> list[tuple[str, str, int]]:
        """(rule, column, n_rows) of every broken rule; waits for the write."""
        return [(r["rule"], r["column"], r["n_rows"]) for r in self._seen.get["rules"] if r["n_rows"] > 0]

    def require_valid(self, table: str) -> None:
        found = [f"{rule} {column} ({n})" for rule, column, n in self.violations]
        if found:
            raise ContractError(f"{table} violations: " + "; ".join(found))


def watched_contract(df: DataFrame, key: list[str], config: ContractConfig | None = None) -> Watched:
    """The wide table; ``key`` are the columns that a sample_id is made of."""
    return Watched(df, key, lambda d, repeats: _contract_rules(d, config or ContractConfig(), repeats))


def watched_scores(df: DataFrame) -> Watched:
    return Watched(df, ["sample_id"], _score_rules)


def metrics_violations(df: DataFrame) -> DataFrame:
    """Rows (rule, column, n_rows) for every broken rule of the tidy metrics table."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = [
        "protocol_version", "higher_is_more_anomalous", "n_samples", "has_labels", "auroc", "auprc",
    ]
    missing = [c for c in fields if c not in types]
    if missing:
        return _report(df, [_rule("missing_column", c, F.lit(1)) for c in missing])
    rules = [_rule("wrong_version", fields[0], _hits(~F.col(fields[0]).eqNullSafe(F.lit("v0"))))]
    for flag in ("higher_is_more_anomalous", "has_labels"):
        if not isinstance(types[flag], T.BooleanType):
            rules.append(_rule("not_boolean", flag, F.lit(1)))
        elif flag == "has_labels":
            rules.append(_rule("null", flag, _hits(F.col(flag).isNull())))
        else:
            rules.append(_rule("not_true", flag, _hits(~F.col(flag).eqNullSafe(F.lit(True)))))
    if not isinstance(types["n_samples"], T.IntegralType):
        rules.append(_rule("not_an_integer", "n_samples", F.lit(1)))
    else:
        n = F.col("n_samples")
        rules.append(_rule("not_positive", "n_samples", _hits(n.isNull() | (n <= 0))))
    if isinstance(types["has_labels"], T.BooleanType):
        labelled = F.col("has_labels")
        for metric in ("auroc", "auprc"):
            if isinstance(types[metric], (T.BooleanType, T.StringType)):
                rules.append(_rule("not_numeric", metric, F.lit(1)))
                continue
            value = F.col(metric)
            inside = F.coalesce(value.between(0, 1), F.lit(False))
            rules.append(_rule("outside_0_1", metric, _hits(labelled & ~inside)))
            rules.append(_rule("set_without_labels", metric, _hits(~labelled & value.isNotNull())))
    return _report(df, rules)


def require_valid(violations: DataFrame, table: str) -> None:
    """Raise with all broken rules; the report has at most a few rows per column."""
    found = [f"{r['rule']} {r['column']} ({r['n_rows']})" for r in violations.collect()]
    if found:
        raise ContractError(f"{table} violations: " + "; ".join(found))


def hit_rate(joined: DataFrame, column: str) -> DataFrame:
    """Share of rows per case whose ``column`` is present after a left join."""
    present = F.col(column).isNotNull().cast("double")
    return joined.groupBy("case_id").agg(F.avg(present).alias("hit_rate"))
