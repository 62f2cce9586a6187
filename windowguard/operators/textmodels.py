"""Message features, token counts per sequence and the models built on them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowguard.functions import scalars as S
from windowguard.operators import trees
from windowguard.operators.series import HEAVY_ROWS, prefix_sums
from windowguard.session import scratch, stage


def message_features(df: DataFrame, message: str, trigrams: str = "char") -> DataFrame:
    """Length, normalised text, words and trigrams of each message; NULL messages are dropped.

    Trigrams are over characters by default, over words with ``trigrams="word"``.
    """
    if trigrams not in ("char", "word"):
        raise ValueError("trigrams must be 'char' or 'word'")
    make = S.char_trigrams if trigrams == "char" else S.word_trigrams
    normalized = F.col("e_message_normalized")
    return (
        df.where(F.col(message).isNotNull())
        .withColumn("e_message_len", F.length(message))
        .withColumn("e_message_normalized", S.normalize_message(F.col(message)))
        .withColumns({"e_words": S.words(normalized), "e_trigrams": make(normalized)})
    )


def sequence_tokens(
    df: DataFrame, seq_id: str, tokens: str, by: list[str] | None = None
) -> DataFrame:
    """Token counts per sequence: (by, seq_id, token, n).

    The counts stand for the token list of a sequence, which may be too long for one row. They
    are pre-aggregated before the shuffle, and the shuffle key holds the token.
    """
    keys = [*(by or []), seq_id]
    return (
        df.select(*keys, F.explode(tokens).alias("token"))
        .groupBy(*keys, "token")
        .agg(F.count("*").alias("n"))
    )


def event_tokens(matched: DataFrame, seq_id: str) -> DataFrame:
    """Sequences of events: the template ids of a sequence's lines as tokens with their counts."""
    return matched.groupBy(seq_id, F.col("template_id").alias("token")).agg(F.count("*").alias("n"))


def sequence_lengths(df: DataFrame, seq_id: str, by: list[str] | None = None) -> DataFrame:
    """Number of events per sequence."""
    return df.groupBy(*(by or []), seq_id).agg(F.count("*").alias("seq_len"))


def split_by_hash(df: DataFrame, key: str, fraction: float = 0.5, seed: int = 42):
    """Shuffled (train, test) split decided by a hash of the id: the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    share = F.conv(digits, 16, 10).cast("double") / F.lit(float(16**8))
    return df.where(share >= fraction), df.where(share < fraction)


def vocabulary(train: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Document frequency of each token: (by, token, df)."""
    return train.groupBy(*(by or []), "token").agg(F.count("*").alias("df"))


def oov_score(
    train: DataFrame, test: DataFrame, seq_id: str, by: list[str] | None = None
) -> DataFrame:
    """Tokens of each test sequence that no training sequence has, repeats counted.

    ``train`` (Normal only) and ``test`` are token counts of ``sequence_tokens``.
    """
    by = by or []
    known = vocabulary(train, by).withColumn("_known", F.lit(True)).drop("df")
    # A task keeps its part of the vocabulary, a row a word, in memory and sorts none of the cells.
    joined = test.join(known.hint("shuffle_hash"), [*by, "token"], "left")
    unseen = F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0))
    return joined.groupBy(*by, seq_id).agg(
        F.sum("n").alias("n_tokens"), unseen.alias("oov_count")
    )


def rarity_score(
    train: DataFrame,
    test: DataFrame,
    seq_id: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Sum over the tokens of a test sequence of -ln(df / N), tokens unseen in training left out.

    The formula is our choice: df and N count training sequences (per group of ``by``).
    """
    by = by or []
    words = vocabulary(train, by)
    if by:
        total = train.groupBy(*by).agg(F.count_distinct(seq_id).alias("_total"))
        words = words.join(total, by)
    else:
        words = words.withColumn("_total", train.agg(F.count_distinct(seq_id)).scalar())
    weight = -F.log(F.col("df") / F.col("_total"))
    weighted = test.join(words.select(*by, "token", weight.alias("_w")), [*by, "token"], "left")
    return weighted.groupBy(*by, seq_id).agg(
        F.coalesce(F.sum(F.col("n") * F.col("_w")), F.lit(0.0)).alias("rarity")
    )


def indexed_vocabulary(train: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Vocabulary with a dense index from 0, in hash order, found without one global sort."""
    hashed = vocabulary(train).withColumn("_hash", F.xxhash64("token"))
    groups = hashed.groupBy("_hash").agg(F.count("*").alias("n"))
    ranked = prefix_sums(groups, [], "_hash", ["n"], heavy_rows).select("_hash", "n_before")
    same = Window.partitionBy("_hash").orderBy("token")
    return hashed.join(ranked, "_hash").select(
        "token", "df", (F.col("n_before") + F.row_number().over(same) - 1).alias("index")
    )


def vector_cells(train: DataFrame, tokens: DataFrame, seq_id: str, kind: str = "tfidf") -> DataFrame:
    """Non-zero cells (seq_id, token, index, weight) of the vectors of ``tokens`` over the training vocabulary.

    ``kind`` is tfidf (idf = ln((N + 1) / (df + 1)) + 1, each vector scaled to length 1) or count.
    Every cell is a row, so neither a long sequence nor a large vocabulary meets in one.
    """
    return _cells(stage(indexed_vocabulary(train), "vocabulary"), train, tokens, seq_id, kind)


def _cells(words: DataFrame, train: DataFrame, tokens: DataFrame, seq_id: str, kind: str) -> DataFrame:
    if kind not in ("tfidf", "count"):
        raise ValueError("kind must be 'tfidf' or 'count'")
    if kind == "count":
        return tokens.join(words, "token").select(seq_id, "token", "index", F.col("n").cast("double").alias("weight"))
    total = train.agg(F.count_distinct(seq_id)).scalar()
    idf = F.log((total + 1) / (F.col("df") + 1)) + 1
    raw = tokens.join(words, "token").select(seq_id, "token", "index", (F.col("n") * idf).alias("_raw"))
    norms = raw.groupBy(seq_id).agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_norm"))
    return raw.join(norms, seq_id).select(seq_id, "token", "index", (F.col("_raw") / F.col("_norm")).alias("weight"))


def vectorize(train: DataFrame, test: DataFrame, seq_id: str, kind: str = "tfidf"):
    """Stored vectors (seq_id, features) of train and test over the training vocabulary.

    A vector is written as the fields it consists of and read back as a vector, so that no Python
    runs, models fit on stored data, and a vector is never longer than its sequence has tokens.
    """
    words = stage(indexed_vocabulary(train), "vocabulary")
    size = words.agg(F.count("*")).scalar().cast("int")

    def vectors(tokens: DataFrame) -> DataFrame:
        cells = _cells(words, train, tokens, seq_id, kind)
        rows = cells.groupBy(seq_id).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("_cells"))
        every = tokens.select(seq_id).distinct().join(rows, seq_id, "left")
        found = F.coalesce("_cells", F.array().cast("array<struct<index:long,weight:double>>"))
        features = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            size.alias("size"),
            F.transform(found, lambda c: c["index"].cast("int")).alias("indices"),
            F.transform(found, lambda c: c["weight"]).alias("values"),
        )
        fields = every.select(seq_id, features.alias("features"))
        schema = T.StructType([fields.schema[seq_id], T.StructField("features", VectorUDT())])
        return stage(fields, "vectors", schema)

    return vectors(train), vectors(test)


def nearest_center(rows: DataFrame, centers: list[list[float]]) -> DataFrame:
    """Add ``score``, the distance of ``features`` to the nearest centre, over its non-zero cells only."""
    spark = rows.sparkSession
    norms = [sum(x * x for x in c) for c in centers]
    table = spark.createDataFrame([(centers, norms)], "c array<array<double>>, n array<double>")
    point = F.unwrap_udt("features")
    dense = F.sequence(F.lit(0), F.size(point["values"]) - 1)
    cells = F.arrays_zip(F.coalesce(point["indices"], dense).alias("i"), point["values"].alias("x"))
    every = rows.withColumns({"_centers": table.select(F.struct("c", "n")).scalar(), "_cells": cells})

    def squared(center: Column, norm: Column) -> Column:
        gap = F.aggregate("_cells", norm, lambda a, p: a + p["x"] * (p["x"] - 2 * F.get(center, p["i"])))
        return F.greatest(gap, F.lit(0.0))

    gaps = F.zip_with("_centers.c", "_centers.n", squared)
    return every.withColumn("score", F.sqrt(F.array_min(gaps))).drop("_centers", "_cells")


def fit_predict(train: DataFrame, test: DataFrame, model: str, seed: int = 42) -> DataFrame:
    """Anomaly score of each test row.

    ``tree`` and ``logistic`` learn from ``label`` and give the probability of label 1.
    ``kmeans`` fits on the rows it is given (Normal ones) and gives the distance to the nearest
    of two centres.
    """
    from pyspark.ml.functions import vector_to_array

    if model == "kmeans":
        fitted = KMeans(k=2, seed=seed).fit(train)
        return nearest_center(test, [[float(x) for x in c] for c in fitted.clusterCenters()])
    if model == "tree":
        return trees.score(test, trees.grow(train))
    if model != "logistic":
        raise ValueError(f"unknown model {model!r}, use kmeans, tree or logistic")
    fitted = LogisticRegression(tol=1e-9, maxIter=200).fit(train)
    # A fitted model holds its session, which cannot be sent to tasks once it has observed a table; a loaded one does not.
    path = scratch(train.sparkSession, "logistic")
    if path is not None:
        fitted.save(path)
        fitted = LogisticRegressionModel.load(path)
    predicted = fitted.transform(test)
    score = F.get(vector_to_array("probability"), F.lit(1))
    return predicted.withColumn("score", score).drop("rawPrediction", "probability", "prediction")


def sample_runs(
    index: DataFrame,
    n_runs: int,
    errors_per_run: int,
    dup_errors: bool = True,
    error_type: str | None = None,
    service: str | None = None,
    seed: int = 42,
    normal: str = "correct",
) -> DataFrame:
    """Choose runs, and per run its normal test plus some error tests, from a file index.

    ``index`` has (run, test_name, service). The choice follows a hash of the names, so that it
    is random but repeatable. Without ``dup_errors`` no error type serves two runs. Only the
    distinct names are ranked; the files of a chosen test all stay.
    """

    def dice(*names: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *names))

    files = index if service is None else index.where(F.col("service") == service)
    tests = files.select("run", "test_name").distinct()
    chosen_runs = (
        tests.select("run").distinct().withColumn("_dice", dice("run")).orderBy("_dice", "run").limit(n_runs)
    )
    runs = chosen_runs.select("run", "_dice")
    errors = tests.where(F.col("test_name") != normal).join(runs.select("run"), "run", "left_semi")
    if error_type is not None:
        errors = errors.where(F.col("test_name") == error_type)
    if dup_errors:
        rank = F.row_number().over(
            Window.partitionBy("run").orderBy(dice("run", "test_name"), "test_name")
        )
        picked = errors.withColumn("_rank", rank).where(F.col("_rank") <= errors_per_run)
    else:
        # Error types are dealt out in hash order, errors_per_run to each of the n_runs in turn.
        deal = Window.orderBy("_dice", "run")
        seats = runs.select("run", (F.row_number().over(deal) - 1).alias("_seat"))
        number = F.conv(F.substring(dice("test_name"), 1, 15), 16, 10).cast("long")
        kinds = errors.select("test_name").distinct().withColumns({"_dice": number, "n": F.lit(1)})
        seat = F.floor(F.col("n_before") / F.lit(errors_per_run)).cast("int").alias("_seat")
        dealt = prefix_sums(kinds.drop("test_name"), [], "_dice", ["n"]).select("_dice", seat)
        names = kinds.join(dealt, "_dice").select("test_name", "_seat")
        picked = errors.join(seats, "run").join(names, ["test_name", "_seat"])
    normals = tests.where(F.col("test_name") == normal).join(runs.select("run"), "run", "left_semi")
    chosen = normals.unionByName(picked.select("run", "test_name"))
    return files.join(chosen, ["run", "test_name"], "left_semi")
