"""The tree on sparse vectors against the one of pyspark.ml."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from windowguard.operators import textmodels, trees


def rows(spark, seed, dense=False):
    dice = random.Random(seed)
    width = 6 if dense else 60
    made = []
    for i in range(300):
        cells = {j: dice.choice([dice.random(), dice.randrange(1, 4), 0.0, -dice.random()]) for j in range(width) if dice.random() < 0.25 + 0.7 * (j < 3)}
        label = float((cells.get(1, 0.0) > 0.4) ^ (cells.get(0, 0.0) > 1) or dice.random() < 0.1)
        vector = Vectors.sparse(width, cells)
        made.append((i, label, Vectors.dense(vector.toArray()) if dense else vector))
    return spark.createDataFrame(made, ["id", "label", "features"])


@pytest.mark.parametrize(("seed", "dense"), [(1, False), (2, False), (3, True)])
def test_tree_scores_as_pyspark_ml_does(spark, seed, dense):
    df = rows(spark, seed, dense)
    train, test = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    fitted = DecisionTreeClassifier().fit(train).transform(test)
    want = {r["id"]: r["s"] for r in fitted.select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("s")).collect()}
    got = {r["id"]: r["score"] for r in textmodels.fit_predict(train, test, "tree").select("id", "score").collect()}
    assert got == want and len(set(want.values())) >= 3


def test_tree_of_a_vocabulary_no_executor_could_spread(spark):
    size = 2**31 - 2  # one number a feature would be 8 GB a row
    made = [(i, float(i % 2), Vectors.sparse(size, {7: 1.0 + i % 2, 10**9 + i: 1.0})) for i in range(8)]
    train = spark.createDataFrame(made, ["id", "label", "features"])
    got = {r["id"]: r["score"] for r in textmodels.fit_predict(train, train, "tree").select("id", "score").collect()}
    assert got == {i: float(i % 2) for i in range(8)}


def test_tree_of_pure_or_no_rows(spark):
    train = spark.createDataFrame([(1, 1.0, Vectors.dense([2.0])), (2, 1.0, Vectors.dense([3.0]))], ["id", "label", "features"])
    assert trees.grow(train) == {1: trees.Node(2, 2)}
    assert textmodels.fit_predict(train, train, "tree").select("score").distinct().first()[0] == 1.0
    assert trees.grow(train.limit(0)) == {1: trees.Node(0, 0)}
