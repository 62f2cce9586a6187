import random
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[2]


@pytest.fixture(autouse=True, scope="session")
def workers_find_the_library(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))


def prose(seed: int, n: int, words: int = 400) -> str:
    """Invented words; few enough that short windows repeat by chance and long ones do not."""
    dice = random.Random(seed)
    return " ".join(f"w{dice.randrange(words):x}é" if dice.random() < 0.1 else f"w{dice.randrange(words):x}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty and blank texts, copies, near copies, repeated rows and ids."""
    shared, long = prose(1, 120), prose(2, 4000)
    edited = shared.split()
    edited[60] = "changed"
    rows = [
        (1, shared),
        (2, f"{prose(3, 50)} {shared}\n{prose(4, 30)}"),
        (3, shared),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, " ".join(edited)),
        (8, long),
        (9, f"{prose(5, 20)}\n{long}"),
        (10, "one two"),
        (11, "ONE  two"),
        (12, "la " * 500),
        (13, f"{prose(6, 25)}\n" * 4),
        (14, prose(7, 90)),
        (14, prose(8, 90)),
        (15, prose(9, 60)),
        (15, prose(9, 60)),
        (None, shared),
        (None, prose(10, 40)),
        (None, None),
        (16, "éèà üß " * 80),
        (17, prose(11, 19)),
        (18, prose(12, 20)),
        (19, prose(12, 20)),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with columns whose names the operators use themselves."""
    rows = [(d, t, "en", f"src{i % 3}", i, None) for i, (d, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, bucket int, kept boolean"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
