"""Small documents with every awkward case, shared by the operators' tests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that clash with those the operators use inside.
        T.StructField("t", T.StringType()),
        T.StructField("fp", T.LongType()),
        T.StructField("found", T.StringType()),
        T.StructField("__row", T.LongType()),
    ]
)


def words(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocab)}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    shared = words(rng, 60)
    texts = [words(rng, rng.randrange(55, 160)) for _ in range(12)]
    texts += [texts[0], texts[0], texts[1] + " tail", f"{words(rng, 30)} {shared} {words(rng, 20)}", f"{shared}. {words(rng, 70)}", f"{words(rng, 4)} {shared}"]
    texts += [None, "", "   \n\t ", "one", "one two", "é à ü ß 漢字 " * 12, "same same same " * 40, "line of text\n" * 9, words(rng, 9000)]
    rows = [(i, t, "en", "web", None if t is None else len(t), "x", 1, None, i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, "another text under an id in use " * 9, None, "web", 3, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
