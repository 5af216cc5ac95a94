from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, node string, row string, label int, text_key int, row_n int"


def table(spark, pairs):
    """Documents with further columns whose names operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", 1, 1, 1) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def edge_pairs():
    """NULL and empty texts, NULL and repeated ids, repeated rows, white space, odd characters, a very long text."""
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40_000))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c\n\nd é 日本 \x00 😀"), (5, "a b c\n\nd é 日本 \x00 😀"), (5, "another text for the id"),
        (None, "text without an id"), (None, None), (6, long), (7, "word " * 5000), (8, "x" * 100_000),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_pairs):
    return table(spark, edge_pairs)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
