from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words: ``prose(seed, n)``."""
    def make(seed: int, n: int, vocabulary: int = 4000) -> str:
        draw = random.Random(seed)
        return " ".join(f"{draw.choice('bcdfglmnprst')}{draw.choice('aeiou')}{draw.randrange(vocabulary)}" for _ in range(n))
    return make


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one long text, and clashing extra columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "s", 10, 1, "x", "y"), (1, "alpha beta gamma delta epsilon", "en", "s", 10, 1, "x", "y"),
        (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 2, "x", "y"), (4, " \n\t ", "en", "s", 4, 2, "x", "y"),
        (None, "some words of a page without an id", "en", None, 9, 3, None, None), (5, "one", "fr", "s", 3, 4, "x", "y"),
        (6, "x" * 5000, "en", "s", 5000, 5, "x", "y"), (7, "word " * 30000, "en", "t", 150000, 6, "x", "y"),
        (8, "naïve Ünïcode 日本語 \U0001F600 text with marks!!! and 123", "de", "t", 40, 7, "x", "y"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score long, content string, node string")
