"""Small tables with the odd cases that every operator has to stand."""

from __future__ import annotations

import pytest

COPY = "The river of the valley runs to the sea and it is as wide as the lake of the town near the old mill by the road."
LONG = " ".join(f"word{k % 977} of the{k}" for k in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, repeated rows, a null id, a very long text, and columns with names of results."""
    rows = [
        (1, None, "en", None, None),
        (2, "", None, "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, COPY, "en", "a", len(COPY)),
        (4, COPY, "en", "a", len(COPY)),
        (5, COPY, "en", "b", len(COPY)),
        (6, "one two", "en", "b", 7),
        (7, "one two", "en", "b", 7),
        (None, COPY, "en", "b", 9),
        (None, None, None, None, None),
        (8, LONG, "en", "a", len(LONG)),
        (9, "ёж — 日本語 \U0001f600 ﬁ password=abcdefgh1234 <|endoftext|>", "xx", "a", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "7 AS score", "'x' AS kept", "'y' AS n_tokens", "'z' AS ids", "'s' AS spans", "1 AS class_id")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
