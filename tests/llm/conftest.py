from __future__ import annotations

import pytest

PASSAGE = " ".join(f"shared{i} word{i % 7} tail{i}" for i in range(30))
LINE = "this very common line is longer than forty characters for sure"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "plain text of one document", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n \n", "en", None), (5, long, "en", "b"),
        (6, "plain text of one document", "en", "b"), (6, "plain text of one document", "en", "b"), (None, "no id here", "de", "a"), (7, f"{LINE}\nown seven", "en", "é"),
        *[(10 + i, f"{LINE}  \nown line {i}\n{LINE.upper()}", "en", "a") for i in range(6)], (20, f"before it {PASSAGE} after it", "en", "c"),
        (21, f"something else {PASSAGE} and an end", "en", "c"), (22, "ÄÖÜ ßé 漢字 🙂 \x00 KK", "de", "c"),
    ]
    return spark.createDataFrame([(*r, 9, "x", 0.5, "y", 1) for r in rows], "doc_id long, text string, lang string, source string, size int, keys string, score double, component_id string, fp int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
