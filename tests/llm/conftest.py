import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, other scripts."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(40)}" for _ in range(30_000)]
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (None, "A null id with a few words of its own here"),
        (5, "Same text here on one line of more than forty characters, twice."),
        (6, "Same text here on one line of more than forty characters, twice."),
        (6, "Same text here on one line of more than forty characters, twice."),
        (7, " ".join(words)),
        (8, "é   ü — 漢字 " * 12),
        (9, "one two three"),
        (10, "x" * 5000),
        (11, None, None),
    ]
