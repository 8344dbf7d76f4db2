"""Rows with nulls, empty and long texts, ties, repeats and clashing columns, for all operators on documents."""

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def words(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


ODD_TEXTS = [
    "", None, "one", "Two Words", "A b C", words(300, 1), words(300, 1), words(300, 1) + " End", words(5000, 2),
    "  \t\n ", "日本語 テキスト\nzwei Zeilen\n\nİstanbul ΣΑΣ", "a" * 5000, "x y " * 400, words(60, 3) + "\n" + words(80, 4),
    words(70, 5) + " " + words(80, 4), "\x00\x01 nul", "🙂 🙂🙂", "É é x y",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """18 texts, one of them in a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], DOCUMENTS).selectExpr(
        "*", "'x' as fp", "1 as key", "'y' as component_id", "0 as piece", "0 as length", "'z' as digest", "1 as doc", "2 as id", "3 as _id",
            "4 as _spans", "5 as _kept", "6 as n", "7 as kept_id", "8 as row"
    )


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
