import os

import pytest

LONG = "Ab cd ef gh " * 40_000


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with NULLs, empty and very long texts, repeated rows and columns with clashing names."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, LONG, "en", "b"), (5, LONG, "en", "c"),
        (6, "The cat sat.\n\nThe cat sat.\nÉté 🙂 ▁x  y", "fr", "d"), (6, "The cat sat.\n\nThe cat sat.\nÉté 🙂 ▁x  y", "fr", "d"),
        (None, "no id here", "en", "a"), (8, "12 34 <|endoftext|> !!", "en", None), (None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return docs.selectExpr("*", "1 AS score", "'x' AS row", "2 AS key", "3 AS rank", "4 AS length", "5 AS places", "6 AS root")


@pytest.fixture(scope="session")
def large():
    return os.path.join(os.environ.get("TESTDATA", "/root/testdata"), "sf0.1")
