import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def queries():
    import __spark_entry__

    return __spark_entry__.queries()


@pytest.fixture
def odd(spark):
    """Nulls, empty and white texts, repeats, a long text, and columns named like results."""
    from brute import LONG

    passage = " ".join(f"p{i}" for i in range(70))
    rows = [
        (1, "", "a"), (2, None, "b"), (3, " \t\n", None), (4, "one", "d"), (5, f"start {passage} end", "e"), (6, f"Other words {passage}", "f"),
        (7, LONG, "g"), (8, f"{LONG} tail", "h"), (9, f"start {passage} end", "i"), (10, f"start  {passage}\nend", "j"), (None, f"null id {passage}", "k"), (4, "one", "l"),
    ]
    return spark.createDataFrame([(d, t, *[x] * 8) for d, t, x in rows], "doc_id long, text string, found string, near string, exact string, _run string, _key string, _answer string, place string, digest string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
