import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from larder.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
#: Null, empty and blank texts, repeated rows, ties, a very long text and one without spaces.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven eight nine ten eleven"), (4, "one two three four five six seven eight nine ten eleven"),
    (5, "ONE two Three four five six seven eight nine ten eleven"), (6, "word " * 60_000), (7, "x" * 50_000), (None, "a text without an id"), (8, "é ß 中 🙂 ́ \x1c\x85"),
]


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with a column whose name clashes with ones the operators make."""
    return spark.createDataFrame([(i, t, "en", None if i == 4 else "s", i) for i, t in ODD], "doc_id bigint, text string, lang string, source string, row_key bigint")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
