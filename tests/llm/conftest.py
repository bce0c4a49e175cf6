import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

MIT = "Released under the MIT License."
LONG = " ".join(f"word{i % 997} of{i % 13} the passage" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, "   \n\t ", "en", "a", 6), (None, MIT, None, "b", 31),
        (None, None, None, None, None), (5, LONG, "en", "a", len(LONG)), (6, MIT, "en", "a", 31),
        (6, MIT, "en", "a", 31), (6, "another text under one id, é ß 漢字 \U0001f600", "de", "c", 40), (-7, LONG + " end", "en", "a", None),
        (8, "!!! ??? 123", "en", "a", 11), (None, MIT, None, "b", 31),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
