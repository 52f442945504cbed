import zlib

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash in name."""
    long = "lorem ipsum dolor " * 20000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, long, "en", "a", len(long)), (5, "same words here again", "en", "b", 21),
        (5, "same words here again", "en", "b", 21), (6, "same words here again", None, "b", 21), (None, "no id at all in this row", "en", "a", 24), (None, None, None, None, None), (7, "!!! 123 \x00 ﷽ 日本語 🤗", "xx", "c", 20),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' AS score", "1 AS `TEXT`", "2 AS `a.b`", "3 AS kept", "4 AS component_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def remainder():
    return lambda i, n: zlib.crc32(("" if i is None else str(i)).encode()) % n
