import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and a column that clashes."""
    long = " ".join(f"word{i * i % 9973}" for i in range(60_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, " \t\n", "en", "a", 3), (4, "one", "en", "b", 3), (5, "one two", "en", "b", 7),
        (6, "the same words again and again " * 9, "en", "a", 270), (6, "the same words again and again " * 9, "en", "a", 270), (7, long, "en", "c", len(long)),
        (8, "éà 日本 <b> & 100% #tag | $5 😀 x y" + " z" * 5, "fr", None, 40), (None, "no id at all here", "en", "a", 17), (9, "a" * 5000, "en", "b", 5000), (10, "ONE Two", "en", "b", 7),
        (11, "one two", "en", "c", 7),
    ]
    return spark.createDataFrame([(*r, 7, 8, 9) for r in rows], DOCS + ", fp long, size long, n_words long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
