import pytest

#: Rows that every operator must take: nulls in any column, empty, blank and long texts, ties and repeated rows.
HARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (4, "one two three", "de", None, 13), (5, "one two three", "de", "b", 13),
    (5, "one two three", "de", "b", 13), (None, "lonely words without an id", "en", "b", 26), (6, "é ß 漢字 🙂 " * 40, "fr", "b", 440), (7, "word " * 30_000, "en", "a", 150_000),
    (8, "x" * 60_000, "en", "a", 60_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(hard):
    """The same with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "f", "found", "size", "taken", "key", "kept", "n_words", "fp", "component_id", "words", "score", "a", "b"]
    return hard.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
