import pytest

ODD = [
    (1, "The same line here.\nAnother line of words.\nThe same line here.", "en", "a", 5),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "en", "b", 4),
    (5, "word", "en", "b", 4),
    (6, "The same line here.\nAnother line of words.\nThe same line here.", "en", "a", 5),
    (6, "The same line here.\nAnother line of words.\nThe same line here.", "en", "a", 5),
    (None, "a row without an id, but with words", "en", "c", 9),
    (7, "ein " * 3000 + "Ende. \U0001f600 é 漢字", "de", "a", 12000),
    (8, "alpha beta gamma delta epsilon zeta eta theta " * 3 + "# * $ | <end>", "en", "c", 80),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank and long texts, ties, repeated rows."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns named like what operators use or return."""
    from pyspark.sql import functions as F

    extra = ("size", "fp", "component_id", "taken", "target", "shard", "slot", "key", "n", "host", "line", "score", "a.b", "value")
    return odd.select("*", *(F.lit("x").alias(c) for c in extra))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
