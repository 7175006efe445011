import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows."""

    def build(rows):
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long = "word number one two three four five six " * 5000
    return [(1, None, None, None), (2, "", "en", "s"), (3, long, "en", "s"), (3, long, "en", "s"), (None, "no id here at all today", "en", None), (4, "!!! ???", "de", "t"), (5, "short", "de", "t"), (6, "short", None, "t"), (7, "Ünïcode \U0001f600 text\x00 with ﬁ ligature İ", "fr", "t")]


@pytest.fixture(scope="session")
def odd(make, odd_rows, spark):
    """Odd rows with more columns, of names that operators use inside."""
    from pyspark.sql import functions as F

    return make(odd_rows).withColumns({"bucket": F.lit(1), "score": F.lit("x"), "size": F.lit(2), "id": F.lit(3), "copies": F.lit(0), "ids": F.lit(None).cast("string")})
