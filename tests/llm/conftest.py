import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns named like ours."""
    rows = [
        (1, "one two three four five " * 5, "en", "a"), (1, "one two three four five " * 5, "en", "a"), (2, "one two three four five " * 5, None, None),
        (3, None, "en", "a"), (4, "", "en", "a"), (5, " \n\t ", None, "b"), (6, "word", "fr", "b"), (7, "x" * 300_000, "en", "b"), (8, "Lorem ipsum dolor sit amet " * 8000, "en", "a"),
        (None, "no id here at all, is there", "en", None), (None, None, None, None), (9, "naïve café — Ünïcode 漢字 😀", "fr", "a"), (9, "same id, other text", "de", "a"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit("own") for c in ("id", "h", "fp", "th", "size", "copies", "score", "y", "row", "key", "hash", "k", "m", "batch", "held_out")})
