import pytest

ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one two three", None, "b"),
    (4, "one two three", None, "b"), (None, "no id here but words", "fr", None), (5, "word " * 60_000, "en", "a"),
    (6, "été à la plage " * 40, "fr", "é"), (7, "x" * 300_000, "de", "b"), (8, "😀 𝒳 ###", "en", "c"),
    (9, "alpha beta gamma delta " * 30, "en", "a"), (10, "alpha beta gamma delta " * 30, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("x")).withColumn("kept", F.lit(3)).withColumn("value", F.lit(1))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
