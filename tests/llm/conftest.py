import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return [(1, "the cat and the dog " * 4, "en", "a", 80), (2, "the cat and the dog " * 4, "en", "a", 80), (3, None, None, None, None),
            (4, "", "en", "b", 0), (5, "   \n\t ", "en", "b", 6), (6, LONG, "en", None, len(LONG)), (None, "a null id", "en", "b", 9),
            (7, PASSAGE + " tail one", "en", "c", 1), (8, "head two " + PASSAGE, "en", "c", 1), (9, "Ünïcödé 中文 \u00a0\u2028x 🙂 " + "ß" * 40, "de", "c", 1),
            (10, "repeated row here", "en", "a", 17), (10, "repeated row here", "en", "a", 17), (11, "x", "en", "c", 1)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """Extra columns named like the operators' own columns."""
    from pyspark.sql import functions as F

    names = ("shard", "payload", "bucket", "fp", "size", "key", "tie", "row", "rank", "host", "w", "t", "c", "hits", "kept", "digest")
    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
