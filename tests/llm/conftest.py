import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return make


ODD = [(1, None), (2, ""), (3, "   \n\n "), (4, "A"), (5, "a"), (6, "é" * 30_000 + " x" * 20_000), (7, "Ünï cödé, two\nlines"),
       (7, "Ünï cödé, two\nlines"), (8, "a\nb\nA \nc"), (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (None, "no id here")]


@pytest.fixture
def odd():
    """Null and empty texts, a long one, a repeated row, a null id."""
    return list(ODD)
