import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text, lang, source) tuples to a table with the columns of documents and more that clash with inner names."""

    def make(*rows):
        full = [(k, t, lang, s, None if t is None else len(t), "x", "y", 1) for k, t, lang, s in ((*r, None, None)[:4] for r in rows)]
        schema = T.StructType([*DOCUMENTS, T.StructField("size", T.StringType()), T.StructField("target", T.StringType()), T.StructField("anchor", T.IntegerType())])
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def real(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
