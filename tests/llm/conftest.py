import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture()
def docs(spark):
    """Builds a documents table from (doc_id, text, lang, source) rows."""
    def make(rows):
        full = [(*r, None, None)[:4] for r in rows]
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in full], DOCS)
    return make
