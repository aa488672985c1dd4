import pytest
from pyspark.sql import types as T


@pytest.fixture
def documents(spark):
    """A frame of texts, with two columns whose names operators use inside."""

    def make(texts, ids=None, langs=None):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("node", T.StringType())])
        ids = range(len(texts)) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        return spark.createDataFrame([(i, t, x, "clash", None) for i, t, x in zip(ids, texts, langs)], schema).repartition(3)

    return make
