import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text[, lang]) with columns whose names operators use themselves."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(*r, None)[:3] for r in rows], DOCS)
        clash = {c: F.lit("x") for c in ("key", "node", "size", "shard", "w", "n", "label", "doc", "text_hash", "spans", "rep", "h", "p", "row")}
        return df.withColumns(clash)

    return make


@pytest.fixture(scope="session")
def given(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
