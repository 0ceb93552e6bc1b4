import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def clashing(docs_of):
    """The same table with extra columns named like those the operators make."""
    from pyspark.sql import functions as F

    extra = ("id ids start length offset sequence_id size shard slot h n node key score decoded spans "
             "component_id n_links class_id keep_id kept group_size label features").split()

    def make(rows):
        return docs_of(rows).withColumns({c: F.lit("x") for c in extra})

    return make
