import pytest
from pyspark.sql import types as T

from trueframe.llm.common import prepare

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                          # names that the operators use themselves
                          T.StructField("size", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("sig", T.StringType())])


@pytest.fixture(scope="session")
def work(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def documents(work):
    """Documents from (id, text) or (id, text, source) rows, dealt over several partitions."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", "y", "z") for r in rows]
        return work.createDataFrame(full, DOCUMENTS).repartition(3)
    return make


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
