import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *(T.StructField(n, T.StringType()) for n in ("key", "fp", "label", "k1", "row_", "size", "shard", "score", "n_words", "place")),
    ]
)


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""

    def of(rows):
        full = [(*r, *([None] * (4 - len(r))), len(r[1] or ""), *("x" * 10)) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


@pytest.fixture
def labels(spark):
    def of(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return of
