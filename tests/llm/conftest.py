import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
#: Names that operators use inside.
CLASHES = ["run", "digest", "norm", "keep_id", "copies", "salt", "fp", "n", "key", "score", "predicted", "part", "order", "size", "piece", "length", "rank", "low", "first", "hash", "bytes", "depth", "bucket", "shard", "page", "head", "payload", "vector", "ids", "block"]


def frame(spark, rows):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES if c not in df.columns})


@pytest.fixture
def docs(spark):
    return lambda rows: frame(spark, rows)


#: Nulls, empty and very long texts, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a  b"), (5, "a\tb"), (5, "a\tb"), (6, "a b"), (None, "a b"), (None, "only here"), (7, "word " * 30_000), (8, "word " * 30_000 + "end"), (9, "é\x00\x1c "), (10, "one two three four five")]
