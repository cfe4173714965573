import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()),  # clashes with names inside the operators
        T.StructField("fp", T.StringType()),
    ]
)


@pytest.fixture
def docs(spark):
    """Makes documents from texts or (doc_id, text, source) rows, with clashing further columns."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc, text, source = r if isinstance(r, tuple) else (i, r, f"s{i % 3}")
            full.append((doc, text, "en", source, len(text or ""), "x", "y"))
        return spark.createDataFrame(full, SCHEMA)

    return make


SF = "/root/testdata/sf0.001"
