import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) or (doc_id, text, source, lang)."""
    def make(rows, extra=None):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(value))
        return df
    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCS))
