from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("score", T.StringType()), T.StructField("n", T.IntegerType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from lamplight.session import ship

    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Rows to a table with columns whose names clash with what operators make; every column may hold nulls."""

    def make(rows):
        full = [(*row, None, "x" if i % 2 else None, i)[:5] for i, row in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
