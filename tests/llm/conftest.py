import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Rows (doc_id, text) with a column beside them that has a clashing name."""

    def make(rows, columns="doc_id long, text string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, columns).withColumns({"n": F.lit(1), "fp": F.lit("x"), "full": F.lit(2), "runs": F.lit(3)})

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """All rows of the smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
