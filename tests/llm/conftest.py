import pytest


@pytest.fixture(scope="session")
def make(spark):
    """documents with an extra column whose name clashes with helper and result columns."""

    def of(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' as score", "1 as block", "'y' as n", "2 as k", "3 as shard", "'z' as h")

    return of
