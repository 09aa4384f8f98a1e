import pytest


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
