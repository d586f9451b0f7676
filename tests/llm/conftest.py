import numpy as np
import pytest


@pytest.fixture()
def rng():
    return np.random.default_rng(7)


@pytest.fixture(scope="session")
def small_docs(spark):
    """Documents of the smallest test scale."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
