import pytest
from pyspark.sql import SparkSession

from faultlens.llm.registry import with_package


@pytest.fixture(autouse=True)
def shipped(spark: SparkSession):
    with_package(spark)


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text) rows, with columns whose names clash with results."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", None, 1.5, True) for i, t in rows],
            "doc_id long, text string, score string, n_tokens long, posterior double, contaminated boolean")
    return make
