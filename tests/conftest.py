import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultlens.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over single texts: ``one(texts, column_fn)`` returns the values in order."""
    from pyspark.sql import functions as F

    def run(texts, fn):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        return [row.v for row in df.select("i", fn(F.col("text")).alias("v")).orderBy("i").collect()]

    return run
