"""Table folders on the cluster's file system."""
from __future__ import annotations

from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists with some data or partition in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(not status.getPath().getName().startswith(("_", ".")) for status in fs.listStatus(folder))
