"""Cutting lineage on shared storage."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a cluster a missing setting is an
    error, because executors cannot share a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="faultlens-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably; survives executor loss and freezes non-deterministic partition ids."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
