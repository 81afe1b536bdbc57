"""The folder that driver and executors share, and files in it.

The folder is the one the cluster names in ``spark.checkpoint.dir``; on a local master without that setting it is the
session's checkpoint folder or a temporary one. Tasks write a file under a name of their own attempt and then rename it, so a
repeated or speculative task leaves the same whole file.
"""
from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    used = context._jsc.sc().getCheckpointDir()
    if used.isDefined():
        return used.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="faultlens-llm-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a new, not yet existing folder in the shared one."""
    return f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put_file(uri: str, chunks) -> int:
    """Write byte chunks as one file, visible under ``uri`` only when whole. Returns its size."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with system.open_output_stream(attempt) as out:
        for chunk in chunks:
            data = memoryview(chunk).cast("B")
            out.write(data)
            size += len(data)
    system.move(attempt, path)
    return size


def map_array(uri: str, dtype, offset: int, length: int) -> np.ndarray:
    """Memory-mapped array inside a shared file; the folder has to be mounted on the workers."""
    system, path = locate(uri)
    if not isinstance(system, pafs.LocalFileSystem):
        raise ValueError(f"{uri} can't be memory-mapped: mount the shared folder on the workers and name it as file://")
    if not length:
        return np.empty(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(length,))


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over batches, after which freed memory goes back to the system: its worker process lives on for other stages."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
