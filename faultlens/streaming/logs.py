"""Streaming log classification and key-block redaction."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from faultlens.functions.redaction import KEY_BEGIN, KEY_END, marker, redact
from faultlens.functions.text import newline_normalized
from faultlens.operators.classify import classify_artifacts
from faultlens.streaming.state import use_keyed_state


def log_stream(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """New log files of a folder, one row per file."""
    files = (
        spark.readStream.format("text").schema("value string").option("wholetext", "true")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))
    return files.select(F.col("_metadata.file_path").alias("artifact_id"), newline_normalized("value").alias("text"))


def classify_stream(stream: DataFrame) -> DataFrame:
    """Stateless: the batch classifier on each arriving log."""
    return classify_artifacts(stream).drop("text")


def key_block_stream(stream: DataFrame, keys: list[str], order: str, line: str = "line", ttl_days: int | None = None) -> DataFrame:
    """``logtext.key_block_lines`` over a stream: whether a block is open is kept for each key from batch to batch.

    ``order`` must grow over the stream for each key; lines of one key may arrive in any order inside a batch. Only keys with lines in a
    batch are touched and only open blocks are kept; with ``ttl_days`` one that brings no line for so long by the clock is forgotten (such
    a stream wakes up by itself and runs until it is stopped).
    """
    use_keyed_state(stream.sparkSession)
    columns = list(stream.columns)

    class KeyBlocks(StatefulProcessor):
        def init(self, handle) -> None:
            self.open = handle.getValueState("open", "since long") if ttl_days is None else handle.getValueState("open", "since long", ttl_days * 86_400_000)

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows), ignore_index=True).set_axis([*columns, "_opens", "_closes"], axis=1).sort_values(order, kind="stable")
            before = self.open.exists()
            # 1 after a line that only opens a block, 0 after one that closes it.
            mark = pd.Series(np.where(batch["_closes"], 0.0, np.where(batch["_opens"], 1.0, np.nan)), index=batch.index).ffill().fillna(float(before))
            yield batch[[*columns, "_opens"]].assign(_inside=mark.shift(1, fill_value=float(before)).to_numpy() > 0)
            if mark.iloc[-1]:
                self.open.update((int(batch[order].iloc[-1]),))
            elif before:
                self.open.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            return iter(())

    opens, closes = (F.coalesce(F.col(line).rlike(p), F.lit(False)) for p in (KEY_BEGIN, KEY_END))
    marked = stream.withColumn("_opens", opens).withColumn("_closes", closes)
    flags = StructType.fromDDL("_opens boolean, _inside boolean")
    judged = marked.groupBy(*keys).transformWithStateInPandas(KeyBlocks(), StructType([*stream.schema.fields, *flags.fields]), "Append", "None" if ttl_days is None else "ProcessingTime")
    shown = F.when(F.col("_opens"), marker("private_key")).otherwise(redact(F.col(line)))
    return judged.filter("NOT _inside").withColumn(line, shown).select(*columns)
