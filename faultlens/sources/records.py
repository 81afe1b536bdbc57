"""Elements of XML documents of any size, read in parallel pieces of a file.

A file is cut at ``>``, which every tag ends with, so its pieces are read like lines, each from its own byte range. Starts of the wanted
element are counted piece by piece; what follows a start up to the next one belongs to it, also across pieces. A row holds
one element, never the document.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultlens.functions.text import newline_normalized
from faultlens.sources.artifacts import BROADCAST_PIECES


BLOCK = 1 << 16  # chunks that are numbered together
BLOCKS = 8  # of one task


def read_elements(spark: SparkSession, folder: str, tag: str, pattern: str = "*.xml") -> DataFrame:
    """element(artifact_id, path, pos, xml): the source of each ``tag`` element (which don't nest) from its start to the next one's.

    ``pos`` counts from 0 over the file; files are cut into pieces of ``spark.sql.files.maxPartitionBytes``. ``xml`` may end with what stands
    between two elements. Documents with a type declaration are left out. Undecodable bytes become replacement characters.
    """
    files = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", ">").load(folder)
    chunk = F.make_valid_utf8("value")
    rows = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_id"), chunk.alias("_chunk"))
    rows = rows.withColumn("_block", F.floor(F.col("_id") / BLOCK))
    starts = F.col("_chunk").rlike(rf"<(?:[\w.-]+:)?{tag}(?=[\s/]|\z)").cast("int")
    pieces = rows.groupBy("path", "_piece", "_block").agg(
        F.sum(starts).alias("_starts"), F.max(F.upper(F.col("_chunk")).contains("<!DOCTYPE")).alias("_typed"))
    along = Window.partitionBy("path").orderBy("_piece", "_block")
    offsets = pieces.select(
        "path", "_piece", "_block", F.coalesce(F.sum("_starts").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.max("_typed").over(Window.partitionBy("path")).alias("_declared")).filter("NOT _declared").drop("_declared")
    blocks = offsets.count()
    # Tasks sort a few blocks each, however many there are and whatever number of partitions the session has.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BLOCKS))
    local = Window.partitionBy("path", "_piece", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.repartition(tasks, "path", "_piece", "_block").select("*", F.sum(starts).over(local).alias("_local"))
    counted = counted.join(F.broadcast(offsets) if blocks <= BROADCAST_PIECES else offsets, ["path", "_piece", "_block"])
    numbered = counted.select("path", (F.col("_before") + F.col("_local") - 1).alias("pos"), "_piece", "_id", "_chunk").filter("pos >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_id", "_chunk"))), lambda x: x["_chunk"]), ">")
    joined = numbered.repartition(tasks, "path", "pos").groupBy("path", "pos").agg(newline_normalized(F.concat(text, F.lit(">"))).alias("xml"))
    return joined.select(F.sha2("path", 256).alias("artifact_id"), "path", "pos", "xml")
