"""Stored tables: history, incidents, documents, batch summaries and sanitized corpora."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.functions.redaction import hit_total, redact_counted
from faultlens.functions.text import newline_normalized, strip
from faultlens.operators.history import RESULT_KEY
from faultlens.plans.upsert import latest_per_key, merge_latest

# Fixed value: words that mark an evidence line of a corpus chunk.
EVIDENCE_LINE = (
    r"(?i)error|fail|exception|traceback|timeout|panic|denied|forbidden|unauthori[sz]ed|segmentation|oom|certificate|"
    r"dependency|assert"
)


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nested report documents, one row per artifact."""
    docs.write.mode("overwrite").format(fmt).save(path)


def document_rows(df: DataFrame, generated_at: Column) -> DataFrame:
    """Nested document per artifact from analysis columns; absent parts are left out."""
    have = lambda *names: [F.col(n) for n in names if n in df.columns]
    sections = {
        "failure": have("stage", "kind", "summary", "message", "frames", "failed_tests", "events"),
        "root_cause": have("hypothesis", "confidence", "fix_suggestion"),
        "triage": have("severity", "priority", "component", "dedup_key", "is_duplicate_of"),
    }
    return df.select(
        "artifact_id", F.lit("2.0").alias("schema_version"),
        F.struct(F.lit("fallback").alias("engine"), generated_at.alias("generated_at"), *have("path")).alias("meta"),
        *[F.struct(*columns).alias(name) for name, columns in sections.items() if columns],
        *have("evidence", "facts"))


HISTORY_BUCKETS = 64


def upsert_history(spark: SparkSession, updates: DataFrame, path: str, order: Sequence[str] = ("ingest_seq",), buckets: int = HISTORY_BUCKETS) -> None:
    """Merge results into a history table partitioned by a hash of the result key; only the buckets of the update are read and rewritten.

    A result stays in its bucket whatever day it was recorded on. ``buckets`` is fixed when the table is first written. One
    writer at a time. The merged rows are materialized before the partitions they came from are replaced.
    """
    from faultlens.plans.lineage import cut_lineage
    from faultlens.plans.folders import path_exists

    bucket = F.pmod(F.xxhash64(*RESULT_KEY), F.lit(buckets)).cast("int")
    new = latest_per_key(updates.withColumn("bucket", bucket), RESULT_KEY, order)
    if path_exists(spark, path):
        new = cut_lineage(new)
        touched = [row.bucket for row in new.select("bucket").distinct().collect()]
        stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        new = cut_lineage(merge_latest(stored, new.select(*stored.columns), RESULT_KEY, order))
    new.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


EXPORT_VERSION = "1.0"
EXPORT_RECORDS = 10_000  # of one manifest


def export_history(results: DataFrame, path: str, schema_version: int = 1) -> None:
    """History as manifests that the history import reads back: JSON documents of bounded size, one a line.

    Records are ordered by time, suite and test within and over the manifests; ``part`` numbers them.
    """
    order = [c for c in ("recorded_at", "suite", "test", "run_id", "attempt", "evidence_id") if c in results.columns]
    parts = max(1, -(-results.count() // EXPORT_RECORDS))
    ranged = results.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    # A task puts together the few manifests it gets, not all that a session's number of partitions would give it.
    records = ranged.repartition(parts, "part").groupBy("part").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*results.columns).alias("r")))).alias("rows"))
    manifests = records.select(
        F.lit(EXPORT_VERSION).alias("export_version"), F.lit(schema_version).alias("schema_version"), F.col("part"),
        F.size("rows").alias("count"), F.transform("rows", lambda x: x["r"]).alias("records"))
    manifests.write.mode("overwrite").json(path)


TEXT_FOLDERS = 1024  # a folder is listed by one task


def write_texts(rows: DataFrame, folder: str, name: str, text: str = "text") -> int:
    """Each row's text as a UTF-8 file named by ``name`` (unique), in subfolders by a hash of the name; returns their number.

    Tasks write the files themselves, as a table writer takes a folder, its commit and several processes for every file. A file is
    renamed when it is whole, so a repeated task leaves the same files. A null text is an empty file.
    """
    def write(batches):
        system, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            for part, file, body in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if part not in made:
                    system.create_dir(f"{root}/{part}", recursive=True)
                    made.add(part)
                attempt = f"{root}/{part}/_{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write((body or "").encode())
                system.move(attempt, f"{root}/{part}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    part = F.pmod(F.xxhash64(name), F.lit(TEXT_FOLDERS)).cast("int").alias("part")
    written = rows.select(part, name, text).repartition(TEXT_FOLDERS // 8, "part").mapInArrow(write, "files bigint")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def batch_summary(df: DataFrame) -> DataFrame:
    """One summary row per analysed artifact."""
    wanted = ("artifact_id", "stage", "kind", "severity", "component", "dedup_key", "is_duplicate_of", "reused", "title")
    flaky = (F.col("kind") == "flaky").alias("flaky_suspect")
    return df.select(*[c for c in wanted if c in df.columns], flaky)


def usage_rollup(df: DataFrame) -> DataFrame:
    """Calls, tokens and reused runs of a batch in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("reused").alias("reused_runs"), F.count_if("skipped").alias("skipped_runs"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def evidence_spans(text: Column) -> Column:
    """Evidence lines as character spans; the whole text when there is none."""
    span = lambda start, end, label: F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(label).alias("label"), F.lit(False).alias("verified"))
    # Lines keep their terminator so that offsets add up.
    pieces = F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")
    start = F.struct(F.lit(0).alias("offset"), F.array().cast("array<struct<start:int,end:int,label:string,verified:boolean>>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        content = F.regexp_replace(line, r"[\r\n]+$", "")
        hit = content.rlike(EVIDENCE_LINE) & (strip(content) != "")
        found = span(state["offset"], state["offset"] + F.length(content), "observed_failure_signal")
        return F.struct(
            (state["offset"] + F.length(line)).alias("offset"),
            F.when(hit, F.array_append(state["out"], found)).otherwise(state["out"]).alias("out"))

    spans = F.aggregate(pieces, start, step, lambda state: state["out"])
    whole = F.array(span(F.lit(0), F.greatest(F.lit(1), F.length(text)), "observed_log_chunk"))
    return F.when(F.size(spans) > 0, spans).otherwise(whole)


def sanitized_corpus(chunks: DataFrame, order: Sequence[str], text: str = "chunk") -> DataFrame:
    """Chunks once per raw digest, redacted, without residual secrets or empty results, with spans and digests."""
    hashed = chunks.withColumn("raw_sha256", F.sha2(text, 256))
    row = F.struct(*[F.col(c) for c in hashed.columns if c != "raw_sha256"])
    unique = hashed.groupBy("raw_sha256").agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_r")).select("raw_sha256", "_r.*")
    counted = unique.withColumn("_c", redact_counted(newline_normalized(text)))
    clean = counted.withColumn("text", F.col("_c.text")).withColumn("redaction_hits", hit_total(F.col("_c"))).drop("_c", text)
    safe = clean.filter((strip("text") != "") & (hit_total(redact_counted("text")) == 0))
    return safe.withColumn("sanitized_sha256", F.sha2("text", 256)).withColumn("evidence_spans", evidence_spans(F.col("text")))
