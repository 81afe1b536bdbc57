"""Streams over the supplied tables, drained with ``availableNow``."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.q_classify import _LABELS, artifacts
from faultlens.catalog.q_sources import scratch
from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.streaming import logs as SL, state as SS, windows as SW


def stream(d: Data, table: str):
    """The table's file as a stream source."""
    schema = getattr(d, table).schema
    return d.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d.folder)


def view_stream(d: Data, view: str, table: str):
    return d.spark.sql(VIEWS[view], **{table: stream(d, table)})


def drain(d: Data, df, name: str, batch=None, mode: str = "append"):
    """Run to the end of the input; returns the output folder."""
    out = scratch(d, name)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", scratch(d, f"{name}-progress")).trigger(availableNow=True)
    run = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", out).start()
    run.awaitTermination()
    return out


def drained(d: Data, df, name: str, progress: str):
    """The stream's output as a table; its state stays in ``progress``."""
    out = scratch(d, name)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.schema(df.schema).parquet(out)


@query("W01_stream_classification", sql=f"WITH {_LABELS} SELECT stage, kind, count(*) AS logs FROM labelled GROUP BY 1, 2")
def classification(d: Data):
    folder = scratch(d, "incoming")
    artifacts(d).select("text").write.option("lineSep", "\x00").text(folder)
    # One file per partition holds several logs; each becomes one row again.
    files = d.spark.readStream.format("text").schema("value string").option("lineSep", "\x00").load(folder)
    rows = SL.classify_stream(files.select(F.col("value").alias("text")))
    out = drain(d, rows, "classified")
    return d.spark.read.parquet(out).groupBy("stage", "kind").agg(F.count(F.lit(1)).alias("logs"))


_KEY_STATE = """
SELECT artifact_id, line_no, line, last_value(CASE WHEN line LIKE '%END%' THEN 0 WHEN line LIKE '%BEGIN%' THEN 1 END IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM {v_key_line}"""


@query("W02_stream_key_blocks", sql=f"SELECT artifact_id, line_no, CASE WHEN line LIKE '%BEGIN%' THEN '[REDACTED:private_key]' ELSE line END AS line FROM ({_KEY_STATE}) WHERE coalesce(inside, 0) = 0")
def key_blocks(d: Data):
    rows = SL.key_block_stream(view_stream(d, "v_key_line", "events"), ["artifact_id"], "line_no")
    return drained(d, rows, "lines", scratch(d, "key-blocks")).select("artifact_id", "line_no", "line")


def _sightings(d: Data):
    return view_stream(d, "v_occurrence", "orders").withColumn("ts", F.col("ts").cast("timestamp"))


@query("W03_stream_recurrence", sql="""
SELECT artifact_id, dedup_key, CASE WHEN kind = 'unknown' THEN 1 ELSE n END AS occurrence_count
FROM (SELECT o.*, row_number() OVER (PARTITION BY dedup_key, kind = 'unknown' ORDER BY ts, artifact_id) AS n FROM {v_occurrence} o)""")
def recurrence(d: Data):
    rows = SS.recurrence_stream(_sightings(d), ["ts", "artifact_id"])
    return drained(d, rows, "occurrences", scratch(d, "recurrence")).select("artifact_id", "dedup_key", "occurrence_count")


@query("W05_stream_state_retention", sql="""
WITH s AS (SELECT dedup_key AS key, count(*) AS count, max(ts) AS last_seen FROM {v_occurrence} WHERE kind <> 'unknown' GROUP BY 1)
SELECT key, count FROM s WHERE last_seen >= (SELECT max(last_seen) FROM s) - INTERVAL 30 DAY""")
def retention(d: Data):
    progress = scratch(d, "retention")
    drained(d, SS.recurrence_stream(_sightings(d), ["ts", "artifact_id"], ttl_days=30, delay="0 seconds"), "occurrences", progress)
    return SS.incident_store(d.spark, progress).select("key", "count")


@query("W04_stream_history", sql="""
SELECT suite, test, run_id, attempt, ingest_seq FROM (SELECT *, row_number() OVER (PARTITION BY suite, test, run_id, attempt ORDER BY ingest_seq DESC) AS rn FROM {v_test_result}) WHERE rn = 1""")
def history(d: Data):
    path = scratch(d, "history")
    drain(d, view_stream(d, "v_test_result", "events"), "history", SS.history_batches(path))
    return d.spark.read.parquet(path).select("suite", "test", "run_id", "attempt", "ingest_seq")


@query("W04_stream_first_arrivals", sql="SELECT suite, test, run_id, attempt, count(*) > 0 AS kept FROM {v_test_result} GROUP BY 1, 2, 3, 4")
def first_arrivals(d: Data):
    rows = view_stream(d, "v_test_result", "events").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    out = drain(d, SS.first_arrivals(rows, delay="30 days").select("suite", "test", "run_id", "attempt"), "first")
    return d.spark.read.parquet(out).withColumn("kept", F.lit(True))


@query("W06_stream_pending_timeout", sql="""
WITH e AS (SELECT 'inc' || CAST(event_id AS STRING) AS incident_key, user_id % 3 AS way, ts FROM {events})
SELECT incident_key, CASE way WHEN 0 THEN 'confirmed' WHEN 1 THEN 'failed' ELSE 'unknown' END AS state FROM e
WHERE way < 2 OR ts + INTERVAL 300 SECOND <= (SELECT max(CASE WHEN way < 2 THEN ts + INTERVAL 60 SECOND ELSE ts END) FROM e)""")
def timeouts(d: Data):
    base = stream(d, "events").select(
        F.concat(F.lit("inc"), F.col("event_id").cast("string")).alias("incident_key"), F.lit("chat").alias("destination"),
        F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows = base.select("incident_key", "destination", F.inline(F.array(
        F.struct(F.col("ts").alias("at"), F.lit("reserve").alias("action")),
        F.struct((F.col("ts") + F.expr("interval 60 seconds")).alias("at"),
                 F.when(F.col("user_id") % 3 == 0, "confirm").when(F.col("user_id") % 3 == 1, "fail").otherwise("none").alias("action")))))
    out = drain(d, SS.pending_timeouts(rows.filter("action <> 'none'")), "timeouts")
    return d.spark.read.parquet(out).select("incident_key", "state")


@query("W07_stream_failure_windows", sql="""
SELECT epoch_us(w) AS window_us, kind, count(*) AS total, count(*) FILTER (WHERE failed) AS failures FROM (SELECT date_trunc('hour', ts) AS w, event_type AS kind, user_id % 3 = 0 AS failed, ts FROM {events})
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {events}) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def windows(d: Data):
    rows = stream(d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), (F.col("user_id") % 3 == 0).alias("failed"))
    out = drain(d, SW.failure_rates(rows), "windows")
    return d.spark.read.parquet(out).select(F.unix_micros("window_start").alias("window_us"), "kind", "total", "failures")


@query("W08_stream_bursts", sql="""
WITH e AS (SELECT event_type AS incident, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM {events} WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY incident ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT incident, epoch_us(min(ts)) AS burst_us, count(*) AS sightings FROM s GROUP BY incident, n HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM {events}) - INTERVAL 1 HOUR""")
def bursts(d: Data):
    rows = stream(d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("incident"))
    out = drain(d, SW.bursts(rows, "incident"), "bursts")
    return d.spark.read.parquet(out).select("incident", F.unix_micros("burst_start").alias("burst_us"), "sightings")
