"""File-shaped sources and stored tables. Queries that write use a fresh folder beside the checkpoints."""
from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from faultlens.catalog.q_classify import artifacts
from faultlens.catalog.q_extract import runner_logs
from faultlens.catalog.q_quality import JUNIT_ROWS, json_documents, junit_documents
from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.functions.text import newline_normalized
from faultlens.operators import classify as C, history as H, longlogs as LL, triage as T
from faultlens.plans.lineage import ensure_checkpoint_dir
from faultlens.sinks import tables as K
from faultlens.sources import artifacts as A, observability as OB, reports as R


def scratch(d: Data, name: str) -> str:
    return f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/faultlens-{name}-{uuid.uuid4().hex}"


VIEWS["v_file"] = """
SELECT event_id, '/r/' || CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'junit/' ELSE 'src/' END || 'f' || CAST(floor(event_id / 2) AS BIGINT) || CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '.log' WHEN 1 THEN '.json' WHEN 2 THEN '.XML' ELSE '.txt' END AS path FROM {events}"""


@query("S01_artifact_discovery", sql="""
SELECT f.path FROM {v_file} f WHERE event_id % 5 <> 0 AND event_id % 4 <> 3 AND (event_id % 4 = 0 OR (event_id % 4 = 1 AND event_id % 5 = 1) OR (event_id % 4 = 2 AND event_id % 5 = 1))
 AND NOT (event_id % 4 = 1 AND EXISTS (SELECT 1 FROM {v_file} g WHERE g.event_id % 5 <> 0 AND g.path = replace(f.path, '.json', '.log')))""")
def discovery(d: Data):
    return A.supported(d.v_file.select("path"), "/r").select("path")


@query("S03_sidecars", sql="SELECT path FROM {v_file} f WHERE NOT (path LIKE '%.json' AND EXISTS (SELECT 1 FROM {v_file} g WHERE g.path = replace(f.path, '.json', '.log')))")
def sidecars(d: Data):
    return A.without_sidecars(d.v_file.select("path")).select("path")


@query("S02_file_listing", sql="SELECT path, row_number() OVER (ORDER BY lower(string_split(path, '/')[-1]), path) - 1 AS pos FROM {v_file}")
def listing(d: Data):
    return A.numbered_listing(d.v_file.select("path")).select("path", "pos")


@query("S04_read_logs", sql="SELECT doc_id, md5(text) AS digest FROM {documents}")
def read_logs(d: Data):
    """Documents written as files with Windows line ends and read back as artifacts."""
    folder = scratch(d, "logs")
    n = F.col("doc_id").cast("string")
    rows = d.documents.select(F.concat(n, F.lit(".txt")).alias("name"), F.concat(F.lit("id:"), n, F.lit("\r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("text"))
    K.write_texts(rows, folder, "name")
    return A.read_artifacts(d.spark, folder, suffixes=(".txt",)).select(
        F.regexp_extract("text", r"^id:(\d+)\n", 1).cast("bigint").alias("doc_id"), F.md5(F.regexp_replace("text", r"^id:\d+\n", "")).alias("digest"))


VIEWS["v_long_line"] = """
SELECT event_type AS log, event_id, CASE WHEN event_type <> 'view' AND event_id % 97 = 5 THEN 'Error at ' ELSE 'line ' END || CAST(event_id AS STRING) AS line FROM {events}"""


def _long_logs(d: Data):
    """One log file for each kind of event, read back as numbered lines."""
    folder = scratch(d, "long-logs")
    d.v_long_line.repartition("log").sortWithinPartitions("log", "event_id").select("log", "line").write.partitionBy("log").text(folder)
    return A.read_log_lines(d.spark, folder, "*.txt").withColumn("log", F.regexp_extract("path", "log=([^/]+)/", 1))


@query("S04_split_logs", sql="SELECT log, row_number() OVER (PARTITION BY log ORDER BY event_id) - 1 AS line_no, line FROM {v_long_line}")
def split_logs(d: Data):
    return _long_logs(d).select("log", "line_no", "line")


@query("S04_split_log_messages", sql="""
SELECT log, count(*) AS lines, count(*) FILTER (WHERE line LIKE 'Error%') AS error_lines, coalesce(arg_min(line, event_id) FILTER (WHERE line LIKE 'Error%'), arg_max(line, event_id)) AS message FROM {v_long_line} GROUP BY 1""")
def split_log_messages(d: Data):
    return LL.messages(_long_logs(d), key="log")


REPORT_CASES = 500_000  # for which each suite gets one more report file


@query("S05_split_reports", sql=f"""
SELECT suite, test, status, attempt, CAST(floor(CAST(secs AS DOUBLE) * 1000) AS INT) AS duration_ms, CASE WHEN message = '' THEN '' ELSE sha256(message) END AS failure_signature FROM ({JUNIT_ROWS})""")
def split_reports(d: Data):
    """Each suite's cases in report files of bounded size (an artifact's cases of a suite in one), read back in pieces."""
    folder = scratch(d, "reports")
    files = max(1, -(-d.events.count() // REPORT_CASES))
    part = F.pmod(F.xxhash64("artifact_id"), F.lit(files)).cast("int").alias("part")
    rows = d.v_junit_piece.select(F.regexp_extract("piece", r'classname="suite\.S(\d+)"', 1).alias("suite"), part, "artifact_id", F.col("pos").cast("int").alias("pos"), "piece")
    ends = rows.select("suite", "part").distinct().select("suite", "part", F.inline(F.array(
        F.struct(F.lit("").alias("artifact_id"), F.lit(-1).alias("pos"), F.lit('<?xml version="1.0"?><testsuites><testsuite name="a>b">').alias("piece")),
        F.struct(F.lit("~").alias("artifact_id"), F.lit(-1).alias("pos"), F.lit("</testsuite></testsuites>").alias("piece")))))
    dealt = rows.unionByName(ends).repartition(max(files, int(d.spark.conf.get("spark.sql.shuffle.partitions"))), "suite", "part")
    dealt.sortWithinPartitions("suite", "part", "artifact_id", "pos").select("suite", "part", "piece").write.partitionBy("suite", "part").text(folder)
    return R.results_of(R.read_junit_cases(d.spark, folder, "*.txt"), "path").select("suite", "test", "status", "attempt", "duration_ms", "failure_signature")


VIEWS["v_mixed_file"] = """
SELECT event_id AS artifact_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '.log' WHEN 1 THEN '.xml' WHEN 2 THEN '.json' ELSE '.sarif' END AS ext, event_id % 3 = 0 AS failing FROM {events}"""


@query("S01_parseable", sql="SELECT artifact_id, ext FROM {v_mixed_file} WHERE ext = '.log' OR failing")
def parseable(d: Data):
    n = F.col("artifact_id").cast("string")
    case = F.concat(F.lit('<testsuite name="s"><testcase name="t'), n, F.when(F.col("failing"), F.lit('"><failure message="m">x</failure></testcase></testsuite>')).otherwise(F.lit('"/></testsuite>')))
    node = F.concat(F.lit('{"tests":[{"nodeid":"t'), n, F.lit('","outcome":"'), F.when(F.col("failing"), "failed").otherwise("passed"), F.lit('"}]}'))
    scan = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"x"}},"results":['), F.when(F.col("failing"), F.concat(
        F.lit('{"ruleId":"r","level":"error","message":{"text":"m'), n, F.lit('"}}'))).otherwise(F.lit("")), F.lit("]}]}"))
    text = F.when(F.col("ext") == ".log", "plain").when(F.col("ext") == ".xml", case).when(F.col("ext") == ".json", node).otherwise(scan)
    return A.parseable(d.v_mixed_file.withColumn("text", text)).select("artifact_id", "ext")


@query("S22_sidecar_context", sql="""
SELECT event_id, 'ci' AS provider, CASE WHEN event_id % 2 = 0 THEN 'bx' ELSE 'main' END AS branch, CASE WHEN event_id % 3 = 0 THEN 2 END AS attempt, CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE '' END AS environment FROM {events}""")
def sidecar_context(d: Data):
    attempt = F.when(F.col("event_id") % 3 == 0, "2").otherwise("0")
    nested = F.concat(F.lit('{"run":{"provider":"ci","branch":"bx","attempt":'), attempt, F.lit('},"deployment":{"environment":"prod"}}'))
    flat = F.concat(F.lit('{"provider":"ci","attempt":'), attempt, F.lit(',"git":{"branch":"main"}}'))
    docs = d.events.select("event_id", F.when(F.col("event_id") % 2 == 0, nested).otherwise(flat).alias("text"))
    run = A.run_context(docs, "event_id").select("event_id", "provider", "branch", "attempt")
    return run.join(A.deployment_context(docs, "event_id").select("event_id", "environment"), "event_id")


@query("S22_deployment_fields", sql="SELECT event_id, name, name || '-' || CAST(event_id % 11 AS STRING) AS value FROM {events}, (VALUES " + ", ".join(f"('{name}')" for name in A.DEPLOYMENT_FIELDS) + ") AS t(name)")
def deployment_fields(d: Data):
    pairs = [F.concat(F.lit(f'"{name}":"{name}-'), (F.col("event_id") % 11).cast("string"), F.lit('"')) for name in A.DEPLOYMENT_FIELDS]
    docs = d.events.select("event_id", F.concat(F.lit('{"deployment":{'), F.concat_ws(",", *pairs), F.lit("}}")).alias("text"))
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in A.DEPLOYMENT_FIELDS])
    return A.deployment_context(docs, "event_id").select("event_id", F.inline(rows))


@query("S23_prometheus_samples", sql="SELECT event_id AS artifact_id, 'm' || CAST(user_id % 3 AS STRING) AS metric, (1700000000 + event_id) * 1000000 AS ts_us, CAST(user_id AS DOUBLE) AS value FROM {events} WHERE event_id % 7 <> 0")
def prometheus(d: Data):
    text = F.concat(
        F.lit('{"status":"success","data":{"result":[{"metric":{"__name__":"m'), (F.col("user_id") % 3).cast("string"), F.lit('"},"values":[['),
        (F.lit(1700000000) + F.col("event_id")).cast("string"), F.lit(',"'), F.when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("user_id").cast("string")), F.lit('"],[1]]}]}}'))
    return OB.prometheus_samples(d.events.select(F.col("event_id").alias("artifact_id"), text.alias("text")))


@query("S24_trace_spans", sql="""
SELECT trace_id AS artifact_id, CAST(span_id AS STRING) AS span_id, coalesce(CAST(parent_span_id AS STRING), '') AS parent_span_id, 'svc' AS service, '1.2' AS version, start_ns, end_ns, CASE WHEN span_id % 2 = 0 THEN 'OK' ELSE 'ERROR' END AS status FROM {v_span}""")
def trace_spans(d: Data):
    s = lambda c: F.col(c).cast("string")
    status = F.when(F.col("span_id") % 2 == 0, '{"code":1}').otherwise('{"code":"STATUS_CODE_ERROR"}')
    piece = F.concat(F.lit('{"traceId":"t","spanId":"'), s("span_id"), F.lit('","parentSpanId":"'), F.coalesce(s("parent_span_id"), F.lit("")),
                     F.lit('","startTimeUnixNano":"'), s("start_ns"), F.lit('","endTimeUnixNano":'), s("end_ns"), F.lit(',"status":'), status, F.lit("}"))
    body = d.gathered(d.v_span.select("trace_id", "span_id", piece.alias("piece")), "trace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "piece"))), lambda r: r["piece"]), ",").alias("b"))
    docs = body.select(F.col("trace_id").alias("artifact_id"), F.concat(
        F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc"}},{"key":"service.version","value":{"doubleValue":1.2}}]},"scopeSpans":[{"spans":['),
        "b", F.lit("]}]}]}")).alias("text"))
    return OB.trace_spans(docs).select("artifact_id", "span_id", "parent_span_id", "service", "version", "start_ns", "end_ns", "status")


@query("S25_evaluation_cases", sql="SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN 'case' || CAST(event_id AS STRING) END AS id, event_id % 6 NOT IN (0, 1) AS valid FROM {events}")
def cases(d: Data):
    n = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"eval_case_version":"'), F.when(F.col("event_id") % 6 == 1, "9").otherwise("1.0"), F.lit('","id":"case'), n,
                    F.lit('","artifact":"a.log","expected":{"stage":"test","kind":"timeout","failed_tests":["t"],"severity_range":["high"],"redactions":[]}}'))
    docs = d.events.select("event_id", F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(good).alias("text"))
    return A.evaluation_cases(docs).select("event_id", "id", "valid")


def _manifests(d: Data, element, name: str, prefix: str, suffix: str):
    rows = d.events.select((F.col("event_id") % 40).alias("m"), "event_id", F.floor(F.col("event_id") / 400).alias("part"), element.alias("piece"))
    body = d.gathered(rows.withColumn("doc", F.concat_ws("-", "m", "part")), "doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "piece"))), lambda r: r["piece"]), ",").alias("b"))
    return body.select("doc", F.concat(F.lit(prefix), "b", F.lit(suffix)).alias("text"))


@query("S26_corpus_manifest", sql="SELECT 'c' || CAST(event_id AS STRING) AS case_id, 'src' || CAST(user_id % 3 AS STRING) AS source_id, 1 AS spans FROM {events}")
def manifest(d: Data):
    piece = F.concat(F.lit('{"case_id":"c'), F.col("event_id").cast("string"), F.lit('","path":"artifacts/x.log","source_id":"src'), (F.col("user_id") % 3).cast("string"),
                     F.lit('","license":"MIT","evidence_spans":[{"start":0,"end":4,"label":"x","verified":false}]}'))
    docs = _manifests(d, piece, "corpus", '{"manifest_version":"1.0","corpus_id":"c","sources":[],"artifacts":[', "]}")
    return A.manifest_artifacts(docs).select("case_id", "source_id", F.size("evidence_spans").alias("spans"))


@query("S26_manifest_sources", sql="SELECT 'src' || CAST(event_id AS STRING) AS source_id, 'MIT' AS license, 'https://x/' || CAST(user_id % 3 AS STRING) AS metadata_url FROM {events}")
def manifest_sources(d: Data):
    piece = F.concat(F.lit('{"id":"src'), F.col("event_id").cast("string"), F.lit('","license":"MIT","metadata_url":"https://x/'), (F.col("user_id") % 3).cast("string"), F.lit('"}'))
    docs = _manifests(d, piece, "sources", '{"manifest_version":"1.0","corpus_id":"c","artifacts":[],"sources":[', "]}")
    return A.manifest_sources(docs).select("source_id", "license", "metadata_url")


@query("S27_annotated_chunks", sql="SELECT 'chunk <' || CAST(event_id AS STRING) || '>' AS chunk, 'cat' || CAST(user_id % 4 AS STRING) AS category FROM {events} WHERE event_id % 9 <> 0")
def chunks(d: Data):
    piece = F.concat(F.lit("<Example><Chunk>"), F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.concat(F.lit("chunk &lt;"), F.col("event_id").cast("string"), F.lit("&gt;"))),
                     F.lit("</Chunk><Category>cat"), (F.col("user_id") % 4).cast("string"), F.lit("</Category><Keywords>k</Keywords></Example>"))
    docs = _manifests(d, piece, "xml", "<Examples>", "</Examples>").withColumnRenamed("doc", "path")
    return A.annotated_chunks(docs).select("chunk", "category")


@query("S28_mixed_import", sql="""
SELECT artifact_id, count(*) + count(*) FILTER (WHERE k IN (1, 3)) AS n FROM {v_case} GROUP BY 1
UNION ALL SELECT 'j-' || artifact_id, count(*) FROM {v_case} GROUP BY 1
UNION ALL SELECT 'l-' || artifact_id, count(*) FROM {v_runner_block} GROUP BY 1""")
def mixed(d: Data):
    tagged = lambda df, prefix, ext: df.select(F.concat(F.lit(prefix), "artifact_id").alias("artifact_id"), F.lit(ext).alias("ext"), "text")
    docs = tagged(junit_documents(d), "", ".xml").unionByName(tagged(json_documents(d), "j-", ".json")).unionByName(tagged(runner_logs(d), "l-", ".log"))
    return R.import_results(docs).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))


@query("S28_detect_runner", sql="SELECT event_id, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'junit' WHEN 1 THEN 'pytest' WHEN 2 THEN 'vitest' WHEN 3 THEN 'go' WHEN 4 THEN 'cargo' WHEN 5 THEN 'dotnet' ELSE 'unknown' END AS runner FROM {events}")
def runner(d: Data):
    k = F.col("event_id") % 7
    texts = ["x", "=== Short Test Summary Info", "vitest run", "--- FAIL: T", "thread panicked at x\nfailures:", "Failed A in A.cs", "hello"]
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (k + 1).cast("int"))
    return d.events.select("event_id", R.detect_runner(text, F.when(k == 0, ".xml").otherwise(".log")).alias("runner"))


@query("S29_stored_reports", sql="SELECT event_id, 'timeout' AS kind FROM {events} WHERE event_id % 8 <> 0")
def stored(d: Data):
    good = F.concat(F.lit('{"schema_version":"2.0","meta":{"generated_at":"2024-01-01T00:00:'), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit('Z"},"failure":{"kind":"timeout"}}'))
    docs = d.events.select("event_id", F.when(F.col("event_id") % 8 == 0, "[1,").otherwise(good).alias("text"))
    return A.stored_reports(docs).select("event_id", "failure.kind")


@query("S30_history_import", sql="SELECT 's' || CAST(user_id % 5 AS STRING) AS suite, 't' || CAST(event_id AS STRING) AS test, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 12 END AS duration_ms, 'jest' AS runner FROM {events}")
def history_import(d: Data):
    piece = F.concat(F.lit('{"suite":"s'), (F.col("user_id") % 5).cast("string"), F.lit('","test":"pkg.t'), F.col("event_id").cast("string"),
                     F.lit('","status":"passed","attempt":0,"duration_ms":'), F.when(F.col("event_id") % 4 == 0, "-3").otherwise("12"), F.lit(',"runner":"JestJS","run_id":"r"}'))
    docs = _manifests(d, piece, "history", '{"export_version":"1.0","schema_version":1,"count":1,"records":[', "]}")
    return H.normalize_results(A.history_manifest(docs)).select("suite", "test", "duration_ms", "runner")


# ------------------------------------------------------------------ sinks

@query("K01_documents", sql="SELECT count(*) AS documents, count(*) AS readable FROM (SELECT DISTINCT artifact_id FROM {v_log_line})")
def documents(d: Data):
    rows = C.classify_artifacts(artifacts(d)).withColumn("hypothesis", T.hypothesis_of(F.col("kind")))
    path = scratch(d, "documents")
    K.write_documents(K.document_rows(rows, F.lit("2024-01-01T00:00:00Z")), path)
    stored = d.spark.read.parquet(path)
    return stored.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("root_cause.hypothesis").isNotNull() & F.col("failure.kind").isNotNull()).alias("readable"))


@query("K02_history_table", sql="""
SELECT suite, test, run_id, attempt, status, ingest_seq FROM (SELECT *, row_number() OVER (PARTITION BY suite, test, run_id, attempt ORDER BY ingest_seq DESC) AS rn FROM {v_test_result}) WHERE rn = 1""")
def history_table(d: Data):
    path = scratch(d, "history")
    rows = d.v_test_result
    K.upsert_history(d.spark, rows.filter("ingest_seq % 3 <> 1"), path)
    K.upsert_history(d.spark, rows.filter("ingest_seq % 3 = 1"), path)
    return d.spark.read.parquet(path).select("suite", "test", "run_id", "attempt", "status", "ingest_seq")


@query("K03_history_export", sql="""
SELECT suite, test, run_id, attempt, status, evidence_id, row_number() OVER (ORDER BY recorded_at, suite, test, run_id, attempt, evidence_id) AS position
FROM (SELECT *, CAST(ingest_seq AS STRING) AS evidence_id FROM {v_test_result})""")
def export(d: Data):
    """The export read back by the import, with each record's position over all manifests."""
    path = scratch(d, "export")
    K.export_history(d.v_test_result.withColumn("evidence_id", F.col("ingest_seq").cast("string")), path)
    docs = d.spark.read.text(path).withColumnRenamed("value", "text")
    parts = docs.select("text", F.get_json_object("text", "$.part").cast("int").alias("part"), F.get_json_object("text", "$.count").cast("bigint").alias("count"))
    # Two numbers a manifest go through one task; the records stay where they are.
    before = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", "count").select("part", before.alias("before"))
    placed = parts.select("text", "part").join(F.broadcast(starts), "part").select(
        F.posexplode(F.from_json("text", f"records array<{A.HISTORY_RECORD}>")["records"]).alias("pos", "r"), "before")
    positions = placed.select(F.col("r.evidence_id").alias("evidence_id"), (F.col("before") + F.col("pos") + 1).alias("position"))
    return A.history_manifest(docs).select("suite", "test", "run_id", "attempt", "status", "evidence_id").join(positions, "evidence_id")


@query("K05_batch_summary", sql="SELECT count(*) AS runs, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS reused_runs, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS skipped_runs, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM {v_usage} JOIN {orders} ON ord = o_orderkey")
def usage(d: Data):
    return K.usage_rollup(d.v_usage.withColumn("reused", F.col("ord") % 4 == 0).withColumn("skipped", F.col("ord") % 5 == 0))


@query("K05_summary_rows", sql="SELECT kind, count(*) AS n FROM {v_kind} WHERE kind = 'flaky' GROUP BY 1")
def summary_rows(d: Data):
    rows = K.batch_summary(d.v_kind.withColumn("artifact_id", F.col("event_id")))
    return rows.filter("flaky_suspect").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("K08_sanitized_corpus", sql="""
WITH c AS (SELECT CAST(user_id AS STRING) AS u, min(event_id) AS first_id FROM {events} WHERE user_id % 10 <> 3 GROUP BY 1)
SELECT first_id, 'ok' || chr(10) || 'error: mail [REDACTED:email]' || chr(10) || 'u' || u AS text, 1 AS hits, 3 AS start, 31 AS "end" FROM c""")
def corpus(d: Data):
    u = F.col("user_id").cast("string")
    text = F.when(F.col("user_id") % 10 == 3, F.lit(" \r\n ")).otherwise(F.concat(F.lit("ok\r\nerror: mail a@ex.com\r\nu"), u))
    rows = K.sanitized_corpus(d.events.select("event_id", text.alias("chunk")), ["event_id"])
    return rows.select(F.col("event_id").alias("first_id"), "text", F.col("redaction_hits").alias("hits"), F.col("evidence_spans")[0]["start"].alias("start"), F.col("evidence_spans")[0]["end"].alias("end"))
