"""Frames, failed tests, events, correlation ids and deployment context."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.functions.text import whole
from faultlens.operators import analysis as A, classify as C, extract as X


def _joined(d: Data, df, order: str, line: str):
    """Bounded groups: every artifact of these views has a fixed number of lines."""
    return d.gathered(df, "artifact_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda r: r[line]), "\n").alias("text"))


def runner_logs(d: Data):
    return _joined(d, d.v_runner_block, "event_id", "block")


def frame_logs(d: Data):
    return _joined(d, d.v_frame_line, "line_no", "line_text")


@query("C12_stack_frames", sql="SELECT artifact_id, line_no AS pos, file, line, function FROM {v_frame_line}")
def stack_frames(d: Data):
    return X.frame_table(frame_logs(d))


@query("C13_contained_frames", sql="""
SELECT event_id, CASE WHEN file LIKE '/src/%' THEN substr(file, 6) ELSE file END AS file, line
FROM {v_frame_line} WHERE event_id % 5 <> 0""")
def contained(d: Data):
    raw = d.v_frame_line.select(
        "event_id", "line", F.lit("/src/").alias("repo_root"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("../other/"), F.col("file")))
        .when((F.col("event_id") % 5 == 1) & ~F.col("file").startswith("/"), F.concat(F.lit("./a/../"), F.col("file")))
        .otherwise(F.col("file")).alias("file"),
    )
    return X.contain_paths(raw).select("event_id", "file", "line")


@query("C14_snippets", sql="""
SELECT f.artifact_id, f.pos, f.file, f.line,
       string_agg(CAST(s.line AS STRING) || ' | ' || s.text, chr(10) ORDER BY s.line) AS code
FROM {v_simple_frame} f LEFT JOIN {v_source_line} s ON s.file = f.file AND s.line BETWEEN f.line - 2 AND f.line + 2
GROUP BY 1, 2, 3, 4""")
def snippets(d: Data):
    return X.attach_snippets(d.v_simple_frame, d.v_source_line).select("artifact_id", "pos", "file", "line", "code")


def _runner_query(key: str, ks: tuple[int, ...], parse):
    listed = ", ".join(map(str, ks))

    @query(key, sql=f"""
SELECT artifact_id, {"'test_a' || CAST(event_id AS STRING)" if ks == (0,) else "name"} AS name,
       {"''" if ks == (0,) else "assertion"} AS assertion
FROM {{v_runner_block}} WHERE k IN ({listed})""" + ("""
UNION ALL SELECT artifact_id, name, assertion FROM {v_runner_block} WHERE k = 0""" if ks == (0,) else ""))
    def run(d: Data):
        logs = runner_logs(d)
        records = parse(F.col("text"), X.split_lines("text"))
        return logs.select("artifact_id", F.inline(records)).select("artifact_id", "name", "assertion")

    return run


_runner_query("C15a_pytest_failures", (0,), X.RUNNERS["pytest"])
_runner_query("C15b_jest_failures", (1, 6), X.RUNNERS["jest"])
_runner_query("C15c_go_failures", (2,), X.RUNNERS["go"])
_runner_query("C15d_rspec_failures", (3,), X.RUNNERS["rspec"])
_runner_query("C15e_cargo_failures", (4,), X.RUNNERS["cargo"])
_runner_query("C15f_dotnet_failures", (5,), X.RUNNERS["dotnet"])


@query("C16_failed_tests", sql="SELECT artifact_id, name, file, line, assertion FROM {v_runner_block}")
def failed_tests(d: Data):
    return X.failed_test_table(runner_logs(d)).select("artifact_id", "name", "file", "line", "assertion")


_FLAKY_LINES = """
SELECT event_id, CASE CAST(event_id % 4 AS INT)
    WHEN 0 THEN 'tests/a.py::t' || n || ' RERUN' || chr(10) || 'tests/a.py::t' || n || ' PASSED'
    WHEN 1 THEN 'tests/a.py::t' || n || ' PASSED' || chr(10) || 'tests/a.py::t' || n || ' RERUN'
    WHEN 2 THEN 'go test ./... -count=' || CAST(event_id % 3 + 1 AS STRING) || chr(10) || '--- FAIL: T' || n || ' (0.1s)' || chr(10) || '--- PASS: T' || n || ' (0.1s)'
    ELSE 'Tests: ' || n || CASE WHEN event_id % 8 = 3 THEN ' flaky, 2 passed' ELSE ' passed' END END AS text
FROM (SELECT event_id, CAST(event_id AS STRING) AS n FROM {events})"""


@query("C06_flaky_proof", sql="""
SELECT event_id, (event_id % 4 = 0) OR (event_id % 4 = 2 AND event_id % 3 >= 1) OR (event_id % 8 = 3) AS flaky FROM {events}""")
def flaky(d: Data):
    return d.sql(_FLAKY_LINES).select(
        "event_id", C.flaky_proof(F.col("text"), X.split_lines("text")).alias("flaky"))


@query("C04_stage_near_signal", sql="""
SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'deploy' WHEN 1 THEN 'ci' WHEN 2 THEN 'test' WHEN 3 THEN 'build' ELSE 'unknown' END AS stage
FROM {events}""")
def stage_near(d: Data):
    scope = (
        F.when(F.col("event_id") % 5 == 0, "helm list").when(F.col("event_id") % 5 == 1, "running job 7")
        .when(F.col("event_id") % 5 == 2, "pytest -q").when(F.col("event_id") % 5 == 3, "cargo build").otherwise("hello")
    )
    logs = d.events.select("event_id", F.concat(scope, F.lit("\nworker timeout after "), F.col("user_id")).alias("text"))
    hits = C.failure_signals(logs).select("event_id", F.explode(whole("signals")).alias("s"))
    return hits.filter(F.col("s.kind") == "timeout").select("event_id", "s.stage")


def event_logs(d: Data):
    classified = C.classify_artifacts(_joined(d, d.v_event_line, "line_no", "line"))
    return C.event_table(C.extract_events(classified))


_EVENTS = """
SELECT artifact_id, CAST(line_no + 1 AS INT) AS seq, line, sequence, timestamp, timestamp_ns,
       CASE WHEN line_no = 0 AND first_trace THEN trace_id ELSE trace_id END AS trace_id, span_id, parent_span_id
FROM (SELECT *, event_id % 4 = 2 AS first_trace FROM {v_event_line})"""


@query("C09_events", sql=f"""
SELECT artifact_id, seq, CASE WHEN seq = 1 THEN 'primary' ELSE 'downstream' END AS role, 'ci' AS stage,
       'ci_failure' AS kind, line AS message, 'ev-' || lpad(CAST(seq AS STRING), 3, '0') AS event_id,
       coalesce(sequence, seq) AS sequence FROM ({_EVENTS})""")
def events(d: Data):
    return event_logs(d).select("artifact_id", "seq", "role", "stage", "kind", "message", "event_id", "sequence")


@query("C10_trace_context", sql=f"""
SELECT e.artifact_id, e.seq, e.trace_id, e.span_id, e.parent_span_id
FROM ({_EVENTS}) e""")
def traces(d: Data):
    return event_logs(d).select("artifact_id", "seq", "trace_id", "span_id", "parent_span_id")


@query("C11_event_clock", sql=f"SELECT artifact_id, seq, timestamp, timestamp_ns FROM ({_EVENTS})")
def clocks(d: Data):
    return event_logs(d).select("artifact_id", "seq", "timestamp", "timestamp_ns")


@query("C17_entity_context", sql="""
WITH counted AS (
  SELECT artifact_id, 'request' AS field, method || ' ' || path AS v, count(*) AS n, min(line_no) AS pos FROM {v_entity_line} GROUP BY 1, 2, 3
  UNION ALL SELECT artifact_id, 'request_id', request_id, count(*), min(line_no) FROM {v_entity_line} GROUP BY 1, 2, 3
  UNION ALL SELECT artifact_id, 'user_id', user_id, count(*), min(line_no) FROM {v_entity_line} GROUP BY 1, 2, 3
), best AS (
  SELECT artifact_id, field, v, pos, row_number() OVER (PARTITION BY artifact_id, field ORDER BY n DESC, pos) AS rn,
         row_number() OVER (PARTITION BY artifact_id, field ORDER BY pos) AS seen FROM counted)
SELECT artifact_id, max(CASE WHEN field = 'request_id' AND rn = 1 THEN v END) AS request_id,
       max(CASE WHEN field = 'user_id' AND rn = 1 THEN v END) AS user_id,
       max(CASE WHEN field = 'request' AND rn = 1 THEN v END) AS request,
       string_agg(CASE WHEN field = 'user_id' THEN v END, ',' ORDER BY seen) AS users
FROM best GROUP BY 1""")
def entities(d: Data):
    rows = X.entity_context(_joined(d, d.v_entity_line, "line_no", "line"))
    return rows.select("artifact_id", "request_id", "user_id", F.concat_ws(" ", "method", "path").alias("request"),
                       F.array_join("users", ",").alias("users"))


_HINTS = "platform, namespace, target, release, revision, commit, outcome, recovery, strategy, workload, artifact, customer_impact"


@query("C18_deployment_hints", sql=f"SELECT artifact_id, {_HINTS} FROM {{v_deploy_log}}")
def hints(d: Data):
    found = d.v_deploy_log.select("artifact_id", X.deployment_hints("text").alias("h"))
    return found.select("artifact_id", *[f"h.{name}" for name in _HINTS.split(", ")])


@query("C19_merged_context", sql="""
SELECT artifact_id, CASE WHEN event_id % 8 = 0 THEN 'explicit' ELSE target END AS target, platform,
       CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE '' END AS environment FROM {v_deploy_log}""")
def merged(d: Data):
    explicit = d.v_deploy_log.select(
        "artifact_id", F.when(F.col("event_id") % 8 == 0, "explicit").otherwise("").alias("target"),
        F.when(F.col("event_id") % 2 == 0, "prod").otherwise("").alias("environment"))
    detected = d.v_deploy_log.select("artifact_id", X.deployment_hints("text").alias("h")).select(
        "artifact_id", "h.target", "h.platform")
    return X.merge_context(explicit, detected).select("artifact_id", "target", "platform", "environment")


@query("C20_customer_impact", sql="""
SELECT artifact_id, CASE WHEN event_id % 16 = 0 THEN 'none' WHEN event_id % 4 = 3 THEN 'outage' WHEN event_id % 4 = 1 THEN 'degraded'
  WHEN event_id % 3 = 0 THEN 'none' ELSE 'unknown' END AS impact FROM {v_deploy_log}""")
def impact(d: Data):
    explicit = F.when(F.col("event_id") % 16 == 0, "None ").otherwise("")
    recovery = F.when(F.col("event_id") % 3 == 0, "recovered").otherwise("")
    return d.v_deploy_log.select("artifact_id", X.customer_impact(explicit, F.col("text"), recovery).alias("impact"))


VIEWS["v_full_log"] = """
SELECT artifact_id, event_id, line_no, line_no * 4 + j AS n, CASE j
  WHEN 0 THEN 'job step' || CAST(event_id AS STRING) || ' failed by a' || CAST(event_id AS STRING) || '@ex.com request_id=req-' || CAST(event_id % 3 AS STRING)
  WHEN 1 THEN '  src/f' || CAST(event_id % 5 AS STRING) || '.py:' || CAST(line_no + 1 AS STRING) || ': in run'
  ELSE 'FAILED tests/test_x.py::test_a' || CAST(event_id AS STRING) || ' - assert 1 == 2' END AS line
FROM {v_event_line}, (VALUES (0), (1), (2)) AS t(j)"""


@query("C21_analyze_artifacts", sql="""
WITH a AS (SELECT artifact_id, min(event_id) AS head, count(DISTINCT event_id) AS m,
  string_agg(CASE WHEN j = 0 THEN replace(line, 'a' || CAST(event_id AS STRING) || '@ex.com', '[REDACTED:email]') END, '|' ORDER BY n) AS jobs,
  string_agg(CASE WHEN j = 1 THEN 'src/f' || CAST(event_id % 5 AS STRING) || '.py:' || CAST(line_no + 1 AS STRING) || ':run' END, '|' ORDER BY n) AS frames,
  string_agg(CASE WHEN j = 2 THEN 'tests/test_x.py::test_a' || CAST(event_id AS STRING) END, '|' ORDER BY n) AS tests,
  bool_or(event_id % 5 = 1) AS ones, count(*) FILTER (WHERE j = 0 AND event_id % 3 = 0) AS r0, count(*) FILTER (WHERE j = 0 AND event_id % 3 = 1) AS r1, count(*) FILTER (WHERE j = 0 AND event_id % 3 = 2) AS r2,
  min(event_id) % 3 AS first_r
 FROM (SELECT *, n % 4 AS j FROM {v_full_log}) GROUP BY 1)
SELECT artifact_id, m AS redaction_hits, 'ci' AS stage, 'ci_failure' AS kind, 'FAILED tests/test_x.py::test_a' || CAST(head AS STRING) || ' - assert 1 == 2' AS message,
 'FAILED tests/test_x.py::test_a' || CAST(head AS STRING) || ' - assert 1 == 2' AS summary, jobs, 1 + 2 * m AS n_events, frames, tests, 'high' AS severity, CASE WHEN ones THEN 'ones' ELSE 'src' END AS component,
 'The CI pipeline reported a failed job or step with a non-zero result.' AS hypothesis, 'Inspect' AS fix, 'medium' AS confidence, 0.75::DOUBLE AS completeness, 'failed' AS outcome,
 'req-' || CAST(CASE WHEN r0 >= r1 AND r0 >= r2 AND (r0 > r1 OR first_r <> 1) AND (r0 > r2 OR first_r <> 2) THEN 0
   WHEN r1 >= r0 AND r1 >= r2 AND (r1 > r2 OR first_r <> 2) THEN 1 ELSE 2 END AS STRING) AS request_id FROM a""")
def analyze(d: Data):
    rows = A.analyze_artifacts(_joined(d, d.v_full_log, "n", "line"), component_rules=[("src/f1*", "ones")])
    texts = lambda column, fn: F.array_join(F.transform(column, fn), "|")
    jobs = F.filter("events", lambda e: e["message"].startswith("job "))
    return rows.select(
        "artifact_id", F.col("redaction_hits").cast("bigint").alias("redaction_hits"), "stage", "kind", "message", "summary",
        texts(jobs, lambda e: e["message"]).alias("jobs"), F.size("events").cast("bigint").alias("n_events"),
        texts("frames", lambda f: F.concat_ws(":", f["file"], f["line"].cast("string"), f["function"])).alias("frames"),
        texts("failed_tests", lambda t: t["name"]).alias("tests"), "severity", "component", "hypothesis", F.substring_index("fix", " ", 1).alias("fix"),
        "confidence", F.col("completeness.score").alias("completeness"), F.col("deployment.outcome").alias("outcome"), F.col("context.request_id").alias("request_id"))
