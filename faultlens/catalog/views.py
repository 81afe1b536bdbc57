"""Derived input views over the supplied tables; the same text runs in Spark and in the checking engine."""
from __future__ import annotations

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# One log line per template, with the stage and kind of that single line.
LINE_TEMPLATES = (
    (0, "step finished in 3s", "unknown", "unknown"),
    (1, "ModuleNotFoundError: No module named ''yaml''", "build", "import_error"),
    (2, "main.c:10:5: error: undefined reference to foo", "build", "compilation_error"),
    (3, "FAILED tests/test_cart.py::test_total - assert 1 == 2", "test", "test_failure"),
    (4, "write error: No space left on device", "build", "disk_full"),
    (5, "curl: (60) SSL certificate problem: certificate has expired", "build", "tls_certificate_error"),
    (6, "pod/api-1 CrashLoopBackOff", "deploy", "crash_loop"),
    (7, "Back-off pulling image \"api:1\" ErrImagePull", "deploy", "image_pull_error"),
    (8, "container api OOMKilled exit code 137", "deploy", "oom_killed"),
    (9, "job lint failed", "ci", "ci_failure"),
    (10, "HTTP 429 Too Many Requests from proxy", "unknown", "api_rate_limited"),
    (11, "deadline exceeded while calling peer", "unknown", "timeout"),
    (12, "npm ERR! ERESOLVE unable to resolve dependency tree", "build", "dependency_resolution"),
    (13, "level=info msg=\"cart ok\" request_id=req_1 user_id=u_1 method=POST path=/api/x", "unknown", "unknown"),
)

_TEMPLATE_ROWS = ",\n".join(f"({t}, '{line}', '{stage}', '{kind}')" for t, line, stage, kind in LINE_TEMPLATES)

VIEWS = {
    "v_test_result": """
SELECT 'tests/s' || CAST(user_id % 5 AS STRING) || '.py' AS suite,
       't' || CAST(event_id % 12 AS STRING) AS test,
       CASE WHEN event_id % 12 = 3 THEN 'passed' WHEN event_id % 12 = 5 THEN 'failed'
            WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'skipped' ELSE 'passed' END AS status,
       CAST(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS INT) AS attempt,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 10) AS INT) END AS duration_ms,
       CASE WHEN event_id % 2 = 0 THEN 'pytest' ELSE 'junit' END AS runner,
       CASE WHEN event_id % 3 = 0 THEN 'os=linux' WHEN event_id % 3 = 1 THEN 'os=windows' ELSE 'os=mac' END AS environment,
       'c' || CAST(CAST(floor(event_id / 100) AS BIGINT) AS STRING) AS commit_sha,
       'run-' || CAST(CAST(floor(event_id / 60) AS BIGINT) AS STRING) AS run_id,
       event_id AS ingest_seq, ts AS recorded_at
FROM {events}""",
    "v_template": f"""
SELECT * FROM (VALUES
{_TEMPLATE_ROWS}
) AS t(tpl, line, stage, kind)""",
    "v_log_line": """
SELECT 'a' || CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING) AS artifact_id,
       CAST(event_id % 8 AS INT) AS line_no,
       CAST((event_id * 7 + user_id) % 14 AS INT) AS tpl,
       event_id, user_id, ts
FROM {events}""",
    "v_line": """
SELECT l.artifact_id, l.line_no, l.tpl, t.line, t.stage, t.kind, l.ts
FROM {v_log_line} l JOIN {v_template} t ON l.tpl = t.tpl""",
    "v_coverage_line": """
SELECT CASE WHEN l_returnflag = 'R' THEN 'baseline' ELSE 'candidate' END AS side,
       'rep' || CAST(l_linenumber AS STRING) AS report_id,
       'src/p' || CAST(l_partkey % 20 AS STRING) || '/m' || CAST(l_suppkey % 5 AS STRING) || '.py' AS path,
       CAST(l_orderkey % 200 + l_linenumber AS INT) AS line,
       CAST(floor(l_quantity) AS INT) % 3 AS hits
FROM {lineitem}""",
    "v_changed_line": """
SELECT DISTINCT 'g' || CAST(o_custkey % 4 AS STRING) AS gate_id,
       'p' || CAST(o_custkey % 20 AS STRING) || '/m' || CAST(o_orderkey % 5 AS STRING) || '.py' AS path,
       CAST(o_orderkey % 200 AS INT) AS line
FROM {orders}""",
    "v_span": """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS trace_id, event_id AS span_id,
       CASE WHEN event_id % 40 = 0 THEN event_id + 3 WHEN event_id % 4 = 0 THEN NULL ELSE event_id - 1 END AS parent_span_id,
       event_type AS service, event_id * 1000 AS start_ns,
       event_id * 1000 + CAST(floor(value * 10) AS BIGINT) AS end_ns,
       'v' || CAST(event_id % 3 AS STRING) AS version
FROM {events}""",
    "v_usage": """
SELECT 'b' || CAST(o_custkey % 10 AS STRING) AS batch_id, o_orderkey AS ord,
       CASE WHEN o_orderkey % 3 = 0 THEN 'p1' WHEN o_orderkey % 3 = 1 THEN 'p2' ELSE 'p3' END AS provider,
       CASE WHEN o_orderkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model,
       CAST(floor(o_totalprice) AS BIGINT) % 5000 AS prompt_tokens,
       CAST(floor(o_totalprice) AS BIGINT) % 700 AS completion_tokens
FROM {orders}""",
    "v_prediction": """
SELECT doc_id AS case_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected,
       CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE 'good' END AS predicted
FROM {labels}""",
    # One block of runner output per event, with the record that a reader should find in it.
    "v_runner_block": """
SELECT event_id, 'r' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING) AS artifact_id, CAST(event_id % 7 AS INT) AS k,
  CASE CAST(event_id % 7 AS INT)
    WHEN 0 THEN '_______ test_a' || n || ' _______' || chr(10) || 'FAILED tests/test_x.py::test_a' || n || ' - assert ' || u || ' == 2'
    WHEN 1 THEN 'FAIL src/cart' || u || '.test.js' || chr(10) || '  ● cart adds' || n || chr(10) || '    Expected: 3' || chr(10) || '    Received: 4'
    WHEN 2 THEN '--- FAIL: TestCart' || n || ' (0.00s)' || chr(10) || '    cart_test.go:' || u || ': want 3'
    WHEN 3 THEN 'Failures:' || chr(10) || '  1) Cart adds' || n || chr(10) || '     Failure/Error: expect(1)' || chr(10) || '     # ./spec/cart_spec.rb:' || u || ':in x'
    WHEN 4 THEN '---- cart::adds' || n || ' stdout ----' || chr(10) || 'thread main panicked at ''boom'', src/cart.rs:' || u || ':5' || chr(10) || chr(10) || 'failures:' || chr(10)
    WHEN 5 THEN '  Failed Cart.Adds' || n || ' [12 ms]' || chr(10) || '  Error Message:' || chr(10) || '   boom' || chr(10) || '  Stack Trace:' || chr(10) || '     at Cart.Adds() in /src/Cart.cs:line ' || u
    ELSE 'FAIL src/a.spec.ts > cart > adds' || n || chr(10) || 'AssertionError: expected 1' END AS block,
  CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'tests/test_x.py::test_a' || n WHEN 1 THEN 'cart adds' || n WHEN 2 THEN 'TestCart' || n
    WHEN 3 THEN 'Cart adds' || n WHEN 4 THEN 'cart::adds' || n WHEN 5 THEN 'Cart.Adds' || n ELSE 'cart > adds' || n END AS name,
  CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'tests/test_x.py' WHEN 1 THEN 'src/cart' || u || '.test.js' WHEN 2 THEN 'cart_test.go'
    WHEN 3 THEN './spec/cart_spec.rb' WHEN 4 THEN 'src/cart.rs' WHEN 5 THEN '/src/Cart.cs' ELSE 'src/a.spec.ts' END AS file,
  CASE WHEN event_id % 7 IN (2, 3, 4, 5) THEN user_id + 1 END AS line,
  CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'assert ' || u || ' == 2' WHEN 1 THEN 'Expected: 3 / Received: 4' WHEN 2 THEN 'want 3'
    WHEN 3 THEN 'expect(1)' WHEN 4 THEN 'boom' WHEN 5 THEN 'boom' ELSE 'AssertionError: expected 1' END AS assertion
FROM (SELECT *, CAST(event_id AS STRING) AS n, CAST(user_id + 1 AS STRING) AS u FROM {events})""",
    "v_frame_line": """
SELECT event_id, 'f' || CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING) AS artifact_id, CAST(event_id % 8 AS INT) AS line_no,
  CASE CAST(event_id % 9 AS INT)
    WHEN 0 THEN '  File "src/m' || u || '.py", line ' || l || ', in run'
    WHEN 1 THEN '  src/m.py:' || l || ': in run' WHEN 2 THEN 'src/m.py:' || l || ': AssertionError'
    WHEN 3 THEN 'src/main.c:' || l || ':5: error: bad' WHEN 4 THEN 'deploy/app.yaml:' || l || ': bad'
    WHEN 5 THEN 'on main.tf line ' || l || ', in resource' WHEN 6 THEN '  at com.x.Cart.add(Cart.java:' || l || ')'
    WHEN 7 THEN '    at run (src/app.js:' || l || ':7)' ELSE '   at N.C.M() in /src/C.cs:line ' || l END AS line_text,
  CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'src/m' || u || '.py' WHEN 1 THEN 'src/m.py' WHEN 2 THEN 'src/m.py' WHEN 3 THEN 'src/main.c'
    WHEN 4 THEN 'deploy/app.yaml' WHEN 5 THEN 'main.tf' WHEN 6 THEN 'Cart.java' WHEN 7 THEN 'src/app.js' ELSE '/src/C.cs' END AS file,
  event_id % 50 + 1 AS line,
  CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'run' WHEN 1 THEN 'run' WHEN 2 THEN 'AssertionError' WHEN 6 THEN 'Cart.add' WHEN 7 THEN 'run' END AS function
FROM (SELECT *, CAST(user_id AS STRING) AS u, CAST(event_id % 50 + 1 AS STRING) AS l FROM {events})""",
    "v_event_line": """
SELECT artifact_id, line_no, event_id, trace_part || ' ' || time_part AS tail,
       'job step' || CAST(event_id AS STRING) || ' failed ' || trace_part || ' ' || time_part || CASE WHEN event_id % 3 = 0 THEN ' seq=' || CAST(event_id % 97 + 1 AS STRING) ELSE '' END AS line,
       CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 97 + 1 AS INT) END AS sequence,
       CASE WHEN event_id % 4 = 3 THEN '0000000000000000' || hex16 WHEN event_id % 4 = 2 THEN '' ELSE hex16 END AS trace_id,
       CASE WHEN event_id % 4 IN (0, 1) THEN hex16 ELSE '' END AS span_id,
       CASE WHEN event_id % 4 = 3 THEN hex16 WHEN event_id % 4 = 1 THEN hex16 END AS parent_span_id,
       CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 5 = 0 THEN '2024-01-02T03:04:0' || d ELSE '2024-01-02T03:04:0' || d || '.5Z' END AS timestamp,
       CASE WHEN event_id % 6 = 0 THEN 1700000000000000000 + event_id WHEN event_id % 5 = 0 THEN NULL
            ELSE (1704164640 + event_id % 10) * 1000000000 + 500000000 END AS timestamp_ns
FROM (SELECT *, CASE WHEN event_id % 4 = 3 THEN 'traceparent=00-0000000000000000' || hex16 || '-' || hex16 || '-01'
                     WHEN event_id % 4 = 2 THEN 'untraced'
                     WHEN event_id % 4 = 1 THEN 'trace_id=' || hex16 || ' span_id=' || hex16 || ' parent_span_id=' || hex16
                     ELSE 'trace_id=' || hex16 || ' span_id=' || hex16 END AS trace_part,
             CASE WHEN event_id % 6 = 0 THEN 'timestamp_ns=' || CAST(1700000000000000000 + event_id AS STRING)
                  WHEN event_id % 5 = 0 THEN '2024-01-02T03:04:0' || d ELSE '2024-01-02T03:04:0' || d || '.5Z' END AS time_part
      FROM (SELECT event_id, 'e' || CAST(CAST(floor(event_id / 24) AS BIGINT) AS STRING) AS artifact_id, CAST(event_id % 24 AS INT) AS line_no,
                   lpad(CAST(event_id AS STRING), 16, '0') AS hex16, CAST(event_id % 10 AS STRING) AS d FROM {events}))""",
    "v_entity_line": """
SELECT 'n' || CAST(CAST(floor(event_id / 16) AS BIGINT) AS STRING) AS artifact_id, CAST(event_id % 16 AS INT) AS line_no,
       'req_' || CAST(user_id % 3 AS STRING) AS request_id, 'u_' || CAST(user_id AS STRING) AS user_id,
       CASE WHEN event_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, '/api/' || CAST(user_id % 4 AS STRING) AS path,
       CASE WHEN event_id % 2 = 0
            THEN 'level=info request_id=req_' || CAST(user_id % 3 AS STRING) || ' user_id=u_' || CAST(user_id AS STRING) || ' method=post path=/api/' || CAST(user_id % 4 AS STRING)
            ELSE '{{"requestId":"req_' || CAST(user_id % 3 AS STRING) || '","user":"u_' || CAST(user_id AS STRING) || '"}} GET /api/' || CAST(user_id % 4 AS STRING) END AS line
FROM {events}""",
    "v_deploy_log": """
SELECT 'd' || CAST(event_id AS STRING) AS artifact_id, event_id, user_id,
       CASE CAST(event_id % 4 AS INT)
         WHEN 0 THEN 'kubectl rollout status deployment/api-' || u || ' -n prod' || chr(10) || 'revision: r' || n || ' commit=abcdef' || lpad(n, 7, '0')
         WHEN 1 THEN 'helm upgrade shop-' || u || ' failed' || chr(10) || 'rollback succeeded, error rate high'
         WHEN 2 THEN 'terraform apply started_at=2024-01-01T00:00:00Z strategy=canary workload/w' || u
         ELSE 'service outage in service=cart' || u || ' image registry/x:' || n END AS text,
       CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'helm' WHEN 2 THEN 'terraform' ELSE '' END AS platform,
       CASE WHEN event_id % 4 = 0 THEN 'prod' ELSE '' END AS namespace,
       CASE WHEN event_id % 4 = 0 THEN 'api-' || u ELSE '' END AS target,
       CASE WHEN event_id % 4 = 1 THEN 'shop-' || u ELSE '' END AS release,
       CASE WHEN event_id % 4 = 0 THEN 'r' || n ELSE '' END AS revision,
       CASE WHEN event_id % 4 = 0 THEN 'abcdef' || lpad(n, 7, '0') ELSE '' END AS commit,
       CASE WHEN event_id % 4 = 1 THEN 'failed' ELSE '' END AS outcome,
       CASE WHEN event_id % 4 = 1 THEN 'rollback_succeeded' ELSE '' END AS recovery,
       CASE WHEN event_id % 4 = 2 THEN 'canary' ELSE '' END AS strategy,
       CASE WHEN event_id % 4 = 2 THEN 'w' || u ELSE '' END AS workload,
       CASE WHEN event_id % 4 = 3 THEN 'registry/x:' || n ELSE '' END AS artifact,
       CASE WHEN event_id % 4 = 1 THEN 'degraded' WHEN event_id % 4 = 3 THEN 'outage' ELSE '' END AS customer_impact
FROM (SELECT *, CAST(user_id AS STRING) AS u, CAST(event_id AS STRING) AS n FROM {events})""",
    "v_source_line": """
SELECT DISTINCT 'src/f' || CAST(o_custkey % 20 AS STRING) || '.py' AS file, o_orderkey % 45 + 1 AS line,
       'code ' || CAST(o_orderkey % 45 + 1 AS STRING) || ' of ' || CAST(o_custkey % 20 AS STRING) AS text
FROM {orders}""",
    "v_simple_frame": """
SELECT 'x' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING) AS artifact_id, CAST(event_id % 4 AS INT) AS pos,
       'src/f' || CAST(user_id % 20 AS STRING) || '.py' AS file, event_id % 50 + 1 AS line, CAST(NULL AS STRING) AS function
FROM {events}""",
}
