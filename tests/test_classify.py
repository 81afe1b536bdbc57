import pytest
from pyspark.sql import functions as F

from faultlens.operators import classify as C, extract as X

LOGS = {
    "deadline then pod event": ("deployment api rollout timed out waiting for the condition\npod/api-1 CrashLoopBackOff", "deploy", "crash_loop"),
    "cleanup after cause": ("ModuleNotFoundError: No module named 'x'\nkubectl delete forbidden", "build", "import_error"),
    "timeout behind a bare summary": ("FAILED tests/a.py::test_x\nTimeoutError: timed out", "test", "timeout"),
    "summary with detail keeps order": ("FAILED tests/a.py::test_x - assert 1 == 2\nTimeoutError: timed out", "test", "test_failure"),
    "successful rollback is no failure": ("helm rollback succeeded", "unknown", "unknown"),
    "flaky rerun": ("a.py::t RERUN\na.py::t PASSED\n1 passed, 1 rerun", "test", "flaky"),
    "rerun that still fails": ("a.py::t RERUN\na.py::t FAILED", "test", "test_failure"),
    "ci timeout": ("running job 7\nworker timeout", "ci", "timeout"),
    "crash without candidates": ("panic: boom", "unknown", "compilation_error"),
    "healthy": ("all good", "unknown", "unknown"),
    "empty": ("", "unknown", "unknown"),
    "deploy exit 137": ("container api exited code 137", "deploy", "oom_killed"),
    "certificate in a job": ("job build started\ncurl: SSL certificate problem", "ci", "tls_certificate_error"),
}


@pytest.fixture(scope="module")
def analysed(spark):
    df = spark.createDataFrame([(name, log[0]) for name, log in LOGS.items()], "artifact_id string, text string")
    return {row.artifact_id: row for row in C.extract_events(C.classify_artifacts(df)).collect()}


@pytest.mark.parametrize("name", LOGS)
def test_stage_and_kind(analysed, name):
    assert (analysed[name].stage, analysed[name].kind) == LOGS[name][1:]


def test_unknown_logs_have_no_events(analysed):
    assert analysed["healthy"].events == [] and analysed["empty"].message == ""


def test_summary_of_empty_message(analysed):
    assert analysed["empty"].summary == "failure detected (unknown)"


def test_messages(spark):
    logs = [
        ("chained", "ValueError: a\napp error: first\nDuring handling of the above exception\napp error: last", "app error: last"),
        ("k8s", "error: rollout\nEvents:\n  Normal x\n  Warning BackOff Back-off restarting failed container", "Warning BackOff Back-off restarting failed container"),
        ("npm", "npm ERR! code ERESOLVE\nnpm ERR! errno 1\nnpm ERR! unable to resolve", "npm ERR! unable to resolve"),
        ("npm code only", "npm ERR! code E1\nnothing", "npm ERR! code E1"),
        ("last line", "a\n\nb  \n", "b"),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in logs], "artifact_id string, text string")
    got = {r.artifact_id: r.message for r in C.classify_artifacts(df).collect()}
    assert got == {a: m for a, _, m in logs}


def test_events_are_distinct_complete_and_traced(spark):
    lines = ["trace_id=00000000000000aa span_id=000000bb", "job a failed"] + ["job a failed"] * 3 + [f"job b{i} failed seq=9" for i in range(40)]
    df = spark.createDataFrame([("x", "\n".join(lines))], "artifact_id string, text string")
    events = C.extract_events(C.classify_artifacts(df)).first().events
    assert len(events) == 41 and events[0].role == "primary" and events[0].trace_id == "00000000000000aa"
    assert events[1].message == "job b0 failed seq=9" and events[1].sequence == 9 and events[1].trace_id == ""


def test_clock_rules(one):
    got = one(["x 2024-01-02T03:04:05.25+01:00 y", "2024-01-02T03:04:05", "ts_ns=1700000000000000000 2024-01-02T03:04:05Z", "none"], C.clock_of)
    assert [(g.timestamp, g.timestamp_ns) for g in got] == [
        ("2024-01-02T03:04:05.25+01:00", 1704161045250000000), ("2024-01-02T03:04:05", None), ("", 1700000000000000000), ("", None)]


def test_frames_keep_first_and_qualified_names(one):
    text = 'File "a.py", line 3, in f\nFile "a.py", line 3, in f\n  at org.x.Y.go(org/x/Y.java:7)\nat <anonymous> (x.js:1:2)\nlib/x.cc:5:1: error: no'
    got = [(f.file, f.line, f.function) for f in one([text], X.stack_frames)[0]]
    assert got == [("a.py", 3, "f"), ("org/x/Y.java", 7, "Y.go"), ("x.js", 1, "<anonymous>"), ("lib/x.cc", 5, None)]


def test_failed_test_merge_is_sequential(spark):
    text = "\n".join([
        "_____ test_low _____", "FAILED t/a.py::test_low - assert 1", "FAILED t/b.py::test_low - assert 2",
        "_____ TestUpper _____", "FAILED t/c.py::TestUpper - boom"])
    df = spark.createDataFrame([("x", text)], "artifact_id string, text string")
    rows = [(r.name, r.file, r.assertion) for r in X.failed_test_table(df).orderBy("pos").collect()]
    # Names with capitals never merge, as stored names are compared in lower case.
    assert rows == [("t/a.py::test_low", "t/a.py", "assert 1"), ("t/b.py::test_low", "t/b.py", "assert 2"),
                    ("TestUpper", "", ""), ("t/c.py::TestUpper", "t/c.py", "boom")]


def test_rspec_block_without_location_and_second_section(spark):
    text = "Failures:\n1) A b\nFailure/Error: x\n2) C d\nFailure/Error: y\n# ./s.rb:4\nFailures:\n3) E f"
    df = spark.createDataFrame([("x", text)], "artifact_id string, text string")
    rows = [(r.name, r.file, r.line, r.assertion) for r in X.failed_test_table(df).orderBy("pos").collect()]
    assert rows == [("A b", "", None, "x"), ("C d", "./s.rb", 4, "y"), ("E f", "", None, "")]


def test_entity_ties_go_to_the_first_seen(spark):
    text = "user=b request_id=r1\nuser=a request_id=r2\nGET /x\nmethod=post path=/y"
    df = spark.createDataFrame([("x", text), ("y", "")], "artifact_id string, text string")
    rows = {r.artifact_id: r for r in X.entity_context(df).collect()}
    assert (rows["x"].user_id, rows["x"].request_id, rows["x"].users, rows["x"].method, rows["x"].path) == ("b", "r1", ["b", "a"], "GET", "/x")
    assert rows["y"].users == [] and rows["y"].method == ""
