from pyspark.sql import functions as F

from faultlens.operators import coverage as G, gate
from faultlens.sinks import tables
from faultlens.sources import artifacts, coverage, reports, sarif


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "artifact_id string, text string")


def test_discovery_reads_only_supported_files(spark, tmp_path):
    for name, text in {
        "a.log": "x\r\ny", "a.json": "{}", "node_modules/b.log": "no", "junit/r.xml": "<testsuite><testcase name='t'><failure message='m'/></testcase></testsuite>",
        "src/data.xml": "<x/>", "jest/empty.json": '{"tests": []}', "c.txt": "no", "bad.log": b"\xffok",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    found = artifacts.read_artifacts(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[-1]: r.text for r in found.collect()}
    assert rows["a.log"] == "x\ny" and rows["bad.log"] == "�ok"
    assert set(rows) == {"a.log", "bad.log", "r.xml", "empty.json"}
    kept = {r.path.rsplit("/", 1)[-1] for r in artifacts.parseable(found).collect()}
    assert kept == {"a.log", "bad.log", "r.xml"}
    assert artifacts.list_files(spark, str(tmp_path)).count() == 8


def test_junit_edge_cases(spark):
    text = """<testsuites><testsuite><ns:testcase name="a" file="f.py"><error message="e&amp;1"/><failure>t</failure></ns:testcase>
    <testcase classname="C" name="x > y" time="bad"/><testcase><rerunFailure message="once"/></testcase></testsuite></testsuites>"""
    rows = reports.junit_results(docs(spark, text, "<!DOCTYPE x><testcase name='no'/>", "<testsuite/>")).orderBy("suite", "test", "attempt").collect()
    assert [(r.suite, r.test, r.status, r.attempt) for r in rows] == [
        ("C", "x > y", "passed", 1), ("f.py", "a", "error", 1), ("f.py", "a", "failed", 2), ("unknown", "unknown", "failed", 1), ("unknown", "unknown", "passed", 2)]


def test_json_trees_and_summary_sections(spark):
    text = '{"summary":{"failed":[{"name":"a","outcome":"passed"}],"errors":[{"name":"b"}]},"other":{"tests":[{"name":"no","outcome":"failed"}]},"tests":[{"tests":[{"id":"c","status":"ok"}]}]}'
    rows = reports.test_json_results(docs(spark, text, "broken")).collect()
    assert sorted((r.test, r.status) for r in rows) == [("a", "failed"), ("b", "error"), ("c", "passed")]
    failing = reports.test_json_failures(docs(spark, '[{"state":"failed","fullTitle":"x y","error":{"stack":"s"},"location":{"file":"f"}}]')).collect()
    assert [(r.name, r.file, r.assertion) for r in failing] == [("x y", "f", "s")]


def test_sarif_levels_and_suppressions(spark):
    text = '''{"runs":[{"tool":{"driver":{"name":"t","rules":[{"id":"A","properties":{"problem.severity":"Critical"}},{"id":"B"}]}},"results":[
      {"ruleIndex":0,"message":"plain"},{"ruleId":"B","level":"bogus"},{"ruleId":"Z","properties":[1],"ruleIndex":0},{"ruleId":"B","suppressions":[{"status":"rejected"}]},{"ruleId":"B","suppressions":[]}]}]}'''
    rows = sarif.sarif_findings(docs(spark, text)).orderBy("pos").collect()
    assert [(r.rule_id, r.level, r.message, r.suppressed) for r in rows] == [
        ("A", "critical", "plain", False), ("B", "warning", "", False), ("Z", "warning", "", False), ("B", "warning", "", False), ("B", "warning", "", False)]


def test_lcov_without_end_and_repeated_files(spark):
    text = "SF:./a.py\nDA:1,2\nDA:1,0\nDA:x,1\nBRDA:1,0,0,-\nend_of_record\nSF:a.py\nDA:1,3\nBRDA:1,0,0,4\nDA:2,0"
    rows = coverage.lcov(docs(spark, text).withColumnRenamed("artifact_id", "report_id"))
    merged = {(r.path, r.line): r.hits for r in G.merge_lines(rows).collect()}
    assert merged == {("a.py", 1): 3, ("a.py", 2): 0}
    branch = G.merge_branches(rows).first()
    assert (branch.branches_total, branch.branches_covered, branch.branch_data_complete) == (1, 1, False)


def test_cobertura_repeated_method_lines(spark):
    text = '<coverage><class filename="a.py"><methods><method><lines><line number="1" hits="9"/></lines></method></methods><lines><line number="1" hits="0"/></lines></class></coverage>'
    assert [(r.line, r.hits) for r in coverage.cobertura(docs(spark, text), "artifact_id").collect()] == [(1, 0)]


def test_diff_positions(spark):
    text = "\n".join(["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,3 +10,4 @@", " c", "-old", "--- removed", "+n1", "++++ n2", " c", "@@ -9 +30 @@", "+z",
                      "diff --git a/y b/y", "--- a/y", "+++ /dev/null", "@@ -1 +0,0 @@", "-gone"])
    rows = coverage.changed_lines(docs(spark, text), "artifact_id").orderBy("line").collect()
    assert [(r.path, r.line) for r in rows] == [("x", 11), ("x", 12), ("x", 30)]


def test_sniffing(one):
    texts = ["<coverage/>", "<!DOCTYPE r><report><package/></report>", "<report><package/></report>", "<CoverageSession/>", '{"f":{"statementMap":{},"s":{}}}',
             '{"a.cs":{"Lines":{"1":1}}}', '{"f":{"lines":{"total":1}}}', "SF:a\nend_of_record", "x"]
    assert one(texts, coverage.coverage_format) == ["cobertura", None, "jacoco", "dotnet_xml", "istanbul", "dotnet_json", "istanbul_summary", "lcov", None]


def test_gate_without_any_evidence_fails_closed(spark):
    gates = spark.createDataFrame([("g",)], "gate_id string")
    empty = spark.createDataFrame([], "gate_id string, decision string, candidate_status string, duration_regression boolean, duration_candidate_ms int, duration_baseline_median_ms int")
    rules = {"new_failure": "block", "flaky": "warn", "sarif_error": "warn", "changed_line_coverage": {"minimum": 0.5, "outcome": "warn"}, "coverage_delta": {"minimum": 0.0, "outcome": "pass"}}
    reasons = gate.gate_reasons(gates, rules, gate.classification_facts(empty))
    assert [r.rule for r in reasons.orderBy("ord").collect()] == [
        "history_evidence", "flaky_evidence", "sarif_evidence", "changed_line_coverage_evidence", "coverage_delta_evidence"]
    row = gate.gate_outcomes(gates, reasons).first()
    assert (row.policy_outcome, row.analysis_status) == ("block", "insufficient_evidence")


def test_history_row_that_moves_to_another_day(spark, tmp_path):
    path = str(tmp_path / "history")
    make = lambda rows: spark.createDataFrame(rows, "suite string, test string, run_id string, attempt int, status string, ingest_seq int, recorded_at string").withColumn(
        "recorded_at", F.to_timestamp("recorded_at"))
    tables.upsert_history(spark, make([("s", "t", "r", 1, "failed", 1, "2024-01-01 00:00:00"), ("s", "u", "r", 1, "failed", 2, "2024-01-03 00:00:00")]), path)
    tables.upsert_history(spark, make([("s", "t", "r", 1, "passed", 3, "2024-01-02 00:00:00")]), path)
    rows = spark.read.parquet(path).orderBy("test").collect()
    assert [(r.test, r.status, str(r.recorded_at)[:10]) for r in rows] == [("t", "passed", "2024-01-02"), ("u", "failed", "2024-01-03")]


def test_texts_of_an_export_stay_out_of_its_count(spark):
    """Positions over all manifests: one task sees two numbers a manifest, never their texts."""
    from __spark_entry__ import queries

    plan = queries()["K03_history_export"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Window [" in line]
    assert below and all("AS part#" in line and "AS count#" in line and line.count("get_json_object") == 2 and "Project [value#" not in line for line in below)
