"""Reports, coverage, findings and gates. Documents are built by Spark from the tables, then read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.q_history import _CLASSIFY, classified
from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.operators import coverage as G, gate as Q, history as H
from faultlens.sources import coverage as COV, reports as R, sarif as S

# Documents of a bounded number of elements: 60 test results, or the lines of one small file set.
VIEWS["v_case"] = """
SELECT 'run-' || CAST(CAST(floor(event_id / 60) AS BIGINT) AS STRING) AS artifact_id, event_id, CAST(event_id % 60 AS INT) AS pos,
       'suite.S' || CAST(user_id % 5 AS STRING) AS suite, 't' || CAST(event_id AS STRING) AS name,
       CAST(event_id % 6 AS INT) AS k, CAST(event_id % 4000 AS INT) AS ms,
       CAST(CAST(floor((event_id % 4000) / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') AS secs
FROM {events}"""
VIEWS["v_junit_piece"] = """
SELECT artifact_id, pos, '<testcase classname="' || suite || '" name="pkg.' || name || '" time="' || secs || '"' ||
  CASE k WHEN 0 THEN '><failure message="boom &lt;' || name || '&gt;">trace</failure></testcase>'
         WHEN 1 THEN '><error>bad ' || name || '</error><failure message="again"/></testcase>'
         WHEN 2 THEN '><skipped/></testcase>' WHEN 3 THEN '><flakyFailure message="once">x</flakyFailure></testcase>'
         ELSE '/>' END AS piece FROM {v_case}"""
VIEWS["v_json_piece"] = """
SELECT artifact_id, pos, '{{"name":"a/' || name || '","file":"' || suite || '","duration":' || secs || ',"outcome":"' ||
  CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'skip' WHEN 3 THEN 'weird' ELSE 'Passed' END || '","error":{{"message":"m ' || name || '"}}}}' AS piece FROM {v_case}"""
VIEWS["v_sarif_piece"] = """
SELECT artifact_id, pos, k, name,
  '{{"ruleId":"R' || CAST(k AS STRING) || '"' || CASE WHEN k = 4 THEN ',"level":"error"' ELSE '' END || ',"message":{{"text":"find ' || name || '"}}' ||
  CASE WHEN k = 3 THEN ',"properties":{{"security-severity":"9.1"}}' ELSE '' END ||
  CASE WHEN k = 5 THEN ',"suppressions":[{{"kind":"x"}}]' ELSE '' END ||
  ',"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"src/' || name || '.py"}},"region":{{"startLine":' || CAST(pos + 1 AS STRING) || '}}}}}}]}}' AS piece,
  CASE k WHEN 0 THEN 'note' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' WHEN 4 THEN 'error' ELSE 'warning' END AS level
FROM {v_case}"""
# Line coverage by report: lines of a file are distinct, a file belongs to one report.
VIEWS["v_cov"] = """
SELECT 'rep' || CAST(p AS STRING) AS report_id, 'src/f' || CAST(f AS STRING) || '.py' AS path, f, line, max(hits) AS hits
FROM (SELECT l_partkey % 50 AS p, l_partkey % 50 * 4 + l_suppkey % 4 AS f, CAST(l_orderkey % 100 + 1 AS INT) AS line, CAST(floor(l_quantity) AS INT) % 3 AS hits FROM {lineitem})
GROUP BY 1, 2, 3, 4"""


def _documents(d: Data, pieces, key: str, order: str, prefix: str, suffix: str, separator: str):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda r: r["piece"]), separator)
    return d.gathered(pieces, key).agg(F.concat(F.lit(prefix), body, F.lit(suffix)).alias("text"))


def junit_documents(d: Data):
    return _documents(d, d.v_junit_piece, "artifact_id", "pos", '<?xml version="1.0"?><testsuites><testsuite name="s">', "</testsuite></testsuites>", "\n")


def json_documents(d: Data):
    return _documents(d, d.v_json_piece, "artifact_id", "pos", '{"suites":[{"name":"outer","tests":[', "]}]}", ",")


def sarif_documents(d: Data):
    prefix = ('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"scan","rules":[{"id":"R0","name":"Zero","defaultConfiguration":{"level":"note"}},'
              '{"id":"R1","defaultConfiguration":{"level":"error"}}]}},"results":[')
    return _documents(d, d.v_sarif_piece, "artifact_id", "pos", prefix, "]}]}", ",")


JUNIT_ROWS = """
SELECT artifact_id, suite, name AS test, secs, k, u.status, u.attempt, u.message FROM (
 SELECT *, CASE k WHEN 0 THEN [{{'status':'failed','attempt':1,'message':'boom <' || name || '>'}}]
  WHEN 1 THEN [{{'status':'error','attempt':1,'message':'bad ' || name}}, {{'status':'failed','attempt':2,'message':'again'}}]
  WHEN 2 THEN [{{'status':'skipped','attempt':1,'message':''}}]
  WHEN 3 THEN [{{'status':'failed','attempt':1,'message':'once'}}, {{'status':'passed','attempt':2,'message':''}}]
  ELSE [{{'status':'passed','attempt':1,'message':''}}] END AS r FROM {v_case}), unnest(r) AS x(u)"""


@query("S05_junit_results", sql=f"""
SELECT artifact_id, suite, test, status, attempt, CAST(floor(CAST(secs AS DOUBLE) * 1000) AS INT) AS duration_ms, CASE WHEN message = '' THEN '' ELSE sha256(message) END AS failure_signature FROM ({JUNIT_ROWS})""")
def junit(d: Data):
    return R.junit_results(junit_documents(d)).select("artifact_id", "suite", "test", "status", "attempt", "duration_ms", "failure_signature")


@query("Q04_retry_expansion", sql=f"SELECT status, attempt, count(*) AS n FROM ({JUNIT_ROWS}) GROUP BY 1, 2")
def retries(d: Data):
    return R.junit_results(junit_documents(d)).groupBy("status", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query("S06_junit_failures", sql="""
SELECT artifact_id, kind, row_number() OVER (PARTITION BY artifact_id ORDER BY pos) AS rank, name, assertion FROM (
 SELECT artifact_id, pos, 'pkg.' || name AS name, CASE WHEN k IN (0, 1) THEN 'test_failure' ELSE 'flaky' END AS kind,
  CASE k WHEN 0 THEN 'boom <' || name || '>' WHEN 1 THEN 'bad ' || name ELSE 'once' END AS assertion,
  min(CASE WHEN k IN (0, 1) THEN 0 ELSE 1 END) OVER (PARTITION BY artifact_id) AS worst FROM {v_case} WHERE k IN (0, 1, 3))
WHERE (worst = 0) = (kind = 'test_failure')""")
def junit_failing(d: Data):
    return R.junit_failures(junit_documents(d)).select("artifact_id", "kind", "rank", "name", "assertion")


@query("S06_report_summary", sql="""
SELECT artifact_id, 'test' AS stage, kind, substr(message, 1, 200) AS summary, message FROM (
 SELECT artifact_id, kind, message, row_number() OVER (PARTITION BY artifact_id ORDER BY worst, pos) AS rn FROM (
  SELECT artifact_id, pos, CASE WHEN k IN (0, 1) THEN 0 ELSE 1 END AS worst, CASE WHEN k IN (0, 1) THEN 'test_failure' ELSE 'flaky' END AS kind,
   CASE k WHEN 0 THEN 'boom <' || name || '>' WHEN 1 THEN 'bad ' || name ELSE 'once' END AS message FROM {v_case} WHERE k IN (0, 1, 3))) WHERE rn = 1""")
def report_summary(d: Data):
    return R.report_summary(R.junit_failures(junit_documents(d)))


@query("S07_test_json_results", sql="""
SELECT artifact_id, suite, name AS test, CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' WHEN 3 THEN 'unknown' ELSE 'passed' END AS status,
       CASE WHEN ms > 0 THEN CAST(floor(CAST(secs AS DOUBLE) * 1000) AS INT) END AS duration_ms, sha256('m ' || name) AS failure_signature FROM {v_case}""")
def test_json(d: Data):
    return R.test_json_results(json_documents(d)).select("artifact_id", "suite", "test", "status", "duration_ms", "failure_signature")


@query("S08_test_json_failures", sql="""
SELECT artifact_id, 'a/' || name AS name, suite AS file, 'm ' || name AS assertion FROM {v_case} WHERE k IN (0, 1)""")
def test_json_failing(d: Data):
    return R.test_json_failures(json_documents(d)).select("artifact_id", "name", "file", "assertion")


@query("S09_go_json_failures", sql="""
SELECT artifact_id, name, 'pkg/' || suite AS file, 'out ' || name || chr(10) AS assertion FROM {v_case} WHERE k IN (0, 1)""")
def go_json(d: Data):
    row = lambda action, extra: F.concat(F.lit('{"Action":"' + action + '","Package":"pkg/'), "suite", F.lit('","Test":"'), "name", F.lit('"' + extra), F.lit("}"))
    text = F.concat_ws("\n", row("run", ""),
                       F.concat(F.lit('{"Action":"output","Test":"'), "name", F.lit('","Output":"out '), "name", F.lit('\\n"}')),
                       F.when(F.col("k") <= 1, row("fail", "")).otherwise(row("pass", "")))
    docs = _documents(d, d.v_case.select("artifact_id", "pos", text.alias("piece")), "artifact_id", "pos", "", "", "\n")
    return R.go_json_failures(docs).select("artifact_id", "name", "file", "assertion")


@query("S10_sarif_findings", sql="""
SELECT artifact_id, 'R' || CAST(k AS STRING) AS rule_id, CASE WHEN k = 0 THEN 'Zero' ELSE 'R' || CAST(k AS STRING) END AS rule_name, level, 'find ' || name AS message,
       'src/' || name || '.py' AS file_path, pos + 1 AS start_line, k = 5 AS suppressed FROM {v_sarif_piece}""")
def sarif(d: Data):
    return S.sarif_findings(sarif_documents(d)).select("artifact_id", "rule_id", "rule_name", "level", "message", "file_path", "start_line", "suppressed")


@query("S11_sarif_first_error", sql="""
SELECT artifact_id, arg_min('find ' || name, pos) AS message FROM {v_sarif_piece} WHERE k IN (1, 4) GROUP BY 1""")
def sarif_first(d: Data):
    return S.first_error(sarif_documents(d)).select("artifact_id", "message")


@query("G06_finding_levels", sql="SELECT artifact_id, level, count(*) AS n FROM {v_sarif_piece} GROUP BY 1, 2")
def levels(d: Data):
    return S.sarif_findings(sarif_documents(d)).groupBy("artifact_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("G07_suppressions", sql="SELECT artifact_id, count(*) FILTER (WHERE k = 5) AS suppressed FROM {v_sarif_piece} GROUP BY 1")
def suppressions(d: Data):
    return S.sarif_findings(sarif_documents(d)).groupBy("artifact_id").agg(F.count_if("suppressed").alias("suppressed"))


_COUNTS = """SELECT artifact_id, count(*) FILTER (WHERE k <> 5 AND level IN ('error', 'critical')) AS error_count, count(*) FILTER (WHERE level = 'critical') AS critical_count,
 count(*) FILTER (WHERE k <> 5 AND level = 'warning') AS warning_count, count(*) FILTER (WHERE level = 'note') AS note_count, count(*) AS processed_count FROM {v_sarif_piece} GROUP BY 1"""


@query("G08_finding_counts", sql=_COUNTS)
def finding_counts(d: Data):
    return S.finding_counts(S.sarif_findings(sarif_documents(d)), "artifact_id")


@query("G08_finding_summary", sql=f"SELECT *, greatest(0, processed_count - 10) AS omitted_count, processed_count > 10 AS truncated FROM ({_COUNTS})")
def finding_summary(d: Data):
    return S.finding_summary(S.sarif_findings(sarif_documents(d)), "artifact_id", shown=10)


@query("G08_top_findings", sql="""
SELECT artifact_id, name, rank FROM (SELECT artifact_id, name, row_number() OVER (PARTITION BY artifact_id ORDER BY CASE WHEN k = 5 THEN 4 WHEN level = 'critical' THEN 0 WHEN level = 'error' THEN 1 WHEN level = 'warning' THEN 2 ELSE 3 END, pos) AS rank FROM {v_sarif_piece}) WHERE rank <= 10""")
def top_findings(d: Data):
    rows = S.top_findings(S.sarif_findings(sarif_documents(d)), ["artifact_id"], ["run", "pos"], 10)
    return rows.select("artifact_id", F.substring("message", 6, 99).alias("name"), "rank")


# ------------------------------------------------------------------ coverage documents

def _coverage_documents(d: Data, header, line, footer: str, prefix: str, suffix: str, separator: str):
    """Two-level document: lines of a file, files of a report (four files of at most 100 lines)."""
    files = d.v_cov.groupBy("report_id", "path", "f").agg(
        F.array_sort(F.collect_list(F.struct("line", "hits"))).alias("_l"))
    piece = F.concat(header, F.array_join(F.transform("_l", line), separator), F.lit(footer))
    return _documents(d, files.select("report_id", "f", piece.alias("piece")), "report_id", "f", prefix, suffix, separator if separator == "," else "\n")


_s = lambda c: c.cast("string")
_COV_SQL = "SELECT report_id, path, line, hits FROM {v_cov}"
_pick = lambda df: df.filter(F.col("line").isNotNull()).select("report_id", "path", "line", "hits")


@query("S12_cobertura", sql="""SELECT report_id, path, line, hits, CASE WHEN hits = 2 THEN 4 ELSE 0 END AS b_total, CASE WHEN hits = 2 THEN 3 ELSE 0 END AS b_covered FROM {v_cov}""")
def cobertura(d: Data):
    docs = _coverage_documents(
        d, F.concat(F.lit('<class name="c" filename="./'), "path", F.lit('"><methods/><lines>')),
        lambda r: F.concat(F.lit('<line number="'), _s(r["line"]), F.lit('" hits="'), _s(r["hits"]),
                           F.when(r["hits"] == 2, '" branch="true" condition-coverage="75% (3/4)"/>').otherwise('"/>')),
        "</lines></class>", "<coverage><packages><package><classes>", "</classes></package></packages></coverage>", "")
    return COV.cobertura(docs).select("report_id", "path", "line", "hits", "b_total", "b_covered")


@query("S13_jacoco", sql="SELECT report_id, path, line, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hits, hits AS b_total, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS b_covered FROM {v_cov}")
def jacoco(d: Data):
    docs = _coverage_documents(
        d, F.concat(F.lit('<package name="src"><sourcefile name="'), F.substring("path", 5, 99), F.lit('">')),
        lambda r: F.concat(F.lit('<line nr="'), _s(r["line"]), F.lit('" mi="0" ci="'), _s(r["hits"]), F.lit('" mb="'),
                           _s(F.greatest(r["hits"] - 1, F.lit(0))), F.lit('" cb="'), _s(F.least(r["hits"], F.lit(1))), F.lit('"/>')),
        "</sourcefile></package>", "<report name='x'>", "</report>", "")
    return COV.jacoco(docs).select("report_id", "path", "line", "hits", "b_total", "b_covered")


def _lcov_documents(d: Data):
    return _coverage_documents(
        d, F.concat(F.lit("TN:\nSF:"), "path", F.lit("\nBRDA:1,0,0,1\nBRDA:1,0,1,-\n")),
        lambda r: F.concat(F.lit("DA:"), _s(r["line"]), F.lit(","), _s(r["hits"])), "\nend_of_record", "", "", "\n")


@query("S14_lcov", sql=_COV_SQL)
def lcov(d: Data):
    return _pick(COV.lcov(_lcov_documents(d)))


def _istanbul_documents(d: Data):
    files = d.v_cov.groupBy("report_id", "path", "f").agg(F.array_sort(F.collect_list(F.struct("line", "hits"))).alias("_l"))
    pair = lambda body: F.array_join(F.transform("_l", body), ",")
    piece = F.concat(
        F.lit('"'), "path", F.lit('":{"statementMap":{'), pair(lambda r: F.concat(F.lit('"'), _s(r["line"]), F.lit('":{"start":{"line":'), _s(r["line"]), F.lit("}}"))),
        F.lit('},"s":{'), pair(lambda r: F.concat(F.lit('"'), _s(r["line"]), F.lit('":'), _s(r["hits"]))), F.lit('},"b":{"0":[1,0,2]}}'))
    return _documents(d, files.select("report_id", "f", piece.alias("piece")), "report_id", "f", "{", "}", ",")


@query("S15_istanbul", sql=_COV_SQL)
def istanbul(d: Data):
    return _pick(COV.istanbul(_istanbul_documents(d)))


@query("S16_istanbul_summary", sql="SELECT report_id, path, count(*) AS lines_total, count(*) FILTER (WHERE hits > 0) AS lines_covered FROM {v_cov} GROUP BY 1, 2")
def istanbul_summary(d: Data):
    files = d.v_cov.groupBy("report_id", "path", "f").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("hits") > 0).alias("c"))
    piece = F.concat(F.lit('"'), "path", F.lit('":{"lines":{"total":'), _s(F.col("t")), F.lit(',"covered":'), _s(F.col("c")), F.lit("}}"))
    docs = _documents(d, files.select("report_id", "f", piece.alias("piece")), "report_id", "f", '{"total":{"lines":{"total":1,"covered":1}},', "}", ",")
    return COV.istanbul_summary(docs).select("report_id", "path", "lines_total", "lines_covered")


@query("S17_dotnet_xml", sql=_COV_SQL)
def dotnet_xml(d: Data):
    docs = _coverage_documents(
        d, F.concat(F.lit('<Module><Files><File uid="'), _s(F.col("f")), F.lit('" fullPath="'), "path", F.lit('"/></Files><P f="'), _s(F.col("f")), F.lit('">')),
        lambda r: F.concat(F.lit('<SequencePoint vc="'), _s(r["hits"]), F.lit('" sl="'), _s(r["line"]), F.lit('" fileid="'), _s(F.col("f")), F.lit('"/>')),
        "</P></Module>", "<CoverageSession>", "</CoverageSession>", "")
    return _pick(COV.dotnet_xml(docs))


@query("S18_dotnet_json", sql="SELECT report_id, replace(path, '.py', '.cs') AS path, line, hits FROM {v_cov}")
def dotnet_json(d: Data):
    docs = _coverage_documents(
        d, F.concat(F.lit('"m'), _s(F.col("f")), F.lit('.dll":{"'), F.replace("path", F.lit(".py"), F.lit(".cs")), F.lit('":{"N.C":{"M()":{"Branches":[],"Lines":{')),
        lambda r: F.concat(F.lit('"'), _s(r["line"]), F.lit('":'), _s(r["hits"])), "}}}}}", "{", "}", ",")
    return _pick(COV.dotnet_json(docs))


@query("S19_coverage_sniffing", sql=_COV_SQL)
def sniffing(d: Data):
    half = F.substring("report_id", 4, 9).cast("int") % 2 == 0
    mixed = _lcov_documents(d).filter(half).unionByName(_istanbul_documents(d).filter(~half))
    return _pick(COV.read_coverage(mixed))


@query("S20_diff_changed_lines", sql="SELECT DISTINCT gate_id, path, line + 3 AS line FROM {v_changed_line}")
def diff(d: Data):
    # One hunk per changed line: two context rows, one removal, one addition.
    hunks = d.v_changed_line.groupBy("gate_id", "path").agg(F.array_sort(F.collect_list(F.col("line") + 1)).alias("_l"))
    body = F.array_join(F.transform("_l", lambda n: F.concat(
        F.lit("@@ -"), _s(n), F.lit(",3 +"), _s(n), F.lit(",3 @@ def f\n a\n b\n-old\n+++ new"))), "\n")
    piece = F.concat(F.lit("diff --git a/x b/x\nindex 1..2\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), body)
    docs = _documents(d, hunks.select("gate_id", "path", piece.alias("piece")), "gate_id", "path", "", "\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone", "\n")
    return COV.changed_lines(docs)


# ------------------------------------------------------------------ coverage operators

@query("G01_merge_coverage", sql="SELECT side, path, line, max(hits) AS hits FROM {v_coverage_line} GROUP BY 1, 2, 3")
def merge(d: Data):
    return G.merge_lines(d.v_coverage_line, ["side"])


@query("G01_merge_branches", sql="""
SELECT path, max(b_total) AS branches_total, max(b_covered) AS branches_covered, count(*) FILTER (WHERE b_total > 0) <= 1 AS branch_data_complete FROM (
 SELECT report_id, path, sum(line % 2) AS b_total, sum(CASE WHEN hits > 0 THEN line % 2 ELSE 0 END) AS b_covered FROM {v_coverage_line} GROUP BY 1, 2) GROUP BY 1""")
def branches(d: Data):
    rows = d.v_coverage_line.withColumn("b_total", F.col("line") % 2).withColumn("b_covered", F.when(F.col("hits") > 0, F.col("line") % 2).otherwise(0))
    return G.merge_branches(rows, report=["report_id"])


_RATE = "round_even(CAST(count(*) FILTER (WHERE hits > 0) AS DOUBLE) / count(*), 4)"
_MERGED = "SELECT side, path, line, max(hits) AS hits FROM {v_coverage_line} GROUP BY 1, 2, 3"


@query("G02_coverage_totals", sql=f"SELECT side, count(*) AS lines_total, count(*) FILTER (WHERE hits > 0) AS lines_covered, count(DISTINCT path) AS files, {_RATE} AS line_rate FROM ({_MERGED}) GROUP BY 1")
def totals(d: Data):
    return G.report_totals(G.merge_lines(d.v_coverage_line, ["side"]), ["side"])


@query("G02_file_totals", sql=f"SELECT side, path, count(*) AS lines_total, count(*) FILTER (WHERE hits > 0) AS lines_covered, {_RATE} AS line_rate FROM ({_MERGED}) GROUP BY 1, 2")
def file_totals(d: Data):
    return G.file_totals(G.merge_lines(d.v_coverage_line, ["side"]), ["side"])


_DETAIL = """
cov AS (SELECT replace(path, '/m4.py', '/moved.py') AS path, line, max(hits) AS hits FROM {v_coverage_line} WHERE side = 'candidate' GROUP BY 1, 2),
paths AS (SELECT DISTINCT path FROM cov),
matched AS (SELECT c.path, min(p.path) AS stored FROM (SELECT DISTINCT path FROM {v_changed_line}) c
  JOIN paths p ON p.path = c.path OR p.path LIKE '%/' || c.path OR c.path LIKE '%/' || p.path GROUP BY 1 HAVING count(*) = 1),
detail AS (
SELECT ch.gate_id, count(*) FILTER (WHERE m.stored IS NOT NULL AND cov.hits IS NOT NULL) AS total, count(*) FILTER (WHERE cov.hits > 0) AS covered,
       count(*) FILTER (WHERE m.stored IS NOT NULL AND cov.hits IS NULL) AS unmapped_lines, count(DISTINCT CASE WHEN m.stored IS NULL THEN ch.path END) AS unavailable_files
FROM {v_changed_line} ch LEFT JOIN matched m ON m.path = ch.path LEFT JOIN cov ON cov.path = m.stored AND cov.line = ch.line GROUP BY 1)"""
_DETAIL_RATE = "CASE WHEN total > 0 THEN round_even(CAST(covered AS DOUBLE) / total, 4) ELSE 1.0 END"


def _changed_detail(d: Data):
    # The report names one file of each folder otherwise, so changes to it have no coverage.
    moved = F.replace("path", F.lit("/m4.py"), F.lit("/moved.py"))
    lines = G.merge_lines(d.v_coverage_line.filter("side = 'candidate'").withColumn("path", moved))
    return G.changed_line_detail(d.v_changed_line, lines)


@query("G03_changed_line_coverage", sql=f"WITH {_DETAIL} SELECT *, {_DETAIL_RATE} AS rate FROM detail")
def changed(d: Data):
    return _changed_detail(d)


_DELTA = """
SELECT p, CASE WHEN co + bo = 0 AND ct > 0 THEN round_even(cr - br, 4) END AS delta, co AS candidate_only_files, bo AS baseline_only_files FROM (
 SELECT p, sum(ct) AS ct, CAST(count(*) FILTER (WHERE ct > 0 AND bt = 0) AS BIGINT) AS co, CAST(count(*) FILTER (WHERE ct = 0 AND bt > 0) AS BIGINT) AS bo,
  CASE WHEN sum(ct) > 0 THEN round_even(CAST(sum(cc) AS DOUBLE) / sum(ct), 4) ELSE 1.0 END AS cr, CASE WHEN sum(bt) > 0 THEN round_even(CAST(sum(bc) AS DOUBLE) / sum(bt), 4) ELSE 1.0 END AS br
 FROM (SELECT substr(path, 5, 2) AS p, path, count(*) FILTER (WHERE side = 'candidate') AS ct, count(*) FILTER (WHERE side = 'candidate' AND hits > 0) AS cc,
  count(*) FILTER (WHERE side = 'baseline') AS bt, count(*) FILTER (WHERE side = 'baseline' AND hits > 0) AS bc FROM (
   SELECT side, CASE WHEN side = 'baseline' AND path = 'src/p7/m1.py' THEN 'src/p7/old.py' ELSE path END AS path, line, max(hits) AS hits FROM {v_coverage_line} GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"""


@query("G04_coverage_delta", sql=_DELTA)
def delta(d: Data):
    renamed = F.when(F.expr("side = 'baseline' AND path = 'src/p7/m1.py'"), "src/p7/old.py").otherwise(F.col("path"))
    rows = G.merge_lines(d.v_coverage_line.withColumn("path", renamed), ["side"])
    return G.coverage_delta(rows.withColumn("p", F.substring("path", 5, 2)), ["p"]).select("p", "delta", "candidate_only_files", "baseline_only_files")


@query("G05_coverage_scope", sql="""
SELECT DISTINCT path FROM {v_coverage_line} WHERE (path LIKE 'src/p1%' OR path LIKE '%/m2.py') AND path NOT LIKE 'src/p1_/m3.py'""")
def scope(d: Data):
    return d.v_coverage_line.select("path").distinct().filter(G.in_scope(F.col("path"), ["./src/p1*", "*/m2.py"], ["src/p1[0-9]/m3.py"]))


# ------------------------------------------------------------------ gates

POLICY = {
    "version": "1.0",
    "rules": {
        "new_failure": "block", "likely_regression": "warn", "flaky": "warn", "duration_regression": "warn", "sarif_error": "block",
        "sarif_warning": "warn", "high_severity": "warn", "changed_line_coverage": {"minimum": 0.7, "outcome": "warn", "max_unmapped_lines": 100000},
    },
    "environments": {"prod": {"sarif_warning": "block"}},
}

VIEWS["v_classification"] = """
SELECT 'g' || CAST(event_id % 4 AS STRING) AS gate_id, event_id, 'artifact' || CAST(user_id % 3 AS STRING) AS path,
       CASE WHEN event_id % 4 = 0 THEN 'passed' WHEN event_id % 8 = 1 AND user_id % 9 = 0 THEN 'new_failure' WHEN event_id % 4 = 2 AND user_id % 10 = 0 THEN 'historically_flaky'
            WHEN event_id % 4 = 3 AND event_type = 'error' THEN 'insufficient_history' ELSE 'passed' END AS decision,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS candidate_status,
       event_id % 4 = 2 AND event_id % 400 = 2 AS duration_regression, CASE WHEN event_id % 4 <> 0 THEN 5 END AS duration_candidate_ms, 3 AS duration_baseline_median_ms,
       event_id % 8 = 1 AND user_id = 9 AS high_incident
FROM {events}"""


def _reasons(d: Data, environment: str = ""):
    rules = Q.effective_rules(POLICY, environment)
    gates = d.v_classification.select("gate_id").distinct()
    sarif = S.finding_counts(S.sarif_findings(sarif_documents(d)).withColumn(
        "gate_id", F.concat(F.lit("g"), (F.substring("artifact_id", 5, 9).cast("int") % 3).cast("string"))), "gate_id")
    return gates, Q.gate_reasons(gates, rules, Q.classification_facts(d.v_classification), sarif, _changed_detail(d))


_GATE_FACTS = f"""
{_DETAIL},
t AS (SELECT gate_id, count(*) FILTER (WHERE decision = 'new_failure') AS nf, count(*) FILTER (WHERE decision = 'historically_flaky') AS fl,
  count(*) FILTER (WHERE duration_regression) AS dr, count(*) FILTER (WHERE candidate_status = 'failed' AND decision = 'insufficient_history') AS unresolved,
  count(*) FILTER (WHERE decision = 'insufficient_history') AS insufficient, count(*) FILTER (WHERE duration_candidate_ms IS NULL) AS untimed,
  count(*) FILTER (WHERE decision = 'new_failure' AND high_incident) AS hi FROM {{v_classification}} GROUP BY 1),
s AS (SELECT 'g' || CAST(CAST(substr(artifact_id, 5) AS INT) % 3 AS STRING) AS gate_id, count(*) FILTER (WHERE k <> 5 AND level IN ('error', 'critical')) AS e,
  count(*) FILTER (WHERE k <> 5 AND level = 'warning') AS w FROM {{v_sarif_piece}} GROUP BY 1),
c AS (SELECT *, {_DETAIL_RATE} AS rate FROM detail),
f AS (SELECT t.*, s.e, s.w, c.unavailable_files AS uf, c.unmapped_lines AS ul, c.total, c.rate FROM t LEFT JOIN s USING (gate_id) LEFT JOIN c USING (gate_id)),
reasons AS (
 SELECT gate_id, 1 AS o, 'new_failure' AS rule, 'block' AS outcome, false AS missing, CAST(nf AS STRING) || ' test(s) classified as new_failure' AS message FROM f WHERE nf > 0
 UNION ALL SELECT gate_id, 2, 'history_evidence', 'block', true, 'History-dependent policy rules could not be evaluated' FROM f WHERE unresolved > 0
 UNION ALL SELECT gate_id, 3, 'flaky', 'warn', false, CAST(fl AS STRING) || ' test(s) have flaky evidence' FROM f WHERE fl > 0
 UNION ALL SELECT gate_id, 4, 'flaky_evidence', 'warn', true, 'Flaky-test policy could not be fully evaluated without historical evidence' FROM f WHERE insufficient > 0
 UNION ALL SELECT gate_id, 5, 'duration_regression', 'warn', false, CAST(dr AS STRING) || ' test(s) exceeded duration regression thresholds' FROM f WHERE dr > 0
 UNION ALL SELECT gate_id, 6, 'duration_regression_evidence', 'warn', true, 'Duration-regression policy could not be evaluated without sufficient historical samples' FROM f WHERE untimed > 0
 UNION ALL SELECT gate_id, 7, 'high_severity', 'warn', false, CAST(hi AS STRING) || ' test failure(s) correlate with high severity incidents' FROM f WHERE hi > 0
 UNION ALL SELECT gate_id, 8, 'sarif_error', 'block', false, CAST(e AS STRING) || ' unsuppressed SARIF error(s) found' FROM f WHERE e > 0
 UNION ALL SELECT gate_id, 9, 'sarif_warning', 'warn', false, CAST(w AS STRING) || ' unsuppressed SARIF warning(s) found' FROM f WHERE w > 0
 UNION ALL SELECT gate_id, 10, 'sarif_evidence', 'block', true, 'SARIF policy rules could not be evaluated because no valid SARIF evidence was supplied' FROM f WHERE e IS NULL
 UNION ALL SELECT gate_id, 11, 'changed_line_coverage_evidence', 'warn', true, 'Changed-line coverage evidence is incomplete for the configured source scope' FROM f WHERE uf > 0 OR ul > 100000
 UNION ALL SELECT gate_id, 12, 'changed_line_coverage', 'warn', false, 'Changed-line coverage ' || format('{{:.1f}}', rate * 100) || '% is below 70.0%' FROM f WHERE total > 0 AND rate < 0.7)"""


@query("G10_gate_reasons", sql=f"""WITH {_GATE_FACTS.strip()}
SELECT gate_id, CAST(row_number() OVER (PARTITION BY gate_id ORDER BY o) AS INT) AS ord, rule, outcome FROM reasons""")
def reasons(d: Data):
    return _reasons(d)[1].select("gate_id", "ord", "rule", "outcome")


@query("G11_missing_evidence", sql=f"WITH {_GATE_FACTS.strip()} SELECT gate_id, rule, missing FROM reasons")
def missing(d: Data):
    return _reasons(d)[1].select("gate_id", "rule", "missing")


@query("G12_gate_outcome", sql=f"""WITH {_GATE_FACTS.strip()}
SELECT gate_id, CASE WHEN bool_or(outcome = 'block' OR rule = 'sarif_warning') THEN 'block' ELSE 'warn' END AS policy_outcome,
       CASE WHEN bool_or(missing) THEN 'insufficient_evidence' ELSE 'succeeded' END AS analysis_status, count(*) AS reasons FROM reasons GROUP BY 1""")
def outcome(d: Data):
    gates, rows = _reasons(d, "prod")
    return Q.gate_outcomes(gates, rows)


@query("G13_defect_draft", sql=f"""WITH {_GATE_FACTS.strip()},
n AS (SELECT *, row_number() OVER (PARTITION BY gate_id ORDER BY o) AS rn, count(*) OVER (PARTITION BY gate_id) AS total_reasons,
      CASE WHEN max(CASE WHEN outcome = 'block' THEN 1 ELSE 0 END) OVER (PARTITION BY gate_id) = 1 THEN 'block' ELSE 'warn' END AS verdict FROM reasons)
SELECT gate_id, 'QA quality gate ' || verdict || ': ' || CAST(total_reasons AS STRING) || ' policy reason(s)' AS title,
 'Policy outcome: **' || verdict || '**' || chr(10) || chr(10) || 'Evidence:' || chr(10) || string_agg('- [' || outcome || '] ' || message || ' (`gate-ev-' || lpad(CAST(rn AS STRING), 3, '0') || '`)', chr(10) ORDER BY rn) AS body_md
FROM n GROUP BY gate_id, verdict, total_reasons""")
def draft(d: Data):
    gates, rows = _reasons(d)
    return Q.defect_drafts(rows, Q.gate_outcomes(gates, rows))


@query("G14_provenance_ids", sql="""
WITH a AS (SELECT gate_id, path, row_number() OVER (PARTITION BY gate_id ORDER BY min(event_id)) AS a FROM {v_classification} GROUP BY 1, 2)
SELECT event_id, 'artifact-' || lpad(CAST(a AS STRING), 4, '0') || '-test-' || CASE WHEN t < 10000 THEN lpad(CAST(t AS STRING), 4, '0') ELSE CAST(t AS STRING) END AS evidence_id
FROM (SELECT *, row_number() OVER (PARTITION BY gate_id, path ORDER BY event_id) AS t FROM {v_classification}) c JOIN a ON a.gate_id = c.gate_id AND a.path = c.path""")
def provenance(d: Data):
    return Q.provenance_ids(d.v_classification.select("gate_id", "path", "event_id"), order="event_id").select("event_id", "evidence_id")


@query("G14_reason_provenance", sql="""
SELECT DISTINCT gate_id, CASE WHEN decision IN ('retry_recovered', 'historically_flaky', 'flaky_suspect') THEN 'flaky' ELSE decision END AS rule, CAST(event_id AS STRING) AS evidence_id
FROM {v_classification} WHERE decision IN ('new_failure', 'likely_regression', 'retry_recovered', 'historically_flaky', 'flaky_suspect')""")
def reason_provenance(d: Data):
    return Q.reason_provenance(d.v_classification.select("gate_id", "decision", F.col("event_id").cast("string").alias("evidence_id")))


_FULL_RULES = {"likely_regression": "block", "flaky": "warn", "sarif_error": "warn", "critical_sarif": "block"}


@query("G15_full_gate", sql=f"""{_CLASSIFY},
t AS (SELECT run_id || '/' || suite || '/' || CAST(CAST(substr(test, 2) AS INT) % 6 AS STRING) AS gate_id, count(*) FILTER (WHERE decision = 'likely_regression') AS lr, count(*) FILTER (WHERE decision IN ('retry_recovered', 'historically_flaky', 'flaky_suspect')) AS fl,
  count(*) FILTER (WHERE status IN ('failed', 'error') AND decision = 'insufficient_history') AS unresolved, count(*) FILTER (WHERE decision = 'insufficient_history') AS insufficient FROM decided GROUP BY 1),
s AS (SELECT 'run-' || substr(artifact_id, 5) || '/tests/s' || CAST(pos % 5 AS STRING) || '.py/' || CAST(pos // 5 % 6 AS STRING) AS gate_id, count(*) FILTER (WHERE k <> 5 AND level IN ('error', 'critical')) AS e,
  count(*) FILTER (WHERE k <> 5 AND level = 'critical') AS cr FROM {{v_sarif_piece}} GROUP BY 1),
x AS (SELECT gate_id, count(*) AS conflicts FROM (SELECT run_id || '/' || suite || '/' || CAST(CAST(substr(test, 2) AS INT) % 6 AS STRING) AS gate_id, test, attempt FROM {{v_test_result}} GROUP BY 1, 2, 3
  HAVING count(DISTINCT status || '|' || coalesce(CAST(duration_ms AS STRING), 'null') || '|' || environment) > 1) GROUP BY 1),
f AS (SELECT t.*, coalesce(e, 0) AS e, coalesce(cr, 0) AS cr, coalesce(conflicts, 0) AS conflicts FROM t LEFT JOIN s USING (gate_id) LEFT JOIN x USING (gate_id))
SELECT gate_id, CASE WHEN conflicts > 0 OR lr > 0 OR unresolved > 0 OR cr > 0 THEN 'block' WHEN fl > 0 OR insufficient > 0 OR e > 0 THEN 'warn' ELSE 'pass' END AS policy_outcome,
 CASE WHEN conflicts > 0 THEN 'conflicting_evidence' WHEN unresolved > 0 OR insufficient > 0 THEN 'insufficient_evidence' ELSE 'succeeded' END AS analysis_status,
 CAST((lr > 0)::INT + (unresolved > 0)::INT + (fl > 0)::INT + (insufficient > 0)::INT + (e > 0)::INT + (cr > 0)::INT AS BIGINT) AS reasons, conflicts FROM f""")
def full_gate(d: Data):
    """One gate per run, suite and shard of tests: decisions against the history, contradictions, and the findings of the run's scan."""
    gate = F.concat_ws("/", "run_id", "suite", (F.substring("test", 2, 9).cast("int") % 6).cast("string")).alias("gate_id")
    decided = classified(d).select(
        gate, "decision", F.col("status").alias("candidate_status"), "duration_regression",
        F.col("duration_ms").alias("duration_candidate_ms"), "duration_baseline_median_ms")
    conflicts = H.conflicts(d.v_test_result.withColumn("failure_signature", F.lit("")), ["run_id"]).select(gate)
    owner = F.concat(F.lit("run-"), F.expr("substr(artifact_id, 5)"), F.lit("/tests/s"), (F.col("pos") % 5).cast("string"), F.lit(".py/"), (F.floor(F.col("pos") / 5) % 6).cast("string"))
    counts = S.finding_counts(S.sarif_findings(sarif_documents(d)).withColumn("gate_id", owner), "gate_id")
    # Every run has its scan: a gate without findings has none, not missing evidence.
    sarif = decided.select("gate_id").distinct().join(counts, "gate_id", "left").fillna(0)
    return Q.full_gate(_FULL_RULES, decided, conflicts, sarif)
