"""Triage, evidence, timelines, traces and impact."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.q_extract import _joined
from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.functions.text import whole
from faultlens.operators import classify as C, evidence as E, impact as M, timeline as L, traces as TR, triage as T

VIEWS["v_changed_file"] = """
SELECT DISTINCT 'x' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING) AS artifact_id, 'f' || CAST(event_id % 25 AS STRING) || '.py' AS path FROM {events}"""
VIEWS["v_kind"] = """
SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'import_error' WHEN 1 THEN 'timeout' WHEN 2 THEN 'flaky' WHEN 3 THEN 'test_failure' WHEN 4 THEN 'ci_failure' WHEN 5 THEN 'unknown' WHEN 6 THEN 'oom_killed' ELSE 'api_rate_limited' END AS kind,
       CASE WHEN event_id % 16 = 3 THEN 'panic: boom' WHEN event_id % 7 = 0 THEN '' ELSE 'm' END AS message, user_id % 2 = 0 AS hits_change,
       CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'prod' WHEN 1 THEN ' Live ' ELSE 'staging' END AS environment,
       CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'outage' WHEN 1 THEN 'degraded' ELSE '' END AS impact,
       CASE WHEN event_id % 3 = 0 THEN '7.5%' WHEN event_id % 3 = 1 THEN '55' ELSE 'n/a' END AS budget FROM {events}"""
_SEVERITY = """CASE WHEN kind IN ('import_error', 'ci_failure', 'oom_killed') THEN 'high' WHEN kind IN ('timeout', 'api_rate_limited') THEN 'medium' WHEN kind = 'flaky' THEN 'low'
 WHEN message = 'panic: boom' THEN 'high' WHEN kind = 'test_failure' THEN CASE WHEN hits_change THEN 'high' ELSE 'medium' END ELSE 'low' END"""
_IMPACTED = "CASE WHEN environment <> 'staging' AND impact = 'outage' THEN 'critical' WHEN environment <> 'staging' AND impact = 'degraded' THEN 'high' ELSE severity END"


def _severity():
    return T.severity_of(F.col("kind"), F.col("message"), F.col("hits_change"))


@query("T01_severity", sql=f"SELECT event_id, severity, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS priority FROM (SELECT event_id, {_SEVERITY} AS severity FROM {{v_kind}})")
def severity(d: Data):
    return d.v_kind.select("event_id", _severity().alias("severity")).withColumn("priority", T.priority_of(F.col("severity")))


@query("T02_impact_severity", sql=f"SELECT event_id, {_IMPACTED} AS severity FROM (SELECT *, {_SEVERITY} AS severity FROM {{v_kind}})")
def impact_severity(d: Data):
    return d.v_kind.select("event_id", T.impact_severity(_severity(), F.col("environment"), F.col("impact")).alias("severity"))


@query("T03_severity_override", sql=f"SELECT event_id, CASE WHEN environment = 'staging' AND kind = 'timeout' THEN 'low' WHEN environment = 'prod' AND kind = 'flaky' THEN 'critical' ELSE severity END AS severity FROM (SELECT *, {_SEVERITY} AS severity FROM {{v_kind}})")
def override(d: Data):
    rules = {("staging", "timeout"): "low", ("prod", "flaky"): "critical", ("prod", "timeout"): "absurd"}
    return d.v_kind.select("event_id", T.override_severity(_severity(), F.col("environment"), F.col("kind"), rules).alias("severity"))


_EFFECTIVE = f"""SELECT event_id, CASE WHEN environment <> 'staging' AND budget = '7.5%' AND s <> 'critical' THEN 'high' ELSE s END AS severity
FROM (SELECT *, {_IMPACTED} AS s FROM (SELECT *, {_SEVERITY} AS severity FROM {{v_kind}}))"""


@query("T03b_effective_severity", sql=_EFFECTIVE)
def effective(d: Data):
    return d.v_kind.select("event_id", T.effective_severity(
        _severity(), F.col("environment"), F.col("impact"), L.budget_number(F.col("budget"))).alias("severity"))


@query("D14_budget_number", sql="SELECT event_id, CASE budget WHEN '7.5%' THEN 7.5::DOUBLE WHEN '55' THEN 55::DOUBLE END AS budget FROM {v_kind}")
def budget(d: Data):
    return d.v_kind.select("event_id", L.budget_number(F.col("budget")).alias("budget"))


@query("D16_investigation", sql=f"""SELECT event_id, budget_value, impact, severity AS effective_severity FROM ({_EFFECTIVE}) JOIN
 (SELECT event_id, CASE budget WHEN '7.5%' THEN 7.5::DOUBLE WHEN '55' THEN 55::DOUBLE END AS budget_value, CASE WHEN impact = '' THEN 'unknown' ELSE impact END AS impact FROM {{v_kind}}) USING (event_id)""")
def investigation(d: Data):
    rows = d.v_kind.withColumn("static_severity", _severity()).withColumnRenamed("impact", "customer_impact").withColumnRenamed("budget", "error_budget_remaining")
    return L.investigate(rows).select("event_id", F.col("budget").alias("budget_value"), "impact", "effective_severity")


_RULES = [("src/f1*", "ones"), ("*/f2.py", "two"), ("lib/", "library")]


@query("T04_component", sql="""
SELECT artifact_id, coalesce(arg_min(component, pos) FILTER (WHERE component IS NOT NULL), 'src') AS component FROM (
 SELECT artifact_id, pos, CASE WHEN file LIKE 'src/f1%' THEN 'ones' WHEN file LIKE '%/f2.py' THEN 'two' END AS component FROM {v_simple_frame}) GROUP BY 1""")
def component(d: Data):
    paths = d.v_simple_frame.groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda r: r["file"]).alias("p"))
    return paths.select("artifact_id", T.assign_component(F.col("p"), _RULES).alias("component"))


_OWNERS = """# owners
* @all
/src/f1* @ones @more # first
src/f2.py @two
bad
docs/ @docs"""


def _owner_rules(d: Data):
    files = d.region.select(F.concat(F.lit("repo"), F.col("r_regionkey").cast("string")).alias("scope"), F.lit(_OWNERS).alias("text"))
    return T.owner_rules(files)


def _scope():
    return F.concat(F.lit("repo"), (F.substring("artifact_id", 2, 9).cast("int") % 5).cast("string")).alias("scope")


@query("S21_owner_rules", sql="""
SELECT 'repo' || CAST(r_regionkey AS STRING) AS scope, ord, pattern, owners FROM {region}, (VALUES (1, '*', '@all'), (2, 'src/f1*', '@ones @more'), (3, 'src/f2.py', '@two'), (5, 'docs/', '@docs')) AS t(ord, pattern, owners)""")
def owner_rules(d: Data):
    return _owner_rules(d).select("scope", "ord", "pattern", F.array_join("owners", " ").alias("owners"))


@query("T05_owners", sql="""
SELECT artifact_id, arg_max(owners, pos) AS owners FROM (SELECT artifact_id, pos, CASE WHEN file = 'src/f2.py' THEN '@two' WHEN file LIKE 'src/f1%' THEN '@ones @more' ELSE '@all' END AS owners FROM {v_simple_frame}) GROUP BY 1""")
def owners(d: Data):
    paths = d.v_simple_frame.select("artifact_id", "pos", F.col("file").alias("path"), _scope())
    return T.owners_for_paths(paths, _owner_rules(d), "artifact_id").select("artifact_id", F.array_join("owners", " ").alias("owners"))


_HITS = """SELECT DISTINCT f.artifact_id, f.file, c.path FROM {v_simple_frame} f JOIN {v_changed_file} c ON c.artifact_id = f.artifact_id AND (c.path = f.file OR ends_with(f.file, '/' || c.path) OR ends_with(c.path, '/' || f.file))"""


@query("T06_path_suffix_match", sql=_HITS)
def suffix(d: Data):
    return T.frames_on_changed_files(d.v_simple_frame, d.v_changed_file).select("artifact_id", "file", "path")


_COMMITS = """SELECT 'f' || CAST(o_custkey % 25 AS STRING) || '.py' AS path, 'sha' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS sha, 'subject ' || CAST(o_orderkey AS STRING) AS subject, o_orderkey % 1000 AS ts FROM {orders}"""
VIEWS["v_commit"] = _COMMITS


@query("T07_correlated_commits", sql=f"""
WITH latest AS (SELECT path, sha, subject FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC) AS rn FROM {{v_commit}}) WHERE rn = 1)
SELECT artifact_id, path, sha, subject, rank FROM (SELECT h.artifact_id, l.*, row_number() OVER (PARTITION BY h.artifact_id ORDER BY l.path) AS rank FROM (SELECT DISTINCT artifact_id, path FROM ({_HITS})) h JOIN latest l USING (path))""")
def commits(d: Data):
    return T.correlated_commits(d.v_simple_frame, d.v_changed_file, d.v_commit)


VIEWS["v_blame"] = """
SELECT 'src/f' || CAST(f AS STRING) || '.py' AS file, b * 7 + 1 AS start_line, b * 7 + 7 AS end_line, 'c' || CAST(f * 100 + b AS STRING) AS sha
FROM (SELECT DISTINCT o_custkey % 20 AS f, o_orderkey % 8 AS b FROM {orders})"""


@query("T07b_line_provenance", sql="SELECT f.artifact_id, f.pos, b.sha FROM {v_simple_frame} f JOIN {v_blame} b ON b.file = f.file AND f.line BETWEEN b.start_line AND b.end_line")
def provenance(d: Data):
    return T.line_provenance(d.v_simple_frame, d.v_blame, 16).select("artifact_id", "pos", "sha")


@query("T08_completeness", sql="""
SELECT event_id, (10 + CASE WHEN kind <> 'unknown' THEN 35 ELSE 0 END + CASE WHEN message <> '' THEN 10 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN hits_change THEN 15 ELSE 0 END) / 100.0::DOUBLE AS score,
 CAST(greatest(1, CASE WHEN kind <> 'unknown' THEN 2 ELSE 0 END + CASE WHEN message <> '' THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN hits_change THEN 1 ELSE 0 END) AS INT) AS reasons FROM {v_kind}""")
def completeness(d: Data):
    value = T.completeness(F.col("kind"), F.col("kind") != "unknown", F.col("message"), F.col("event_id") % 2 == 0, F.col("hits_change"), F.lit(False))
    return d.v_kind.select("event_id", value.alias("c")).select("event_id", "c.score", F.size("c.reasons").alias("reasons"))


@query("T09_rule_hypothesis", sql="""
SELECT event_id, CASE kind WHEN 'import_error' THEN 'Module import failed; a dependency or module is missing or broken.' WHEN 'timeout' THEN 'Execution exceeded the allowed time; likely a slow/hanging path.'
 WHEN 'flaky' THEN 'Failure appears intermittent/flaky, possibly order- or environment-dependent.' WHEN 'test_failure' THEN 'Test assertion failed; the code under test diverges from expectations.'
 WHEN 'ci_failure' THEN 'The CI pipeline reported a failed job or step with a non-zero result.' WHEN 'unknown' THEN 'No strong automated signal; requires manual investigation.'
 WHEN 'oom_killed' THEN 'The deployed container was terminated because it exceeded its memory limit.' ELSE 'A remote API rejected the request with HTTP 429; the run hit a rate limit.' END AS hypothesis,
 CASE WHEN kind = 'unknown' THEN 'low' WHEN event_id % 3 = 0 THEN CASE WHEN message <> '' AND hits_change THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence,
 CASE WHEN kind = 'ci_failure' THEN CASE WHEN event_id % 3 = 0 THEN 'Refresh' ELSE 'Inspect' END END AS fix FROM {v_kind}""")
def hypothesis(d: Data):
    text = F.when(F.col("event_id") % 3 == 0, "the Lock File drifted").otherwise("x")
    tests = F.when(F.col("event_id") % 3 == 0, 2).otherwise(0)
    return d.v_kind.select(
        "event_id", T.hypothesis_of(F.col("kind")).alias("hypothesis"),
        T.confidence_of(F.col("kind"), F.col("message"), F.lit(0), tests, F.col("hits_change")).alias("confidence"),
        F.when(F.col("kind") == "ci_failure", F.substring_index(T.fix_of(F.col("kind"), text), " ", 1)).alias("fix"))


# Bundles: one artifact per four events with up to four tests and frames.
def bundles(d: Data):
    tests = d.v_runner_block.groupBy("artifact_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("event_id", "name", "file", F.col("line").cast("bigint").alias("line"), "assertion"))),
        lambda t: F.struct(t["name"].alias("name"), t["file"].alias("file"), t["line"].alias("line"), t["assertion"].alias("assertion"))).alias("failed_tests"))
    n = F.substring("artifact_id", 2, 9).cast("bigint")
    return tests.withColumn("message", F.when(n % 5 == 0, "").otherwise("boom")).withColumn("stage", F.lit("test")).withColumn(
        "kind", F.when(n % 7 == 0, "unknown").otherwise("test_failure")).withColumn("n", n).withColumn(
        "events", F.when(n % 3 == 0, F.array(F.struct(F.lit("ev-001").alias("event_id"), F.col("message").alias("message")))).otherwise(
            F.slice(F.array(F.struct(F.lit("ev-001").alias("event_id"), F.col("message").alias("message"))), 1, 0))).withColumn(
        "changed_files", F.when(n % 2 == 0, F.array(F.lit("b.py"), F.lit("a.py"))).otherwise(F.array().cast("array<string>")))


_BUNDLE = """
bundle AS (SELECT artifact_id, CAST(substr(artifact_id, 2) AS BIGINT) AS n, count(*) AS tests FROM {v_runner_block} GROUP BY 1),
item AS (
 SELECT artifact_id, n, 1 AS k, 0 AS p, 'failure_message' AS kind FROM bundle WHERE n % 5 <> 0
 UNION ALL SELECT artifact_id, n, 2, 0, 'failure_event' FROM bundle WHERE n % 3 = 0
 UNION ALL SELECT b.artifact_id, b.n, 4, r.event_id, 'failed_test' FROM bundle b JOIN {v_runner_block} r USING (artifact_id)
 UNION ALL SELECT artifact_id, n, 5, 0, 'changed_files' FROM bundle WHERE n % 2 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY k, p) AS rn FROM item)"""


@query("T10_evidence_items", sql=f"WITH {_BUNDLE} SELECT artifact_id, 'ev-' || lpad(CAST(rn AS STRING), 3, '0') AS id, kind FROM numbered")
def evidence(d: Data):
    return E.evidence_table(E.evidence_items(bundles(d))).select("artifact_id", "id", "kind")


@query("T11_observed_facts", sql=f"""WITH {_BUNDLE}, f AS (
 SELECT artifact_id, 0 AS p, 'failure_classification' AS kind, coalesce(min(CASE WHEN kind = 'failure_event' THEN rn END), min(CASE WHEN kind = 'failure_message' THEN rn END)) AS ref FROM numbered GROUP BY 1
 UNION ALL SELECT artifact_id, rn, kind, rn FROM numbered WHERE kind = 'failed_test')
SELECT artifact_id, 'fact-' || lpad(CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY p) AS STRING), 3, '0') AS id, kind, coalesce('ev-' || lpad(CAST(ref AS STRING), 3, '0'), '') AS refs FROM f""")
def facts(d: Data):
    rows = E.observed_facts(E.evidence_items(bundles(d)))
    return rows.select("artifact_id", F.inline(whole("facts"))).select("artifact_id", "id", "kind", F.array_join("evidence_refs", ",").alias("refs"))


def _hypotheses(rows):
    n = F.col("n")
    ref = F.when(n % 4 == 0, "ev-001").when(n % 4 == 1, "ev-099").otherwise("ev-002")
    against = F.when(n % 11 == 0, F.array(F.lit("ev-003"))).otherwise(F.array().cast("array<string>"))
    fix = F.when(n % 13 == 0, "run kubectl delete pod").otherwise("Compare the fixture")
    return rows.select("artifact_id", F.struct(
        F.lit("because").alias("hypothesis"), F.when(n % 6 == 0, "high").otherwise("medium").alias("confidence"),
        F.array(ref).alias("evidence_refs"), against.alias("contradicting_evidence_refs"), F.array().cast("array<string>").alias("missing_information"),
        F.array(F.lit("Check the seed")).alias("recommended_checks"), fix.alias("fix_suggestion")).alias("h"))


_REFS = f"""WITH {_BUNDLE}, m AS (SELECT artifact_id, n, max(rn) AS top, max(CASE WHEN kind = 'changed_files' THEN rn END) AS admin,
  bool_or(kind = 'failure_event' AND n % 5 = 0) AS blank_event, max(CASE WHEN kind = 'failure_event' THEN rn END) AS ev FROM numbered GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN n % 4 = 0 THEN 1 WHEN n % 4 = 1 THEN 99 ELSE 2 END AS ref FROM m),
s AS (SELECT *, ref <= top AND coalesce(ref <> admin, true) AND NOT (blank_event AND ref = ev) AS backed, n % 11 = 0 AND 3 <= top AS against FROM r)"""


@query("T12_support_status", sql=_REFS + """
SELECT artifact_id, CASE WHEN against THEN 'unsupported' WHEN backed THEN 'supported' WHEN n % 7 = 0 THEN 'insufficient_evidence' ELSE 'unsupported' END AS status FROM s""")
def support(d: Data):
    rows = E.evidence_items(bundles(d))
    joined = rows.join(_hypotheses(rows), "artifact_id")
    return joined.select("artifact_id", E.support_status(
        F.col("kind"), F.lit("llm"), F.col("evidence"), F.col("h.evidence_refs"), F.col("h.contradicting_evidence_refs")).alias("status"))


@query("T13_hypothesis_merge", sql=_REFS + """
SELECT artifact_id, CASE WHEN ok THEN 'because' ELSE 'rule' END AS hypothesis, CASE WHEN ok THEN 'merged' ELSE 'fallback' END AS engine FROM (
 SELECT *, ref <= top AND n % 13 <> 0 AND (n % 11 <> 0 OR 3 <= top) AND NOT (n % 11 = 0 AND ref = 3) AND (n % 6 <> 0 OR (n % 7 <> 0 AND n % 11 <> 0 AND backed)) AS ok FROM s)""")
def merge(d: Data):
    rows = E.evidence_items(bundles(d)).withColumn("hypothesis", F.lit("rule")).withColumn("confidence", F.lit("low")).withColumn("fix_suggestion", F.lit("x"))
    rows = rows.withColumn("rule_evidence", E.rule_evidence(rows))
    return E.merge_hypothesis(rows, _hypotheses(rows)).select("artifact_id", "hypothesis", "engine")


@query("K06_ticket_digest", sql="""
SELECT artifact_id, CASE WHEN CAST(substr(artifact_id, 2) AS BIGINT) % 2 = 0 THEN 'Duplicate: ' ELSE '' END || substr('[core] boom in ' || repeat('long ', 30), 1, 120) AS title,
 string_agg(name, ',' ORDER BY event_id) AS tests FROM {v_runner_block} GROUP BY 1""")
def digest(d: Data):
    rows = bundles(d).withColumn("component", F.lit("core")).withColumn("severity", F.lit("high")).withColumn(
        "summary", F.concat(F.lit("boom\n in  "), F.repeat(F.lit("long "), 30))).withColumn(
        "is_duplicate_of", F.when(F.col("n") % 2 == 0, "k")).withColumn("frames", F.col("failed_tests"))
    return E.digest_rows(rows).select("artifact_id", "title", F.array_join("top_tests", ",").alias("tests"))


@query("L09_safe_advice", sql="SELECT event_id, event_id % 5 = 0 AS safe FROM {events}")
def advice(d: Data):
    u = F.col("user_id").cast("string")
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("Inspect the log of u"), u)).when(k == 1, F.concat(F.lit("Sudo reboot "), u))
        .when(k == 2, F.concat(F.lit("see HTTPS://x/"), u)).when(k == 3, F.concat(F.lit("tab\there"), u)).otherwise(F.repeat(F.lit("a"), 513)))
    return d.events.select("event_id", E.safe_advice(text).alias("safe"))


# ------------------------------------------------------------------ timeline

def timelines(d: Data):
    logs = C.extract_events(C.classify_artifacts(_joined(d, d.v_event_line, "line_no", "line")))
    n = F.substring("artifact_id", 2, 9).cast("bigint")
    return L.build_timeline(logs.select(
        "artifact_id", "events", F.lit("build").alias("workflow"), F.lit("unit").alias("job_name"), F.lit("7").alias("run_id"),
        F.when(n % 2 == 0, "kubernetes").otherwise("").alias("platform"), F.when(n % 2 == 0, "2024-01-02T03:04:01Z").otherwise("").alias("started_at"),
        F.when(n % 3 == 0, "rollback_succeeded").otherwise("").alias("recovery")))


_TIMELINE = """
entry AS (
 SELECT artifact_id, 'ctx-ci' AS event_id, 'ci' AS source, NULL::BIGINT AS ts, NULL::INT AS seq, 0 AS i FROM (SELECT DISTINCT artifact_id FROM {v_event_line})
 UNION ALL SELECT artifact_id, 'ctx-deploy', 'deployment', CASE WHEN CAST(substr(artifact_id, 2) AS BIGINT) % 2 = 0 THEN 1704164641000000000 END, NULL, 1 FROM (SELECT DISTINCT artifact_id FROM {v_event_line}) WHERE CAST(substr(artifact_id, 2) AS BIGINT) % 2 = 0 OR CAST(substr(artifact_id, 2) AS BIGINT) % 3 = 0
 UNION ALL SELECT artifact_id, 'ev-' || lpad(CAST(line_no + 1 AS STRING), 3, '0'), 'failure_event', timestamp_ns, coalesce(sequence, line_no + 1), 2 + line_no FROM {v_event_line}
 UNION ALL SELECT artifact_id, 'rec-001', 'recovery', NULL, NULL, 100 FROM (SELECT DISTINCT artifact_id FROM {v_event_line}) WHERE CAST(substr(artifact_id, 2) AS BIGINT) % 3 = 0),
based AS (SELECT *, CASE WHEN ts IS NOT NULL THEN 'timestamp_ns' WHEN seq IS NOT NULL THEN 'sequence' ELSE 'log_order' END AS basis FROM entry),
spread AS (SELECT artifact_id, count(DISTINCT basis) AS bases, min(basis) AS only_basis FROM based WHERE source = 'failure_event' GROUP BY 1),
ordered AS (SELECT b.*, bases, only_basis, row_number() OVER (PARTITION BY b.artifact_id ORDER BY
  CASE WHEN bases > 1 THEN 0 WHEN ts IS NOT NULL THEN 0 WHEN seq IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN bases > 1 THEN 0 ELSE coalesce(ts, 0) END,
  CASE WHEN bases > 1 THEN 0 ELSE coalesce(seq, 0) END, i) - 1 AS position FROM based b JOIN spread s USING (artifact_id))"""


@query("D02_timeline_order", sql=f"WITH {_TIMELINE} SELECT artifact_id, event_id, position, source FROM ordered")
def timeline(d: Data):
    return L.timeline_table(timelines(d)).select("artifact_id", "event_id", "position", "source")


@query("D01_timeline_union", sql=f"WITH {_TIMELINE} SELECT source, count(*) AS entries FROM ordered GROUP BY 1")
def union(d: Data):
    return L.timeline_table(timelines(d)).groupBy("source").agg(F.count(F.lit(1)).alias("entries"))


@query("D03_ordering_basis", sql=f"""WITH {_TIMELINE} SELECT artifact_id, event_id, basis, CASE WHEN bases > 1 THEN 'mixed' ELSE only_basis END AS overall,
 CASE basis WHEN 'sequence' THEN 'clock not available; ordered by sequence fallback' WHEN 'log_order' THEN 'no clock or sequence; ordered by source order' ELSE '' END AS uncertainty FROM ordered""")
def basis(d: Data):
    rows = timelines(d).select("artifact_id", F.col("ordering_basis").alias("overall"), F.inline(whole("entries")))
    return rows.select("artifact_id", "event_id", F.col("ordering_basis").alias("basis"), "overall", "uncertainty")


@query("D05_timeline_grouping", sql="""
SELECT artifact_id, CASE WHEN count(*) FILTER (WHERE linked) BETWEEN 1 AND count(*) - 1 THEN 'mixed' WHEN bool_or(linked) THEN 'runtime' ELSE 'pipeline' END AS grouping
FROM (SELECT artifact_id, line_no, CASE WHEN line_no = 0 THEN true ELSE trace_id <> '' END AS linked FROM {v_event_line}) GROUP BY 1""")
def grouping(d: Data):
    return timelines(d).select("artifact_id", "grouping")


@query("D06_event_roles", sql="""
SELECT artifact_id, 'ev-001' AS primary_event_id, count(*) - 1 AS downstream, CASE WHEN CAST(substr(artifact_id, 2) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS recovery FROM {v_event_line} GROUP BY 1""")
def roles(d: Data):
    return timelines(d).select("artifact_id", "primary_event_id", F.size("downstream_event_ids").cast("bigint").alias("downstream"), F.size("recovery_event_ids").alias("recovery"))


VIEWS["v_release"] = """
SELECT event_id, 'svc' || CAST(user_id % 10 AS STRING) AS service, 'r' || CAST(event_id % 4 AS STRING) AS revision, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'c' || CAST(user_id % 2 AS STRING) END AS commit,
       CASE WHEN event_id % 2 = 0 THEN 'r' || CAST(user_id % 4 AS STRING) ELSE '' END AS previous_revision, CASE WHEN event_id % 5 = 0 THEN 'c1' ELSE '' END AS previous_commit, ts AS started_at
FROM {events}"""


@query("D07_release_compare", sql="""
SELECT event_id, CASE WHEN r OR c THEN coalesce(rd, false) OR coalesce(cd, false) END AS changed, concat_ws(',', CASE WHEN rd THEN 'revision' END, CASE WHEN cd THEN 'commit' END) AS fields FROM (
 SELECT event_id, previous_revision <> '' AS r, previous_commit <> '' AND commit <> '' AS c, previous_revision <> '' AND revision <> previous_revision AS rd, previous_commit <> '' AND commit <> '' AND commit <> previous_commit AS cd FROM {v_release})""")
def release(d: Data):
    return L.compare_releases(d.v_release).select("event_id", F.col("release_changed").alias("changed"), F.array_join("release_changed_fields", ",").alias("fields"))


@query("D08_release_changes", sql="""
SELECT event_id, 'revision' AS field, CASE WHEN revision <> previous_revision THEN 'changed' ELSE 'unchanged' END AS status FROM {v_release} WHERE previous_revision <> ''
UNION ALL SELECT event_id, 'commit', CASE WHEN commit = '' THEN 'unknown' WHEN commit <> previous_commit THEN 'changed' ELSE 'unchanged' END FROM {v_release} WHERE previous_commit <> ''""")
def changes(d: Data):
    return L.release_changes(d.v_release, "event_id").select("event_id", "field", "status")


@query("D08b_previous_release", sql="SELECT event_id, coalesce(lag(revision) OVER (PARTITION BY service ORDER BY started_at, event_id), '') AS previous_revision FROM {v_release}")
def previous(d: Data):
    rows = d.v_release.drop("previous_revision", "previous_commit")
    return L.previous_releases(rows, ["service"], ["started_at", "event_id"]).select("event_id", "previous_revision")


@query("D15_runbooks", sql="""
SELECT event_id, CASE WHEN user_id % 10 < 5 THEN 'https://runbook/svc' || CAST(user_id % 10 AS STRING) ELSE '' END AS runbook_url, CASE WHEN user_id % 10 < 5 THEN 'explicit_trusted_configuration' ELSE 'missing' END AS runbook_source FROM {events}""")
def runbooks(d: Data):
    table = d.nation.select(F.concat(F.when(F.col("n_nationkey") < 5, "svc").otherwise("old"), F.col("n_nationkey").cast("string")).alias("service"),
                                                     F.concat(F.lit("https://runbook/svc"), F.col("n_nationkey").cast("string")).alias("url"))
    return L.runbooks(d.v_release, table).select("event_id", "runbook_url", "runbook_source")


# ------------------------------------------------------------------ traces and metrics

@query("D04_parent_cycles", sql="SELECT trace_id, max(CASE WHEN span_id % 40 = 0 THEN 1 ELSE 0 END) = 1 AND count(*) = 4 AS has_cycle FROM {v_span} GROUP BY 1")
def cycles(d: Data):
    return TR.parent_cycles(d.v_span.withColumn("pos", F.col("span_id")))


_CHAIN = """
span AS (SELECT *, CASE WHEN trace_id % 10 = 0 THEN 1 ELSE 0 END AS cyclic FROM {v_span}),
pairs AS (SELECT a.trace_id, a.span_id AS leaf, b.span_id, b.start_ns, b.end_ns, b.service, a.cyclic FROM span a JOIN span b ON a.trace_id = b.trace_id AND (a.cyclic = 1 OR b.span_id <= a.span_id)),
lasting AS (SELECT trace_id, leaf, max(cyclic) = 1 AS cyc, max(end_ns) - min(CASE WHEN start_ns > 0 THEN start_ns END) AS dur FROM pairs GROUP BY 1, 2),
best AS (SELECT trace_id, arg_min(leaf, (-dur * 100000000 + leaf)) AS leaf, max(dur) AS duration_ns, bool_or(cyc) AS cycle_detected FROM lasting GROUP BY 1)"""


@query("D09_critical_path", sql=f"WITH {_CHAIN} SELECT * FROM best")
def critical(d: Data):
    return TR.critical_paths(d.v_span.withColumn("pos", F.col("span_id")))[0]


@query("D09_critical_path_spans", sql=f"WITH {_CHAIN} SELECT trace_id, span_id, CASE WHEN trace_id % 10 = 0 THEN (span_id - best.leaf + 3) % 4 ELSE span_id % 4 END AS position FROM best JOIN pairs USING (trace_id, leaf)")
def critical_spans(d: Data):
    return TR.critical_paths(d.v_span.withColumn("pos", F.col("span_id")))[1].select("trace_id", "span_id", "position")


@query("D10_services", sql="SELECT trace_id, string_agg(DISTINCT service, ',' ORDER BY service) AS services FROM {v_span} GROUP BY 1")
def services(d: Data):
    return TR.service_boundaries(d.v_span).select("trace_id", F.array_join("services", ",").alias("services"))


@query("D10_service_versions", sql="SELECT trace_id, service, arg_max(version, span_id) AS version FROM {v_span} GROUP BY 1, 2")
def versions(d: Data):
    return TR.service_versions(d.v_span)


VIEWS["v_deployment"] = """SELECT event_id AS deployment_id, event_type AS service, ts AS started_at, ts + INTERVAL 10 MINUTE AS finished_at FROM {events}"""
VIEWS["v_metric"] = """SELECT event_id, event_type AS service, 'm' || CAST(event_id % 3 AS STRING) AS metric, ts, floor(value) AS value FROM {events}"""


@query("D11_metric_window", sql="""
SELECT d.deployment_id, m.event_id FROM {v_deployment} d JOIN {v_metric} m ON m.service = d.service AND m.ts BETWEEN d.started_at - INTERVAL 15 MINUTE AND d.finished_at + INTERVAL 15 MINUTE""")
def window(d: Data):
    return TR.metric_window(d.v_deployment, d.v_metric).select("deployment_id", "event_id")


@query("D11b_metric_movement", sql="""
SELECT d.deployment_id, m.metric, sum(CASE WHEN m.ts < d.started_at THEN m.value END) / count(CASE WHEN m.ts < d.started_at THEN 1 END) AS mean_before,
 sum(CASE WHEN m.ts > d.finished_at THEN m.value END) / count(CASE WHEN m.ts > d.finished_at THEN 1 END) AS mean_after, count(*) AS samples FROM {v_deployment} d JOIN {v_metric} m ON m.service = d.service AND m.ts BETWEEN d.started_at - INTERVAL 15 MINUTE AND d.finished_at + INTERVAL 15 MINUTE GROUP BY 1, 2""")
def movement(d: Data):
    return TR.metric_movement(d.v_deployment, d.v_metric, ["deployment_id"]).select("deployment_id", "metric", "mean_before", "mean_after", "samples")


@query("D12_trace_lookup", sql="""
WITH ids AS (SELECT artifact_id, trace_id, min(line_no) AS p FROM {v_event_line} WHERE trace_id <> '' GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY p) AS rn FROM ids)
SELECT t.artifact_id, t.trace_id, e.event_id AS span FROM top t JOIN {events} e ON lpad(CAST(e.event_id AS STRING), 16, '0') = t.trace_id""")
def lookup(d: Data):
    logs = C.extract_events(C.classify_artifacts(_joined(d, d.v_event_line, "line_no", "line"))).select("artifact_id", "events")
    spans = d.events.select(F.lpad(F.col("event_id").cast("string"), 16, "0").alias("trace_id"), F.col("event_id").alias("span"))
    return TR.trace_lookup(logs, spans).select("artifact_id", "trace_id", "span")


@query("D13_span_duration", sql="""SELECT span_id, CASE WHEN start_ns > 0 THEN greatest(end_ns - start_ns, 0) ELSE 0 END AS duration_ns, CASE CAST(span_id % 4 AS INT) WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'unknown' ELSE 'UNSET' END AS status FROM {v_span}""")
def durations(d: Data):
    code = F.when(F.col("span_id") % 4 == 0, "STATUS_CODE_OK").when(F.col("span_id") % 4 == 1, "2").when(F.col("span_id") % 4 == 3, "STATUS_CODE_UNSET")
    return d.v_span.select("span_id", TR.span_duration(F.col("start_ns"), F.col("end_ns")).alias("duration_ns"), TR.span_status(code).alias("status"))


# ------------------------------------------------------------------ impact

VIEWS["v_test_file"] = """
SELECT 'tests/test_' || CAST(o_custkey AS STRING) || '.py' AS path, 'import mod' || CAST(o_custkey % 40 AS STRING) || chr(10) || 'def t(): return fn_' || CAST(o_custkey % 60 AS STRING) || '(a-b)' AS text FROM (SELECT DISTINCT o_custkey FROM {orders})"""
VIEWS["v_source"] = """SELECT DISTINCT 'src/mod' || CAST(s_suppkey % 45 AS STRING) || '.py' AS file, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'fn_' || CAST(s_suppkey % 70 AS STRING) END AS symbol FROM {supplier}"""
_RELATED = """SELECT file, symbol, path, row_number() OVER (PARTITION BY file, symbol ORDER BY path) AS rank FROM (
 SELECT DISTINCT s.file, s.symbol, t.path FROM {v_source} s JOIN {v_test_file} t ON contains(t.text, replace(substr(s.file, 5), '.py', '')) OR (s.symbol <> '' AND contains(t.text, s.symbol)))"""


@query("X01_related_tests", sql=_RELATED)
def related(d: Data):
    return M.related_tests(d.v_source, d.v_test_file)


VIEWS["v_call"] = """SELECT DISTINCT 'src/m.py' AS file, 'fn_' || CAST(l_partkey % 60 AS STRING) AS caller, 'fn_' || CAST(l_suppkey % 80 AS STRING) AS callee FROM {lineitem}"""
VIEWS["v_symbol"] = """SELECT DISTINCT 'src/f' || CAST(o_custkey % 20 AS STRING) || '.py' AS file, 'fn_' || CAST(o_orderkey % 60 AS STRING) AS name, o_orderkey % 60 AS start_line, o_orderkey % 60 + o_custkey % 4 * 9 AS end_line FROM {orders}"""
_EDGES = """
direct AS (SELECT DISTINCT file, caller, callee FROM {v_call} WHERE callee IN (SELECT name FROM {v_symbol})),
edges AS (SELECT caller, callee, min(depth) AS depth FROM (SELECT caller, callee, 1 AS depth FROM direct UNION ALL SELECT a.caller, b.callee, 2 FROM direct a JOIN direct b ON a.callee = b.caller) WHERE caller <> callee GROUP BY 1, 2)"""


@query("X02_call_edges", sql=f"WITH {_EDGES} SELECT * FROM edges")
def edges(d: Data):
    return M.call_edges(d.v_call, d.v_symbol).select("caller", "callee", "depth")


def _change_sources(d: Data):
    return d.v_source.select((F.length("symbol") % 3).alias("change_id"), "file", "symbol", F.col("file").endswith("1.py").alias("changed"))


def _recommended(d: Data, limit: int | None = None):
    sources = _change_sources(d)
    related = sources.select("change_id", "file", "symbol").join(M.related_tests(d.v_source, d.v_test_file).withColumnRenamed("path", "test").drop("rank"), ["file", "symbol"])
    coverage = d.nation.select(F.concat(F.lit("src/mod"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("key"), F.concat(F.lit("tests/test_"), (F.col("n_nationkey") * 7).cast("string"), F.lit(".py")).alias("test"))
    history = d.customer.select(
        F.concat(F.lit("tests/test_"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("test"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 4 / F.lit(2.0)).otherwise(0.0).alias("correlation"))
    return M.recommend_tests(sources, related, M.call_edges(d.v_call, d.v_symbol), coverage, history, limit=limit)


_RECOMMEND = f"""
WITH {_EDGES}, rel AS ({_RELATED}),
src AS (SELECT length(symbol) % 3 AS change_id, file, symbol, file LIKE '%1.py' AS changed FROM {{v_source}}),
moved AS (SELECT DISTINCT change_id, symbol FROM src WHERE changed AND symbol <> ''),
dep AS (SELECT DISTINCT change_id, callee AS symbol FROM moved JOIN edges ON caller = symbol UNION SELECT DISTINCT change_id, caller FROM moved JOIN edges ON callee = symbol),
scored AS (
 SELECT change_id, path AS test, 100.0::DOUBLE AS score FROM src JOIN rel USING (file, symbol)
 UNION ALL SELECT change_id, 'tests/test_' || CAST(n_nationkey * 7 AS STRING) || '.py', 70 FROM src JOIN {{nation}} ON file = 'src/mod' || CAST(n_nationkey AS STRING) || '.py'
 UNION ALL SELECT src.change_id, path, 50 FROM src JOIN rel USING (file, symbol) JOIN dep ON dep.change_id = src.change_id AND dep.symbol = src.symbol),
tot AS (SELECT change_id, test, sum(score) AS score, count(*) AS reasons FROM scored GROUP BY 1, 2),
fin AS (SELECT change_id, test, score + CASE WHEN c_custkey % 5 = 0 AND c_custkey % 4 > 0 THEN least(c_custkey % 4 / 2.0, 1) * 20 ELSE 0 END AS s0, score, reasons, c_custkey FROM tot LEFT JOIN {{customer}} ON test = 'tests/test_' || CAST(c_custkey AS STRING) || '.py'),
ranked AS (SELECT change_id, test, CAST(coalesce(s0, score) AS DOUBLE) AS score, row_number() OVER (PARTITION BY change_id ORDER BY coalesce(s0, score) DESC, test) AS rank FROM fin)"""


@query("X03_test_recommendations", sql=_RECOMMEND + " SELECT change_id, test, score, rank FROM ranked")
def recommend(d: Data):
    return _recommended(d).select("change_id", "test", "score", "rank")


@query("X04_recommendation_recall", sql=_RECOMMEND + """
SELECT change_id, round_even(CAST(count(*) FILTER (WHERE rank <= 20) AS DOUBLE) / count(*), 6) AS recall FROM (SELECT DISTINCT change_id, path AS test FROM src JOIN rel USING (file, symbol)) e LEFT JOIN (SELECT * FROM ranked WHERE rank <= 20) r USING (change_id, test) GROUP BY 1""")
def recall(d: Data):
    sources = _change_sources(d)
    expected = sources.join(M.related_tests(d.v_source, d.v_test_file), ["file", "symbol"]).select("change_id", F.col("path").alias("test"))
    return M.recommendation_recall(_recommended(d, 20), expected)


@query("E09_impact_recall", sql=_RECOMMEND + """,
r AS (SELECT change_id, round_even(CAST(count(*) FILTER (WHERE rank <= 20) AS DOUBLE) / count(*), 6) AS recall FROM (SELECT DISTINCT change_id, path AS test FROM src JOIN rel USING (file, symbol)) e LEFT JOIN ranked USING (change_id, test) GROUP BY 1)
SELECT change_id, recall, recall >= 0.9 AS passed FROM r""")
def impact_recall(d: Data):
    """The gate on recall of the first twenty recommendations of each change."""
    return recall(d).withColumn("passed", F.col("recall") >= 0.9)


_NARROW = """
narrow AS (SELECT f.artifact_id, f.pos, f.file, f.line, arg_min(s.name, (s.end_line - s.start_line) * 1000000 + s.start_line * 100 + CAST(substr(s.name, 4) AS INT)) AS symbol FROM {v_simple_frame} f JOIN {v_symbol} s ON s.file = f.file AND f.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2, 3, 4)"""


@query("X05_enclosing_symbol", sql=f"WITH {_NARROW} SELECT artifact_id, pos, symbol FROM narrow")
def enclosing(d: Data):
    return M.enclosing_symbols(d.v_simple_frame.select("artifact_id", "pos", "file", "line"), d.v_symbol).select("artifact_id", "pos", "symbol")


@query("X06_source_evidence", sql=f"""WITH {_NARROW},
first_frame AS (SELECT artifact_id, file, min(pos) AS pos FROM {{v_simple_frame}} GROUP BY 1, 2),
latest AS (SELECT path, arg_max(subject, ts * 1000000000 + CAST(substr(sha, 4) AS BIGINT)) AS subject FROM {{v_commit}} GROUP BY 1),
hit AS (SELECT h.artifact_id, h.file, arg_min(subject, h.path) AS commit FROM ({_HITS}) h LEFT JOIN latest l ON l.path = h.path GROUP BY 1, 2)
SELECT f.artifact_id, f.file, s.line, coalesce(n.symbol, '') AS symbol, h.file IS NOT NULL AS changed, coalesce(h.commit, '') AS commit,
 CASE WHEN f.file = 'src/f2.py' THEN '@two' WHEN f.file LIKE 'src/f1%' THEN '@ones @more' ELSE '@all' END AS owners
FROM first_frame f JOIN {{v_simple_frame}} s USING (artifact_id, file, pos) LEFT JOIN narrow n USING (artifact_id, file, pos) LEFT JOIN hit h ON h.artifact_id = f.artifact_id AND h.file = f.file""")
def source_evidence(d: Data):
    frames = d.v_simple_frame.select("*", _scope())
    rows = M.source_evidence(frames, d.v_symbol, d.v_changed_file, _owner_rules(d), d.v_commit)
    return rows.withColumn("owners", F.array_join("owners", " "))
