"""Incident queries over occurrences derived from orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.operators import incidents as I

# Customer 0's orders take a third of all occurrences: one hot incident.
VIEWS["v_occurrence"] = """
SELECT o_orderkey AS artifact_id, o_orderdate AS ts,
       'key' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 200 END AS STRING) AS dedup_key,
       CASE WHEN o_custkey % 11 = 0 THEN 'unknown' WHEN o_custkey % 2 = 0 THEN 'timeout' ELSE 'test_failure' END AS kind,
       'message ' || CAST(o_orderkey AS STRING) AS message
FROM {orders}"""
VIEWS["v_incident"] = """
SELECT 'key' || CAST(c_custkey AS STRING) AS key, CASE WHEN c_custkey % 2 = 0 THEN 'timeout' ELSE 'test_failure' END AS kind,
       'm' || CAST(c_custkey AS STRING) AS message, 'comp' || CAST(c_custkey % 5 AS STRING) AS component, 't' AS title,
       CAST(c_custkey % 6 + 1 AS BIGINT) AS count, c_custkey % 4 = 0 AS filed, c_custkey * 100 AS last_seen,
       'ctx' || CAST(c_custkey % 3 AS STRING) AS context_fingerprint,
       CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'snapshot' || CAST(c_custkey AS STRING) END AS root_cause,
       CASE WHEN c_custkey % 5 = 0 THEN 'p:m2' ELSE 'p:m1' END AS model
FROM {customer}"""
VIEWS["v_feedback"] = """
SELECT o_orderkey AS feedback_id, 'run' || CAST(o_orderkey % 400 AS STRING) AS run_id, 'key' || CAST(o_custkey % 300 AS STRING) AS dedup_key,
       'sha' || CAST(o_orderkey % 5 AS STRING) AS report_sha256, CASE WHEN o_orderkey % 4 = 0 THEN 'reviewed' ELSE 'pending' END AS review_status,
       CASE WHEN o_orderkey % 6 < 4 THEN 'useful' ELSE 'not_useful' END AS usefulness,
       CASE WHEN o_orderkey % 5 < 3 THEN 'resolved' ELSE 'unresolved' END AS actual_outcome,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'flaky' END AS actual_kind,
       CASE WHEN o_custkey % 2 = 0 THEN 'timeout' ELSE 'flaky' END AS predicted_kind, 'high' AS predicted_severity,
       CASE WHEN o_orderkey % 3 = 0 THEN 'low' END AS actual_severity, 'team' AS actual_owner,
       CASE WHEN o_orderkey % 3 = 0 THEN 'correct' WHEN o_orderkey % 3 = 1 THEN 'incorrect' ELSE 'unknown' END AS kind_correct,
       o_orderkey % 1000 AS created_at
FROM {orders}"""


@query("I01_noise_normalization", sql="""
SELECT event_id, 'Boom u' || CAST(user_id AS STRING) || ' in /x/a.py done' AS clean FROM {events}""")
def noise(d: Data):
    text = F.concat(
        F.lit("2024-01-02T03:04:05Z Boom  u"), F.col("user_id").cast("string"), F.lit(" /tmp/run-"),
        F.col("event_id").cast("string"), F.lit(" in /x/a.py:"), F.col("event_id").cast("string"), F.lit(":3 done"))
    return d.events.select("event_id", I.normalize_noise(text, preserve_case=True).alias("clean"))


@query("I02_assertion_identity", sql="""
SELECT user_id, CAST(count(DISTINCT CASE WHEN event_id % 4 = 3 THEN 3 ELSE 0 END) AS BIGINT) AS identities, count(*) AS n FROM {events} GROUP BY 1""")
def identity(d: Data):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("assert ["), u, F.lit(", 1] == {'a': 2}")))
        .when(k == 1, F.concat(F.lit("E  AssertionError: expected {'a': 2}, got ["), u, F.lit(",1]")))
        .when(k == 2, F.concat(F.lit("assert ["), u, F.lit(",1]=={'a':2}")))
        .otherwise(F.concat(F.lit("assert f("), u, F.lit(") == 1")))
    )
    rows = d.events.select("user_id", I.assertion_identity(text).alias("identity"))
    return rows.groupBy("user_id").agg(F.countDistinct("identity").alias("identities"), F.count(F.lit(1)).alias("n"))


@query("I03_fingerprint", sql="""
SELECT count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 'n' || CAST(user_id % 10 AS STRING) ELSE 'm' || CAST(user_id % 20 AS STRING) END) AS fingerprints, count(*) AS artifacts FROM {events}""")
def fingerprints(d: Data):
    base = d.events.select(
        F.col("event_id").alias("artifact_id"), "user_id", F.lit("repo").alias("project_scope"), F.lit("test").alias("stage"),
        F.lit("test_failure").alias("kind"),
        F.concat(F.lit("boom "), (F.col("user_id") % 20).cast("string"), F.lit(" /tmp/x"), F.col("event_id").cast("string")).alias("message"))
    tests = base.filter(F.col("user_id") % 3 == 0).select(
        "artifact_id", F.lit("a.py").alias("file"), F.lit("t").alias("name"),
        F.when(F.col("artifact_id") % 2 == 0, F.concat(F.lit("assert 1 == "), (F.col("user_id") % 10).cast("string")))
        .otherwise(F.concat(F.lit("expected "), (F.col("user_id") % 10).cast("string"), F.lit(", got 1"))).alias("assertion"))
    frames = base.filter(F.col("user_id") % 3 != 0).select(
        "artifact_id", F.lit(0).alias("pos"), F.lit("b.py").alias("file"), F.lit(None).cast("string").alias("function"))
    rows = I.fingerprint(base, tests, frames)
    return rows.agg(F.countDistinct("dedup_key").alias("fingerprints"), F.count(F.lit(1)).alias("artifacts"))


@query("I04_context_fingerprint", sql="""
SELECT key, CASE WHEN root_cause = '' THEN '' ELSE 'rca-context-v1:' || sha256(concat_ws(chr(29), key, message, root_cause, model, 'p1', '')) END AS context FROM {v_incident}""")
def context(d: Data):
    return d.v_incident.select("key", I.context_fingerprint(
        F.col("key"), F.col("message"), F.col("root_cause"), F.col("model"), F.lit("p1")).alias("context"))


@query("I05_recurrence", sql="""
SELECT artifact_id, dedup_key, CASE WHEN kind = 'unknown' THEN 1 ELSE n END AS occurrence_count,
       CASE WHEN kind <> 'unknown' AND n > 1 THEN dedup_key END AS is_duplicate_of, kind <> 'unknown' AND n >= 3 AS recurring
FROM (SELECT o.*, coalesce(CASE WHEN CAST(substr(dedup_key, 4) AS BIGINT) % 2 = 0 THEN 2 END, 0) + row_number() OVER (PARTITION BY dedup_key, kind = 'unknown' ORDER BY ts, artifact_id) AS n FROM {v_occurrence} o)""")
def recurrence(d: Data):
    store = d.v_occurrence.select(F.col("dedup_key").alias("key")).distinct().filter(
        F.substring("key", 4, 9).cast("bigint") % 2 == 0).withColumn("count", F.lit(2))
    rows = I.recurrence(d.v_occurrence, ["ts", "artifact_id"], store)
    return rows.select("artifact_id", "dedup_key", "occurrence_count", "is_duplicate_of", "recurring")


@query("I06_prune", sql="""
SELECT key FROM (SELECT * FROM {v_incident} WHERE NOT (filed AND last_seen < 20000)) ORDER BY filed, last_seen DESC, key DESC LIMIT 500""")
def prune(d: Data):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda seconds: F.timestamp_add("SECOND", seconds.cast("int"), base)
    rows = d.v_incident.withColumn("last_seen", at(F.col("last_seen")))
    return I.prune(rows, F.timestamp_add("DAY", F.lit(90), at(F.lit(20000))), 90, 500).select("key")


@query("I07_list_incidents", sql="""
SELECT key, kind, count, last_seen FROM {v_incident} WHERE kind = 'timeout' AND NOT filed ORDER BY last_seen DESC, key DESC LIMIT 50""")
def listing(d: Data):
    return I.list_incidents(d.v_incident, "timeout", False, 50).select("key", "kind", "count", "last_seen")


@query("I08_lookup", sql="SELECT key, count FROM {v_incident} WHERE key IN (SELECT DISTINCT dedup_key FROM {v_occurrence})")
def lookup(d: Data):
    return I.lookup(d.v_incident, d.v_occurrence.select(F.col("dedup_key").alias("key"))).select("key", "count")


_KNOWN = """
SELECT dedup_key, feedback_id FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY created_at DESC, feedback_id DESC) AS rn FROM {v_feedback}
 WHERE review_status = 'reviewed' AND usefulness IN ('useful', 'partial') AND actual_outcome IN ('root_cause_confirmed', 'resolved'))
WHERE rn = 1 AND report_sha256 <> 'sha0'"""


def _known(d: Data):
    reports = d.v_feedback.select("run_id", "report_sha256", "dedup_key").filter("report_sha256 <> 'sha0'").distinct()
    return I.known_issues(d.v_feedback, reports)


@query("I09_reuse_decision", sql=f"""
WITH known AS ({_KNOWN}), cur AS (SELECT o_orderkey AS id, 'key' || CAST(o_custkey AS STRING) AS dedup_key, 'ctx' || CAST(o_orderkey % 3 AS STRING) AS ctx, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE 'timeout' END AS kind FROM {{orders}})
SELECT id, CASE WHEN cur.kind = 'unknown' OR s.key IS NULL OR cur.ctx <> s.context_fingerprint OR s.root_cause = '' THEN 'fresh'
  WHEN k.dedup_key IS NOT NULL THEN 'known_issue' WHEN s.count >= 3 AND s.model = 'p:m1' THEN 'stored_snapshot' ELSE 'fresh' END AS reuse
FROM cur LEFT JOIN {{v_incident}} s ON s.key = cur.dedup_key LEFT JOIN known k ON k.dedup_key = cur.dedup_key""")
def reuse(d: Data):
    current = d.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("key"), F.col("o_custkey").cast("string")).alias("dedup_key"),
        F.concat(F.lit("ctx"), (F.col("o_orderkey") % 3).cast("string")).alias("context_fingerprint"),
        F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise("timeout").alias("kind"), F.lit("p:m1").alias("model"))
    return I.reuse_decision(current, d.v_incident, 3, _known(d)).select("id", "reuse")


@query("I10_invalidate", sql="""
SELECT key, count, CASE WHEN component = 'comp1' THEN '' ELSE root_cause END AS root_cause, CASE WHEN component = 'comp1' THEN '' ELSE context_fingerprint END AS context_fingerprint FROM {v_incident}""")
def invalidate(d: Data):
    rows = I.invalidate(d.v_incident, d.v_incident.filter("component = 'comp1'"))
    return rows.select("key", "count", "root_cause", "context_fingerprint")


@query("I11_known_issues", sql=_KNOWN)
def known(d: Data):
    return _known(d).select("dedup_key", "feedback_id")


@query("I12_record_triage", sql="""
WITH t AS (SELECT 'key' || CAST(s_suppkey * 20 AS STRING) AS key, 'newcomp' AS component, CASE WHEN s_suppkey % 2 = 0 THEN 'rc' ELSE '' END AS rc FROM {supplier})
SELECT coalesce(i.key, t.key) AS key, coalesce(t.component, i.component) AS component, coalesce(i.count, 1) AS count,
       CASE WHEN t.rc <> '' THEN t.rc ELSE coalesce(i.root_cause, '') END AS root_cause,
       CASE WHEN t.rc <> '' THEN 'c9' WHEN t.key IS NOT NULL THEN '' ELSE i.context_fingerprint END AS context_fingerprint
FROM {v_incident} i FULL JOIN t ON i.key = t.key""")
def record(d: Data):
    triage = d.supplier.select(
        F.concat(F.lit("key"), (F.col("s_suppkey") * 20).cast("string")).alias("key"), F.lit("newcomp").alias("component"),
        F.lit("title").alias("title"), F.lit("timeout").alias("kind"),
        F.when(F.col("s_suppkey") % 2 == 0, "rc").otherwise("").alias("root_cause"), F.lit("c9").alias("context_fingerprint"),
        F.lit(1).cast("bigint").alias("last_seen"))
    return I.record_triage(d.v_incident, triage).select("key", "component", "count", "root_cause", "context_fingerprint")


@query("I13_delivered", sql="""
SELECT key, filed OR (component = 'comp2') AS github, component = 'comp3' AS slack FROM {v_incident}""")
def delivered(d: Data):
    rows = d.v_incident.withColumn("deliveries", F.when(F.col("component") == "comp2", F.create_map(F.lit("github"), F.lit("u")))
                                   .when(F.col("component") == "comp3", F.create_map(F.lit("slack"), F.lit("u"))))
    slack = I.already_delivered(rows, "slack").select("key", F.col("delivered").alias("slack"))
    return I.already_delivered(rows, "github").select("key", F.col("delivered").alias("github")).join(slack, "key")


@query("K04_incident_state", sql="""
WITH b AS (SELECT dedup_key AS key, count(*) AS n, arg_min(message, artifact_id + epoch_us(ts)) AS m FROM {v_occurrence} WHERE kind <> 'unknown' GROUP BY 1)
SELECT coalesce(i.key, b.key) AS key, coalesce(i.count, 0) + coalesce(b.n, 0) AS count, coalesce(i.message, b.m) AS message
FROM {v_incident} i FULL JOIN b ON i.key = b.key""")
def state(d: Data):
    batch = I.incident_state(d.v_occurrence, ["ts", "artifact_id"])
    store = d.v_incident.withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("last_seen", F.lit(None).cast("timestamp_ntz"))
    return I.merge_state(store, batch.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn(
        "last_seen", F.col("last_seen").cast("timestamp_ntz"))).select("key", "count", "message")
