"""Evaluation, corpus audit and report checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.operators import evaluate as E
from faultlens.operators.triage import HYPOTHESIS_BY_KIND


@query("E01_label_metrics", sql="""
WITH l AS (SELECT label, count(*) FILTER (WHERE expected = label) AS support, count(*) FILTER (WHERE predicted = label) AS named, count(*) FILTER (WHERE expected = label AND predicted = label) AS tp
 FROM {v_prediction}, (VALUES ('good'), ('bad'), ('none')) AS t(label) GROUP BY 1)
SELECT label, support, CASE WHEN named > 0 THEN round_even(CAST(tp AS DOUBLE) / named, 6) ELSE 0 END AS precision, CASE WHEN support > 0 THEN round_even(CAST(tp AS DOUBLE) / support, 6) ELSE 0 END AS recall FROM l""")
def labels(d: Data):
    return E.label_metrics(d.v_prediction, labels=["none", "good"])


@query("E01_macro_metrics", sql="""
WITH l AS (SELECT label, count(*) FILTER (WHERE expected = label) AS support, count(*) FILTER (WHERE predicted = label) AS named, count(*) FILTER (WHERE expected = label AND predicted = label) AS tp
 FROM {v_prediction}, (VALUES ('good'), ('bad')) AS t(label) GROUP BY 1)
SELECT round_even(avg(round_even(CAST(tp AS DOUBLE) / named, 6)), 6) AS macro_precision, round_even(avg(round_even(CAST(tp AS DOUBLE) / support, 6)), 6) AS macro_recall FROM l WHERE support > 0""")
def macro(d: Data):
    return E.macro_metrics(E.label_metrics(d.v_prediction))


@query("E01_accuracy", sql="SELECT round_even(CAST(count(*) FILTER (WHERE expected = predicted) AS DOUBLE) / count(*), 6) AS accuracy FROM {v_prediction}")
def accuracy(d: Data):
    return E.accuracy(d.v_prediction)


@query("E02_set_metrics", sql="""
WITH e AS (SELECT DISTINCT o_custkey AS c, 't' || CAST(o_orderkey % 30 AS STRING) AS k FROM {orders} WHERE o_orderkey % 2 = 0), p AS (SELECT DISTINCT o_custkey AS c, 't' || CAST(o_orderkey % 30 AS STRING) AS k FROM {orders} WHERE o_orderkey % 3 = 0),
n AS (SELECT (SELECT count(*) FROM e JOIN p USING (c, k)) AS tp, (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM p) AS np)
SELECT tp, np - tp AS fp, ne - tp AS fn, round_even(CAST(tp AS DOUBLE) / np, 6) AS precision, round_even(CAST(tp AS DOUBLE) / ne, 6) AS recall FROM n""")
def sets(d: Data):
    name = F.concat(F.lit("a\\b.py::t"), (F.col("o_orderkey") % 30).cast("string"))
    rows = d.orders.select("o_orderkey", F.col("o_custkey").alias("c"), E.test_key(name).alias("k"))
    return E.set_metrics(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 3 = 0"), ["c", "k"])


VIEWS["v_dup"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'hot' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'g' || CAST(o_custkey % 50 AS STRING) END AS duplicate_group,
 CASE WHEN o_orderkey % 3 = 0 THEN 'fp-hot' ELSE 'fp' || CAST(o_custkey % 60 AS STRING) END AS dedup_key FROM {orders}"""


@query("E03_dedup_metrics", sql="""
WITH p AS (SELECT sum(CAST(n AS BIGINT) * (n - 1) // 2) AS pred FROM (SELECT count(*) AS n FROM {v_dup} GROUP BY dedup_key)), e AS (SELECT sum(CAST(n AS BIGINT) * (n - 1) // 2) AS exp FROM (SELECT count(*) AS n FROM {v_dup} WHERE duplicate_group IS NOT NULL GROUP BY duplicate_group)),
t AS (SELECT sum(CAST(n AS BIGINT) * (n - 1) // 2) AS tp FROM (SELECT count(*) AS n FROM {v_dup} WHERE duplicate_group IS NOT NULL GROUP BY duplicate_group, dedup_key))
SELECT CAST(tp AS BIGINT) AS tp, CAST(pred - tp AS BIGINT) AS fp, CAST(exp - tp AS BIGINT) AS fn, round_even(CAST(tp AS DOUBLE) / pred, 6) AS precision, round_even(CAST(tp AS DOUBLE) / exp, 6) AS recall FROM t, p, e""")
def dedup(d: Data):
    return E.dedup_metrics(d.v_dup)


VIEWS["v_case_result"] = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 5 = 1 THEN true END AS is_failure, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'timeout' END AS expected,
 CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE 'timeout' END AS predicted, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'medium' END AS band, (event_id % 8) / 8.0::DOUBLE AS score FROM {events}"""


@query("E05_failure_detection", sql="""
WITH c AS (SELECT count(*) FILTER (WHERE NOT is_failure) AS healthy_support, count(*) FILTER (WHERE coalesce(is_failure, expected <> 'unknown')) AS failure_support,
 count(*) FILTER (WHERE NOT is_failure AND predicted <> 'unknown') AS false_positives, count(*) FILTER (WHERE coalesce(is_failure, expected <> 'unknown') AND predicted = 'unknown') AS missed_failures FROM {v_case_result})
SELECT *, round_even(CAST(false_positives AS DOUBLE) / healthy_support, 6) AS false_positive_rate, round_even(CAST(failure_support - missed_failures AS DOUBLE) / failure_support, 6) AS recall FROM c""")
def detection(d: Data):
    return E.failure_detection(d.v_case_result)


@query("E06_calibration", sql="""
SELECT b.band, count(r.band) AS support, CASE WHEN count(r.band) > 0 THEN round_even(CAST(count(*) FILTER (WHERE r.expected = r.predicted) AS DOUBLE) / count(r.band), 6) END AS empirical_accuracy,
 round_even(avg(score), 6) AS mean_evidence_completeness FROM (VALUES ('high'), ('medium'), ('low')) AS b(band) LEFT JOIN {v_case_result} r ON r.band = b.band GROUP BY 1""")
def calibration(d: Data):
    return E.calibration(d.v_case_result.withColumn("correct", F.col("expected") == F.col("predicted")))


@query("E07_threshold_gate", sql="""
WITH m AS (SELECT 'mean.' || band AS path, avg(score) AS value FROM {v_case_result} GROUP BY 1), t AS (SELECT * FROM (VALUES ('mean.low', 'minimum', 0.9::DOUBLE), ('mean.medium', 'maximum', 0.9::DOUBLE), ('mean.high', 'minimum', 0.1::DOUBLE)) AS x(path, direction, threshold))
SELECT path, direction, threshold, coalesce(CASE WHEN direction = 'minimum' THEN value >= threshold ELSE value <= threshold END, false) AS passed,
 CASE WHEN value IS NULL THEN 'no supported measurement' WHEN CASE WHEN direction = 'minimum' THEN value < threshold ELSE value > threshold END THEN 'violates ' || direction ELSE '' END AS reason FROM t LEFT JOIN m USING (path)""")
def thresholds(d: Data):
    metrics = d.v_case_result.groupBy(F.concat(F.lit("mean."), "band").alias("path")).agg(F.avg("score").alias("value"))
    limits = d.spark.createDataFrame([("mean.low", "minimum", 0.9), ("mean.medium", "maximum", 0.9), ("mean.high", "minimum", 0.1)], "path string, direction string, threshold double")
    return E.threshold_gate(metrics, limits).drop("value")


VIEWS["v_corpus"] = """
SELECT 'case' || CAST(CASE WHEN event_id % 100 = 7 THEN event_id - 1 ELSE event_id END AS STRING) AS case_id, event_id, 'artifacts/c' || CAST(event_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN '.log' ELSE '.XML' END AS path,
 'raw' || CAST(CASE WHEN event_id % 50 = 3 THEN 3 ELSE event_id END AS STRING) AS raw_sha256, 'src' || CAST(event_id % 4 AS STRING) AS source_id, CASE WHEN event_id % 9 = 0 THEN 'GPL-3.0' ELSE 'MIT' END AS license, CASE WHEN event_id % 3 = 0 THEN 'real' ELSE 'dev' END AS split,
 CASE WHEN event_id % 11 = 0 THEN 'mail a@b.co end' ELSE 'error in step ' || CAST(event_id AS STRING) END AS text, event_id % 13 = 0 AS bad_digest, event_id % 17 = 0 AS bad_span FROM {events}"""


def _corpus(d: Data):
    rows = d.v_corpus.withColumn("sanitized_sha256", F.when(F.col("bad_digest"), "x").otherwise(F.sha2("text", 256)))
    span = F.struct(F.lit(0).alias("start"), F.when(F.col("bad_span"), 4).otherwise(5).alias("end"), F.substring("text", 1, 5).alias("text"))
    sources = d.region.select(F.concat(F.when(F.col("r_regionkey") < 3, "src").otherwise("other"), F.col("r_regionkey").cast("string")).alias("source_id"), F.lit("MIT").alias("license"))
    return rows.withColumn("spans", F.array(span)), sources


@query("E10_corpus_audit", sql="""
SELECT case_id, violation FROM (
 SELECT case_id, event_id, 'license_not_approved' AS violation FROM {v_corpus} WHERE license = 'GPL-3.0'
 UNION ALL SELECT case_id, event_id, 'source_not_declared' FROM {v_corpus} WHERE source_id = 'src3'
 UNION ALL SELECT case_id, event_id, 'license_differs_from_source' FROM {v_corpus} WHERE source_id <> 'src3' AND license <> 'MIT'
 UNION ALL SELECT case_id, event_id, 'sanitized_sha256_mismatch' FROM {v_corpus} WHERE bad_digest
 UNION ALL SELECT case_id, event_id, 'residual_sensitive_match' FROM {v_corpus} WHERE event_id % 11 = 0
 UNION ALL SELECT case_id, event_id, 'invalid_spans' FROM {v_corpus} WHERE bad_span
 UNION ALL SELECT case_id, event_id, 'duplicate_case_id' FROM {v_corpus} WHERE case_id IN (SELECT case_id FROM {v_corpus} GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT case_id, event_id, 'duplicate_raw_sha256' FROM {v_corpus} WHERE raw_sha256 IN (SELECT raw_sha256 FROM {v_corpus} GROUP BY 1 HAVING count(*) > 1))""")
def audit(d: Data):
    return E.audit_manifest(*_corpus(d))


@query("E11_corpus_coverage", sql="""
SELECT 'source' AS dimension, source_id AS value, count(*) AS n FROM {v_corpus} GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM {v_corpus} GROUP BY 2
UNION ALL SELECT 'format', CASE WHEN event_id % 2 = 0 THEN 'log' ELSE 'xml' END, count(*) FROM {v_corpus} GROUP BY 2 UNION ALL SELECT 'license', license, count(*) FROM {v_corpus} GROUP BY 2""")
def coverage(d: Data):
    return E.corpus_coverage(d.v_corpus)


VIEWS["v_report"] = """
SELECT 'run' || CAST(event_id AS STRING) AS run_id, event_id, event_id % 50 <> 1 AS readable, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS violations, CASE WHEN event_id % 4 = 0 THEN '1.4' ELSE '2.0' END AS schema_version,
 event_id % 8 = 0 AS has_cycles, event_id % 5 AS entries, CASE WHEN event_id % 2 = 0 THEN 'kubernetes' ELSE '' END AS platform, 'api' AS target, event_id % 7 AS metric_samples, 0 AS trace_spans, event_id % 3 AS source_evidence,
 event_id % 6 AS a, event_id % 10 AS s FROM {events}"""
_CHECKS = """
SELECT run_id, 'digest_integrity' AS name, CASE WHEN readable THEN 'PASS' ELSE 'FAIL' END AS status FROM {v_report}
UNION ALL SELECT run_id, 'schema_compliance', CASE WHEN violations > 0 THEN 'FAIL' WHEN schema_version = '2.0' THEN 'PASS' ELSE 'WARN' END FROM {v_report}
UNION ALL SELECT run_id, 'trust_profile', CASE WHEN s = 0 THEN 'WARN' WHEN s IN (1, 2) THEN 'FAIL' ELSE 'PASS' END FROM {v_report}
UNION ALL SELECT run_id, 'timeline_causality', CASE WHEN has_cycles OR entries = 0 THEN 'WARN' ELSE 'PASS' END FROM {v_report}
UNION ALL SELECT run_id, 'deployment_context', CASE WHEN platform <> '' THEN 'PASS' ELSE 'WARN' END FROM {v_report}
UNION ALL SELECT run_id, 'connector_hygiene', CASE WHEN a = 0 THEN 'FAIL' WHEN a = 1 THEN 'PASS' WHEN platform <> '' THEN 'WARN' ELSE 'PASS' END FROM {v_report}
UNION ALL SELECT run_id, 'observability', CASE WHEN metric_samples > 0 OR platform = '' THEN 'PASS' ELSE 'WARN' END FROM {v_report}
UNION ALL SELECT run_id, 'source_evidence', CASE WHEN source_evidence > 0 THEN 'PASS' ELSE 'WARN' END FROM {v_report}"""


def _reports(d: Data):
    flag = lambda on: F.lit(on)
    trust = (
        F.when(F.col("s") == 1, F.struct(F.lit("martian").alias("source_class"), *[flag(False).alias(c) for c in E.CAPABILITIES]))
        .when(F.col("s") == 2, F.struct(F.lit("fork_pr").alias("source_class"), *[flag(c == "llm").alias(c) for c in E.CAPABILITIES]))
        .when(F.col("s") > 2, F.struct(F.lit("fork_pr").alias("source_class"), *[flag(False).alias(c) for c in E.CAPABILITIES])))
    audits = F.when(F.col("a") == 0, F.array(F.lit("ok"), F.lit("token: 'abcdef12'"))).when(F.col("a") == 1, F.array(F.lit("ok"))).otherwise(F.array().cast("array<string>"))
    return d.v_report.withColumn("trust", trust).withColumn("audits", audits)


@query("E12_report_checks", sql=_CHECKS)
def checks(d: Data):
    return E.report_checks(_reports(d))


@query("E12_report_status", sql=f"SELECT run_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM ({_CHECKS}) GROUP BY 1")
def status(d: Data):
    return E.report_status(E.report_checks(_reports(d)))


VIEWS["v_validation"] = """SELECT o_orderkey AS validation_id, 'run' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS STRING) AS run_id, o_orderkey % 997 AS created_at, CASE WHEN o_orderkey % 5 = 0 THEN 'FAIL' WHEN o_orderkey % 5 < 3 THEN 'WARN' ELSE 'PASS' END AS status, 'sha' AS report_sha256 FROM {orders}"""


@query("E12_latest_validation", sql="SELECT run_id, validation_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, validation_id DESC) AS rn FROM {v_validation}) WHERE rn = 1")
def latest(d: Data):
    return E.latest_validation(d.v_validation).select("run_id", "validation_id", "status")


@query("E12_validation_counts", sql="""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS "pass", count(*) FILTER (WHERE status = 'WARN') AS warn, count(*) FILTER (WHERE status = 'FAIL') AS fail FROM {v_validation}""")
def counts(d: Data):
    return E.count_validations(d.v_validation)


@query("E13_stale_reports", sql="SELECT doc_id, doc_id % 4 = 0 OR doc_id % 5 = 0 AS stale FROM {documents}")
def stale(d: Data):
    validations = d.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.sha2("text", 256)).alias("report_sha256"))
    reports = d.documents.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))
    return E.stale_reports(validations, reports, "doc_id").select("doc_id", "stale")


@query("E14_document_violations", sql="""
SELECT event_id AS run_id, violation FROM (SELECT event_id, 'schema_version' AS violation FROM {events} WHERE event_id % 10 = 1 UNION ALL SELECT event_id, 'failure.kind' FROM {events} WHERE event_id % 10 = 2
 UNION ALL SELECT event_id, 'meta.generated_at' FROM {events} WHERE event_id % 10 = 3 UNION ALL SELECT event_id, 'triage.priority' FROM {events} WHERE event_id % 10 = 4 UNION ALL SELECT event_id, 'evidence.id' FROM {events} WHERE event_id % 10 = 5
 UNION ALL SELECT event_id, 'hypothesis.refs_exist' FROM {events} WHERE event_id % 10 = 6 UNION ALL SELECT event_id, 'hypothesis.refs_disjoint' FROM {events} WHERE event_id % 10 = 7 UNION ALL SELECT event_id, 'evidence.unique' FROM {events} WHERE event_id % 10 = 8
 UNION ALL SELECT event_id, 'root_cause.hypothesis' FROM {events} WHERE event_id % 10 = 9)""")
def violations(d: Data):
    k = F.col("event_id") % 10
    pick = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    refs = lambda *ids: F.array(*[F.lit(i) for i in ids])
    none = F.array().cast("array<string>")
    docs = d.events.select(
        F.col("event_id").alias("run_id"), pick(1, "0.9", "2.0").alias("schema_version"),
        F.struct(F.lit("fallback").alias("engine"), pick(3, "yesterday", "2024-01-01T00:00:00Z").alias("generated_at")).alias("meta"),
        F.struct(F.lit("test").alias("stage"), pick(2, "gremlins", "timeout").alias("kind"), F.lit("m").alias("message")).alias("failure"),
        F.struct(pick(9, "", "h").alias("hypothesis"), F.lit("low").alias("confidence")).alias("root_cause"),
        F.struct(F.lit("high").alias("severity"), pick(4, 9, 2).alias("priority")).alias("triage"),
        F.when(k == 5, refs("ev-001", "evidence-2")).when(k == 8, refs("ev-001", "ev-001")).otherwise(refs("ev-001", "ev-002")).alias("evidence"),
        F.array(F.struct(F.when(k == 6, refs("ev-777")).otherwise(refs("ev-001")).alias("supporting_evidence_refs"),
                         F.when(k == 7, refs("ev-001")).otherwise(none).alias("contradicting_evidence_refs"))).alias("hypotheses"))
    return E.document_violations(docs, list(HYPOTHESIS_BY_KIND))
