"""Test history queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.operators import evaluate as E, history as H


_LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite, test, run_id, attempt ORDER BY ingest_seq DESC) AS rn
                 FROM {v_test_result}) WHERE rn = 1)"""


@query("Q01_runner_alias", sql="""
SELECT CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'go' WHEN 1 THEN 'junit' WHEN 2 THEN 'jest' WHEN 3 THEN 'dotnet' WHEN 4 THEN 'unknown' ELSE 'cargo' END AS runner,
       count(*) AS n FROM {events} GROUP BY 1""")
def runner_alias(d: Data):
    label = F.element_at(F.array(*[F.lit(x) for x in ("Go-Test", " surefire", "JestJS", "xunit", "other", "cargo test")]),
                         (F.col("event_id") % 6 + 1).cast("int"))
    return d.events.select(H.normalize_runner(label).alias("runner")).groupBy("runner").agg(F.count(F.lit(1)).alias("n"))


@query("Q02_leaf_identity", sql="""
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'unknown' ELSE 't' || CAST(user_id AS STRING) END AS leaf FROM {events}""")
def leaf(d: Data):
    from faultlens.functions.text import leaf_identity

    u = F.col("user_id").cast("string")
    k = F.col("event_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("a/b.py::C::t"), u)).when(k == 1, F.concat(F.lit("pkg.mod.t"), u))
        .when(k == 2, F.concat(F.lit("C#t"), u)).when(k == 3, F.concat(F.lit("x\\y\\t"), u))
        .when(k == 4, F.concat(F.lit("p/ t"), u, F.lit(" "))).otherwise(F.lit("a::"))
    )
    return d.events.select("event_id", leaf_identity(name).alias("leaf"))


@query("Q03_failure_signature", sql="""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE sha256('boom <addr> at <date> <time> u' || CAST(user_id AS STRING)) END AS signature FROM {events}""")
def signature(d: Data):
    n = F.lpad(F.hex("event_id"), 8, "0")
    text = F.concat(F.lit("boom  0x"), n, F.lit("\nat 2024-01-0"), (F.col("event_id") % 9 + 1).cast("string"),
                    F.lit(" 10:00:0"), (F.col("event_id") % 10).cast("string"), F.lit("  u"), F.col("user_id").cast("string"))
    return d.events.select("event_id", H.failure_signature(F.when(F.col("event_id") % 9 == 0, "  ").otherwise(text)).alias("signature"))


@query("Q04b_failed_test_rows", sql="""
SELECT CASE WHEN k = 99 THEN '' ELSE file END AS suite,
  CASE k WHEN 0 THEN 'test_a' || CAST(event_id AS STRING) WHEN 4 THEN 'adds' || CAST(event_id AS STRING)
         WHEN 5 THEN 'Adds' || CAST(event_id AS STRING) ELSE name END AS test, 'failed' AS status, count(*) AS n
FROM {v_runner_block} GROUP BY 1, 2, 3""")
def failed_rows(d: Data):
    rows = H.from_failed_tests(d.v_runner_block.select("name", "file", "assertion"), F.lit("pytest"))
    return rows.groupBy("suite", "test", "status").agg(F.count(F.lit(1)).alias("n"))


@query("Q05_upsert_history", sql=f"""WITH {_LATEST}
SELECT suite, test, run_id, attempt, status, duration_ms, environment, ingest_seq FROM latest""")
def upsert(d: Data):
    rows = d.v_test_result
    store, updates = rows.filter(F.col("ingest_seq") % 2 == 0), rows.filter(F.col("ingest_seq") % 2 == 1)
    merged = H.upsert_results(H.latest_results(store), updates)
    return merged.select("suite", "test", "run_id", "attempt", "status", "duration_ms", "environment", "ingest_seq")


@query("Q06_retention", sql="""
SELECT suite, count(*) AS kept FROM {v_test_result} WHERE recorded_at >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1""")
def retention(d: Data):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return H.retain(d.v_test_result, as_of, 15).groupBy("suite").agg(F.count(F.lit(1)).alias("kept"))


_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS \"{s}\"" for s in H.STATUSES)


@query("Q07_status_counts", sql=f"SELECT suite, test, {_COUNTS} FROM {{v_test_result}} GROUP BY 1, 2")
def status_counts(d: Data):
    return H.status_counts(d.v_test_result)


_RATE = """CASE WHEN count(*) FILTER (WHERE status IN ('failed','error','passed')) > 0 THEN
 round_even(CAST(count(*) FILTER (WHERE status IN ('failed','error')) AS DOUBLE) / count(*) FILTER (WHERE status IN ('failed','error','passed')), 6) END"""


@query("Q08_failure_rate", sql=f"SELECT suite, test, {_RATE} AS failure_rate FROM {{v_test_result}} GROUP BY 1, 2")
def failure_rate(d: Data):
    return H.failure_rates(d.v_test_result)


@query("Q09_first_last_seen", sql="""
SELECT suite, test, epoch_us(min(recorded_at)) AS first_us, epoch_us(max(recorded_at)) AS last_us FROM {v_test_result} GROUP BY 1, 2""")
def seen(d: Data):
    us = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    return H.first_last_seen(d.v_test_result).select("suite", "test", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


_DURATIONS = """
durations AS (
  SELECT suite, test, list_sort(list(duration_ms)) AS v, CAST(count(*) AS BIGINT) AS n, sum(duration_ms) AS s
  FROM {v_test_result} WHERE duration_ms IS NOT NULL GROUP BY 1, 2),
stats AS (
  SELECT suite, test, n AS count, CAST((v[CAST((n + 1) // 2 AS BIGINT)] + v[CAST(n // 2 + 1 AS BIGINT)]) // 2 AS INT) AS median_ms,
         CAST(s // n AS INT) AS mean_ms, v[CAST(greatest(0, round_even(CAST(0.95 AS DOUBLE) * n, 0) - 1) AS BIGINT) + 1] AS p95_ms,
         v[1] AS min_ms, v[n] AS max_ms FROM durations)"""


@query("Q10_duration_stats", sql=f"WITH {_DURATIONS} SELECT * FROM stats")
def durations(d: Data):
    return H.duration_stats(d.v_test_result)


@query("Q11_environment_breakdown", sql="SELECT suite, test, environment, count(*) AS n FROM {v_test_result} GROUP BY 1, 2, 3")
def environments(d: Data):
    return H.environment_breakdown(d.v_test_result)


@query("Q12_latest_history", sql="""
SELECT suite, test, ingest_seq, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY suite, test ORDER BY recorded_at DESC, attempt DESC) AS rn FROM {v_test_result}) WHERE rn <= 20""")
def latest(d: Data):
    return H.latest_history(d.v_test_result, 20).select("suite", "test", "ingest_seq", "rank")


@query("Q13_test_catalogue", sql="""
SELECT suite, test, arg_max(runner, recorded_at) AS runner, count(*) AS samples,
       count(*) FILTER (WHERE status IN ('failed', 'error')) AS failures
FROM {v_test_result} WHERE suite LIKE 'tests/s%' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100""")
def catalogue(d: Data):
    return H.list_tests(d.v_test_result, "Tests/S", 100)


@query("Q14_insufficiency", sql=f"""
WITH r AS (SELECT suite, test, {_RATE} AS failure_rate, {_COUNTS} FROM {{v_test_result}} GROUP BY 1, 2),
c AS (SELECT DISTINCT suite, test FROM {{v_test_result}} UNION SELECT DISTINCT suite, 'new' FROM {{v_test_result}})
SELECT suite, test, CASE WHEN r.passed IS NULL THEN 'insufficient_history' ELSE 'analyzed' END AS decision, failure_rate,
       coalesce(passed, 0) AS passed FROM c LEFT JOIN r USING (suite, test)""")
def insufficient(d: Data):
    rows = d.v_test_result
    candidates = rows.select("suite", "test").unionByName(rows.select("suite", F.lit("new").alias("test")))
    return H.insufficiency(candidates, rows).select("suite", "test", "decision", "failure_rate", "passed")


@query("Q15_leaderboard", sql=f"""
WITH {_DURATIONS}, r AS (SELECT suite, test, {_RATE} AS failure_rate, {_COUNTS} FROM {{v_test_result}} GROUP BY 1, 2)
SELECT r.suite, r.test, failed, passed, skipped, failure_rate, median_ms, p95_ms FROM r LEFT JOIN stats USING (suite, test)""")
def leaderboard(d: Data):
    return H.leaderboard(d.v_test_result).select(
        "suite", "test", "failed", "passed", "skipped", "failure_rate", "median_ms", "p95_ms")


@query("Q16_evidence_conflicts", sql="""
SELECT run_id, suite, test, attempt FROM {v_test_result} GROUP BY 1, 2, 3, 4
HAVING count(DISTINCT status || '|' || coalesce(CAST(duration_ms AS STRING), 'null') || '|' || environment) > 1""")
def conflicts(d: Data):
    return H.conflicts(d.v_test_result.withColumn("failure_signature", F.lit("")), ["run_id"])


_CANDIDATES = """
grouped AS (
  SELECT run_id, suite, test, max(attempt) AS attempt, count(*) AS attempts,
         min(CASE WHEN status IN ('failed', 'error') THEN attempt END) AS first_failed,
         max(CASE WHEN status = 'passed' THEN attempt END) AS last_passed FROM latest GROUP BY 1, 2, 3),
candidates AS (
  SELECT g.*, l.status, l.duration_ms, l.environment FROM grouped g JOIN latest l USING (run_id, suite, test, attempt))"""


@query("Q17_duration_regression", sql=f"""
WITH {_LATEST}, {_DURATIONS}, {_CANDIDATES}
SELECT run_id, suite, test,
       coalesce(c.duration_ms IS NOT NULL AND s.count >= 5 AND c.duration_ms > 2 * s.median_ms AND c.duration_ms > s.p95_ms
                AND c.duration_ms - s.median_ms >= 100, false) AS regression,
       CASE WHEN c.duration_ms IS NOT NULL AND s.count >= 5 THEN greatest(c.duration_ms - s.median_ms, 0) END AS delta_ms
FROM candidates c LEFT JOIN stats s USING (suite, test)""")
def duration_regression(d: Data):
    candidates = H.run_candidates(H.latest_results(d.v_test_result))
    stats = H.duration_stats(d.v_test_result)
    timing = H.duration_regression(F.col("duration_ms"), F.col("count"), F.col("median_ms"), F.col("p95_ms"))
    return candidates.join(stats, ["suite", "test"], "left").select("run_id", "suite", "test", timing.alias("t")).select(
        "run_id", "suite", "test", "t.regression", "t.delta_ms")


_CLASSIFY = f"""
WITH {_LATEST}, {_CANDIDATES},
h AS (SELECT suite, test, count(*) AS total, count(*) FILTER (WHERE status IN ('failed', 'error')) AS f,
             count(*) FILTER (WHERE status = 'passed') AS p, {_RATE} AS rate FROM {{v_test_result}} GROUP BY 1, 2),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suite, test ORDER BY recorded_at DESC, attempt DESC) AS r100 FROM {{v_test_result}}) WHERE r100 <= 100),
env AS (SELECT suite, test, environment, count(*) FILTER (WHERE status IN ('failed', 'error')) AS f, count(*) FILTER (WHERE status = 'passed') AS p
        FROM recent GROUP BY 1, 2, 3),
allenv AS (SELECT suite, test, sum(f) AS f, sum(p) AS p FROM env GROUP BY 1, 2),
base AS (SELECT suite, test, bool_or(status = 'passed') AS bp, bool_or(status IN ('failed', 'error')) AS bf FROM recent WHERE commit_sha = 'c95' GROUP BY 1, 2),
decided AS (
SELECT c.run_id, c.suite, c.test, c.status, c.attempts, total, rate, bp, bf, CASE
  WHEN c.attempts > 1 AND ((c.status = 'passed' AND c.first_failed < c.attempt) OR (c.status IN ('failed','error') AND c.last_passed > c.attempt)) THEN 'retry_recovered'
  WHEN c.status = 'passed' THEN CASE WHEN total >= 5 THEN 'passed' ELSE 'insufficient_history' END
  WHEN total < 5 THEN 'insufficient_history'
  WHEN coalesce(env.f, 0) >= 3 AND allenv.f - coalesce(env.f, 0) = 0 AND allenv.p - coalesce(env.p, 0) >= 3 THEN 'environment_specific'
  WHEN bp AND NOT bf THEN 'likely_regression' WHEN bf AND NOT bp THEN 'known_failure'
  WHEN h.f = 0 THEN 'new_failure' WHEN rate >= 0.8 THEN 'known_failure'
  WHEN rate >= 0.05 AND rate < 0.8 AND h.p >= 2 AND h.f >= 2 THEN 'historically_flaky'
  WHEN rate > 0 AND rate < 0.05 THEN 'flaky_suspect' ELSE 'likely_regression' END AS decision
FROM candidates c LEFT JOIN h USING (suite, test) LEFT JOIN allenv USING (suite, test) LEFT JOIN base USING (suite, test)
LEFT JOIN env ON env.suite = c.suite AND env.test = c.test AND env.environment = c.environment)"""


def classified(d: Data):
    candidates = H.run_candidates(H.latest_results(d.v_test_result))
    return H.classify_results(candidates, d.v_test_result, baseline_commit="c95")


@query("Q18_test_classification", sql=f"""{_CLASSIFY}
SELECT run_id, suite, test, decision, CASE WHEN decision = 'retry_recovered' THEN 'high' WHEN status = 'passed' THEN CASE WHEN total >= 5 THEN 'high' ELSE 'low' END
  WHEN decision = 'insufficient_history' THEN 'low' WHEN decision = 'environment_specific' OR coalesce(bp, false) <> coalesce(bf, false) THEN 'high'
  WHEN decision IN ('new_failure', 'known_failure', 'historically_flaky') AND total >= 10 THEN 'high' ELSE 'medium' END AS confidence,
 CAST(CASE WHEN decision = 'retry_recovered' THEN attempts ELSE coalesce(total, 0) END AS BIGINT) AS sample_count,
 CASE WHEN decision <> 'retry_recovered' THEN rate END AS historical_failure_rate FROM decided""")
def classify(d: Data):
    return classified(d).select("run_id", "suite", "test", "decision", "confidence", F.col("sample_count").cast("bigint").alias("sample_count"), "historical_failure_rate")


@query("Q18_environment_correlation", sql="""
SELECT suite, test, environment, count(*) FILTER (WHERE status IN ('failed', 'error')) AS failed, count(*) FILTER (WHERE status = 'passed') AS passed FROM {v_test_result} GROUP BY 1, 2, 3""")
def environment_correlation(d: Data):
    return H.environment_correlation(d.v_test_result)


@query("E08_decision_metrics", sql=f"""{_CLASSIFY},
e AS (SELECT decision AS predicted, CASE CAST(substr(test, 2) AS INT) % 4 WHEN 0 THEN 'historically_flaky' WHEN 1 THEN 'new_failure' WHEN 2 THEN 'passed' ELSE 'likely_regression' END AS expected FROM decided),
c AS (SELECT *, expected IN ('retry_recovered', 'historically_flaky', 'flaky_suspect') AS ef, predicted IN ('retry_recovered', 'historically_flaky', 'flaky_suspect') AS pf,
 expected IN ('new_failure', 'likely_regression') AS er, predicted IN ('new_failure', 'likely_regression') AS pr FROM e),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE expected = predicted) AS hit, count(*) FILTER (WHERE ef AND pf) AS bf, count(*) FILTER (WHERE pf) AS npf, count(*) FILTER (WHERE ef) AS nef,
 count(*) FILTER (WHERE er AND pr) AS br, count(*) FILTER (WHERE pr) AS npr, count(*) FILTER (WHERE er) AS ner FROM c)
SELECT round_even(CAST(hit AS DOUBLE) / n, 6) AS accuracy, CASE WHEN npf > 0 THEN round_even(CAST(bf AS DOUBLE) / npf, 6) ELSE 0 END AS flaky_precision, round_even(CAST(bf AS DOUBLE) / nef, 6) AS flaky_recall,
 CASE WHEN npr > 0 THEN round_even(CAST(br AS DOUBLE) / npr, 6) ELSE 0 END AS regression_precision, round_even(CAST(br AS DOUBLE) / ner, 6) AS regression_recall FROM n""")
def decision_quality(d: Data):
    """The classifier's decisions against labels by test."""
    kind = F.substring("test", 2, 9).cast("int") % 4
    expected = F.when(kind == 0, "historically_flaky").when(kind == 1, "new_failure").when(kind == 2, "passed").otherwise("likely_regression")
    return E.decision_metrics(classified(d).select(expected.alias("expected"), F.col("decision").alias("predicted")))


@query("Q19_run_classification", sql=f"{_CLASSIFY} SELECT run_id, decision, count(*) AS tests FROM decided GROUP BY 1, 2")
def run_classification(d: Data):
    return classified(d).groupBy("run_id", "decision").agg(F.count(F.lit(1)).alias("tests"))


_FEEDBACK = """
SELECT o_orderkey AS feedback_id, 'sig' || CAST(o_orderkey % 50 AS STRING) AS dedup_key,
       'team/tests/s' || CAST(o_custkey % 7 AS STRING) || '.py/core' AS predicted_component, 'medium' AS predicted_severity,
       CASE WHEN o_orderkey % 3 = 0 THEN 'critical' ELSE '' END AS actual_severity,
       CASE WHEN o_orderkey % 100 = 0 THEN 'reviewed' ELSE 'pending' END AS review_status FROM {orders}"""


@query("Q20_related_incidents", sql=f"""
WITH fb AS ({_FEEDBACK}), c AS (SELECT DISTINCT suite, 'sig' || substr(test, 2) AS sig FROM {{v_test_result}})
SELECT DISTINCT suite, sig AS failure_signature, feedback_id, CASE WHEN actual_severity <> '' THEN actual_severity ELSE predicted_severity END AS severity
FROM c JOIN fb ON review_status = 'reviewed' AND (contains(predicted_component, suite) OR dedup_key = sig)""")
def related(d: Data):
    feedback = d.sql(_FEEDBACK)
    candidates = d.v_test_result.select("suite", F.concat(F.lit("sig"), F.substring("test", 2, 9)).alias("failure_signature")).distinct()
    return H.related_incidents(candidates, feedback, ["suite", "failure_signature"])
