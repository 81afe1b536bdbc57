"""Operations analytics queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.operators import ops as O


@query("O01_metric_summary", sql="""
WITH v AS (SELECT event_type AS metric, list_sort(list(floor(value))) AS v, count(*) AS n FROM {events} GROUP BY 1)
SELECT metric, n AS count, v[CAST(floor((n - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((n - 1) * 0.95::DOUBLE + 0.5) AS BIGINT) + 1] AS p95, v[n] AS max FROM v""")
def metric_summary(d: Data):
    return O.metric_summary(d.events.select(F.col("event_type").alias("metric"), F.floor("value").cast("double").alias("value")), ["metric"])


VIEWS["v_delivery_event"] = """
SELECT 'inc' || CAST(CAST(floor(event_id / 6) AS BIGINT) AS STRING) AS incident_key, CASE WHEN event_id % 12 < 6 THEN 'github' ELSE 'slack' END AS destination, event_id * 10 + CASE WHEN event_id % 6 >= 3 THEN 400 ELSE 0 END AS at_s, event_id AS seq,
 CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'reserve' WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'confirm' WHEN user_id % 3 = 1 THEN 'fail' ELSE 'reserve' END WHEN 2 THEN 'reserve' WHEN 3 THEN 'reserve' WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN 'confirm' ELSE 'noop' END ELSE 'noop' END AS action, 'x' AS external_id, user_id
FROM {events}"""
# The six slots of a delivery, replayed as explicit states: s1 after slot 1 and so on.
_LEDGER = """
slots AS (SELECT incident_key, destination, max(CASE WHEN seq % 6 = 1 THEN action END) AS a1, max(CASE WHEN seq % 6 = 4 THEN action END) AS a4, max(CASE WHEN seq % 6 = 2 THEN 1 END) AS h2, max(CASE WHEN seq % 6 = 3 THEN 1 END) AS h3,
  min(at_s) AS t0 FROM {v_delivery_event} GROUP BY 1, 2),
s AS (SELECT *, CASE a1 WHEN 'confirm' THEN 'confirmed' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS s1 FROM slots),
s2 AS (SELECT *, CASE WHEN s1 = 'failed' AND h2 = 1 THEN 'pending' ELSE s1 END AS st2, 1 + CASE WHEN s1 = 'failed' AND h2 = 1 THEN 1 ELSE 0 END AS n2 FROM s),
s3 AS (SELECT *, CASE WHEN st2 = 'pending' AND h3 = 1 THEN 'unknown' ELSE st2 END AS st3 FROM s2),
led AS (SELECT incident_key, destination, CASE WHEN a4 = 'confirm' THEN 'confirmed' ELSE st3 END AS state, n2 AS attempts FROM s3)"""


@query("O02_delivery_ledger", sql=f"WITH {_LEDGER} SELECT sha256(incident_key || chr(0) || destination) AS key, state, CAST(attempts AS INT) AS attempts, state = 'failed' AS retryable FROM led")
def ledger(d: Data):
    return O.delivery_ledger(d.v_delivery_event, 10**7).select("key", "state", "attempts", "retryable")


@query("O03_delivery_counts", sql=f"WITH {_LEDGER} SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in O.DELIVERY_STATES) + " FROM led")
def counts(d: Data):
    return O.delivery_counts(O.delivery_ledger(d.v_delivery_event, 10**7))


@query("O03_delivery_listing", sql=f"WITH {_LEDGER} SELECT incident_key, attempts FROM led WHERE state = 'confirmed' AND destination = 'github'")
def listing(d: Data):
    rows = O.delivery_ledger(d.v_delivery_event, 10**7)
    return O.delivery_listing(rows, state="confirmed", destination="github").select("incident_key", "attempts")


@query("O03_delivery_expired", sql=f"WITH {_LEDGER} SELECT count(*) AS expired FROM led WHERE state IN ('confirmed', 'failed')")
def expired(d: Data):
    return O.delivery_expired(O.delivery_ledger(d.v_delivery_event, 10**9), 10**9, 30).agg(F.count(F.lit(1)).alias("expired"))


_PRICES = [("p1:m1", 3.0, 15.0), ("p1", 1.0, 2.0), ("p2", 0.5, 0.5)]
_COST = """priced AS (SELECT *, CASE WHEN provider = 'p1' AND model = 'm1' THEN (prompt_tokens / 1000000.0::DOUBLE) * 3.0 + (completion_tokens / 1000000.0::DOUBLE) * 15.0 WHEN provider = 'p1' THEN (prompt_tokens / 1000000.0::DOUBLE) * 1.0 + (completion_tokens / 1000000.0::DOUBLE) * 2.0
 WHEN provider = 'p2' THEN (prompt_tokens / 1000000.0::DOUBLE) * 0.5 + (completion_tokens / 1000000.0::DOUBLE) * 0.5 END AS cost FROM {v_usage})"""


def _priced(d: Data):
    prices = d.spark.createDataFrame(_PRICES, "entry string, prompt_per_mtok double, completion_per_mtok double")
    return O.token_cost(d.v_usage, prices)


@query("O04_token_cost", sql=f"WITH {_COST} SELECT ord, round_even(cost, 6) AS cost FROM priced")
def cost(d: Data):
    return _priced(d).select("ord", F.bround("cost", 6).alias("cost"))


_ADMIT = f"""{_COST}, units AS (SELECT *, CAST(coalesce(floor(cost * 1000000000 + 0.5), 0) AS BIGINT) AS u FROM priced),
admit AS (SELECT *, row_number() OVER w <= 1000 AND sum(u) OVER w - u < 2000000000 AS admitted FROM units WINDOW w AS (PARTITION BY batch_id ORDER BY ord))"""


def _admitted(d: Data):
    return O.budget_admission(_priced(d), max_calls=1000, max_cost=2.0)


@query("O05_budget_admission", sql=f"WITH {_ADMIT} SELECT batch_id, ord, admitted FROM admit")
def admission(d: Data):
    return _admitted(d).select("batch_id", "ord", "admitted")


@query("O05_budget_snapshot", sql=f"""WITH {_ADMIT} SELECT batch_id, count(*) FILTER (WHERE admitted) AS calls, count(*) FILTER (WHERE NOT admitted) AS skipped, count(*) FILTER (WHERE admitted AND cost IS NULL) AS unknown_cost_requests,
 round_even(CAST(sum(CASE WHEN admitted THEN u ELSE 0 END) AS DOUBLE) / 1000000000, 6) AS known_cost_usd, CAST(sum(CASE WHEN admitted THEN prompt_tokens END) AS BIGINT) AS prompt_tokens FROM admit GROUP BY 1""")
def snapshot(d: Data):
    return O.budget_snapshot(_admitted(d)).select("batch_id", "calls", "skipped", "unknown_cost_requests", "known_cost_usd", "prompt_tokens")


VIEWS["v_job"] = """SELECT o_orderkey AS id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'canceled' ELSE 'completed' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'merged' WHEN o_custkey % 3 = 1 THEN 'fallback' ELSE '' END AS engine,
 CASE WHEN o_custkey % 7 = 0 THEN 'timeout' WHEN o_custkey % 7 = 1 THEN 'rate_limited' ELSE '' END AS error, o_orderkey % 5000 AS updated FROM {orders}"""


@query("O06_job_counts", sql="SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in O.JOB_STATES) + " FROM {v_job}")
def job_counts(d: Data):
    return O.job_counts(d.v_job)


@query("O06_job_telemetry", sql="SELECT 'engine' AS metric, engine AS label, count(*) AS n FROM {v_job} WHERE engine <> '' GROUP BY 2 UNION ALL SELECT 'fallback', error, count(*) FROM {v_job} WHERE status = 'completed' AND error <> '' GROUP BY 2")
def telemetry(d: Data):
    return O.job_telemetry(d.v_job)


@query("O06_job_expired", sql="SELECT id FROM {v_job} WHERE updated < 2000 AND status IN ('completed', 'failed', 'canceled')")
def job_expired(d: Data):
    return O.job_expired(d.v_job, 3000, 1000).select("id")


@query("O07_idempotency", sql="""
WITH r AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS client_id, o_orderkey % 4 AS k, o_orderkey AS job_id, o_orderkey % 8 AS h FROM {orders})
SELECT client_id, CAST(k AS STRING) AS idempotency_key, min(job_id) AS job_id, count(DISTINCT h) > 1 AS conflict, count(*) AS requests FROM r GROUP BY 1, 2""")
def idempotency(d: Data):
    rows = d.orders.select(
        F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("client_id"), (F.col("o_orderkey") % 4).cast("string").alias("idempotency_key"),
        F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 8).cast("string").alias("request_hash"), F.col("o_orderkey").alias("created"))
    return O.idempotency(rows).select("client_id", "idempotency_key", "job_id", "conflict", "requests")


@query("O08_trust_policy", sql="""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'local_artifact' ELSE 'trusted_branch' END ELSE 'fork_pr' END WHEN event_id % 4 = 1 AND user_id % 2 = 1 THEN 'fork_pr'
  WHEN event_id % 3 = 0 THEN 'local_artifact' WHEN event_id % 4 = 1 THEN 'trusted_branch' ELSE 'local_artifact' END AS source_class FROM {events}""")
def trust(d: Data):
    k, odd = F.col("event_id") % 4, F.col("user_id") % 2 == 1
    none = F.lit(None).cast("string")
    rows = d.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, " Local_Artifact").alias("explicit"), none.alias("configured"), none.alias("environment_class"),
        F.when(k == 0, "pull_request").otherwise("push").alias("event_name"), F.lit("org/a").alias("base_repo"),
        F.when(odd, "fork/a").otherwise("org/a").alias("head_repo"), F.when(k == 1, F.when(odd, "9").otherwise("1")).alias("source_project"), F.lit("1").alias("target_project"))
    return O.resolve_trust(rows).select("event_id", "source_class")


@query("O09_feedback_candidates", sql="SELECT feedback_id, coalesce(actual_kind, predicted_kind) AS kind, coalesce(actual_severity, predicted_severity) AS severity FROM {v_feedback} WHERE review_status = 'reviewed'")
def candidates(d: Data):
    return O.feedback_candidates(d.v_feedback).select("feedback_id", "kind", "severity")


@query("O09_review_accuracy", sql="""SELECT 'kind_correct' AS rating, count(*) FILTER (WHERE kind_correct = 'correct') AS correct, count(*) FILTER (WHERE kind_correct <> 'unknown') AS rated,
 round_even(CAST(count(*) FILTER (WHERE kind_correct = 'correct') AS DOUBLE) / count(*) FILTER (WHERE kind_correct <> 'unknown'), 6) AS accuracy FROM {v_feedback} WHERE review_status = 'reviewed'""")
def accuracy(d: Data):
    return O.review_accuracy(d.v_feedback, "kind_correct")


@query("O11_changed_artifacts", sql="SELECT 'p' || CAST(event_id AS STRING) AS path FROM {events} WHERE event_id % 10 = 0 OR user_id % 5 = 0")
def changed(d: Data):
    now = d.events.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.col("user_id").alias("size"), F.lit(1).alias("modified"), "event_id")
    before = now.filter("event_id % 10 <> 0").withColumn("modified", F.when(F.col("size") % 5 == 0, 0).otherwise(1))
    return O.changed_artifacts(before, now).select("path")
