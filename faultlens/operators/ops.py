"""Operations analytics: metric summaries, deliveries, cost, jobs, idempotency, trust and feedback."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.text import ratio
from faultlens.plans.ordered import running_totals

DELIVERY_STATES = ("confirmed", "failed", "pending", "unknown")
PENDING_SECONDS = 300
JOB_STATES = ("queued", "running", "completed", "failed", "canceled")


def metric_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """count, p50, p95 and max per metric; a percentile is the sorted value at ``int((n-1)p + 0.5)``.

    Equal values are counted first; positions of the distinct values run piecewise, because a metric may have as many
    distinct values as rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, list(keys), [value], {"_u": F.col("_n")})
    totals = placed.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    ranked = placed.join(totals, list(keys))
    at = lambda p: F.min(F.when(F.col("_u") > F.least(F.col("_t") - 1, F.floor((F.col("_t") - 1) * F.lit(p) + F.lit(0.5))), F.col(value)))
    return ranked.groupBy(*keys).agg(F.max("_t").alias("count"), at(0.50).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def delivery_key(incident: Column, destination: Column) -> Column:
    return F.sha2(F.concat(incident, F.lit("\0"), destination), 256)


def delivery_ledger(events: DataFrame, as_of: int) -> DataFrame:
    """Current state per (incident, destination) from ledger events (reserve, confirm, fail, unknown, retry)
    ordered by epoch seconds ``at_s`` and ``seq``.

    A reservation starts or, after a failure, restarts an attempt; it changes nothing once confirmed, unknown or freshly
    pending, and turns a pending one older than 300 s into unknown. Other events before the first reservation count nothing.

    A verdict (confirm, fail, unknown) sets the state whatever it was before, so verdicts cut the events of a delivery into segments
    that don't depend on each other: their number is a running count over consecutive pieces, and each is an aggregate. A
    delivery may have any number of events.
    """
    keys, order = ["incident_key", "destination"], ["at_s", "seq", "action", "external_id"]
    place = F.struct(*order)
    reserve, verdict = F.col("action") == "reserve", F.coalesce(F.col("action").isin("confirm", "fail", "unknown"), F.lit(False))
    rows = events.select(*keys, F.col("at_s").cast("bigint").alias("at_s"), *order[1:])
    opened = rows.filter(reserve).groupBy(*keys).agg(F.min(place).alias("_open"))
    live = rows.join(opened, keys).filter(place >= F.col("_open")).withColumn("_first", place.eqNullSafe(F.col("_open"))).withColumn("_opened", F.col("_open.at_s")).drop("_open")
    parts = running_totals(live, keys, order, sums={"_part": verdict.cast("int")})
    again = F.col("action").isin("reserve", "retry") & ~F.col("_first")
    segments = parts.groupBy(*keys, "_part").agg(
        F.max(F.when(verdict, F.struct("action", "at_s", "external_id"))).alias("_verdict"), F.min(F.when(again, F.col("at_s"))).alias("_again"),
        F.min("_opened").alias("created_at"))
    reopened = F.coalesce((F.col("_verdict.action") == "fail") & F.col("_again").isNotNull(), F.lit(False))
    last = segments.groupBy(*keys).agg(
        (F.count_if(reopened) + 1).cast("int").alias("attempts"), F.max("created_at").alias("created_at"), F.max_by(F.struct("_part", "_verdict", "_again"), "_part").alias("_l"))
    pending = F.col("_l._verdict").isNull() | ((F.col("_l._verdict.action") == "fail") & F.col("_l._again").isNotNull())
    settled = F.when(F.col("_l._verdict.action") == "confirm", "confirmed").when(F.col("_l._verdict.action") == "fail", "failed").otherwise("unknown")
    last = last.select(
        *keys, "attempts", "created_at", F.col("_l._part").alias("_part"), F.when(pending, "pending").otherwise(settled).alias("state"),
        F.when(F.col("_l._verdict").isNull(), F.col("created_at")).when(pending, F.col("_l._again")).otherwise(F.col("_l._verdict.at_s")).alias("updated_at"),
        F.coalesce("_l._verdict.external_id", F.lit("")).alias("external_id"))
    # The first reservation that finds a pending delivery too old leaves it unknown.
    waiting = last.filter("state = 'pending'").select(*keys, "_part", (F.col("updated_at") + PENDING_SECONDS).alias("_due"))
    stale = parts.filter(reserve).join(waiting, [*keys, "_part"]).filter("at_s >= _due").groupBy(*keys).agg(F.min("at_s").alias("_stale"))
    ledger = last.join(stale, keys, "left").select(
        *keys, F.when(F.col("_stale").isNotNull(), "unknown").otherwise(F.col("state")).alias("state"), "attempts", "created_at",
        F.coalesce("_stale", "updated_at").alias("updated_at"), "external_id")
    overdue = (F.col("state") == "pending") & (F.lit(as_of) - F.col("updated_at") >= PENDING_SECONDS)
    return ledger.select(
        delivery_key(F.col("incident_key"), F.col("destination")).alias("key"), *keys, "state", "attempts", "created_at", "updated_at", "external_id",
        overdue.alias("overdue"), (F.col("state") == "failed").alias("retryable"))


def delivery_counts(ledger: DataFrame) -> DataFrame:
    return ledger.agg(*[F.count_if(F.col("state") == state).alias(state) for state in DELIVERY_STATES])


def delivery_listing(ledger: DataFrame, limit: int | None = None, **filters: str | int) -> DataFrame:
    """Deliveries with these values; the latest ``limit`` if given."""
    rows = ledger
    for name, value in filters.items():
        rows = rows.filter(F.col(name) == value)
    return rows if limit is None else rows.orderBy(F.desc("updated_at"), F.desc("key")).limit(limit)


def delivery_expired(ledger: DataFrame, as_of: int, retention_days: int) -> DataFrame:
    return ledger.filter((F.col("updated_at") < as_of - retention_days * 86400) & F.col("state").isin("confirmed", "failed"))


def token_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Add ``cost``: price by provider:model, else provider, else default; null when unknown, 0 without usage.

    ``pricing`` (entry, prompt_per_mtok, completion_per_mtok) is a configuration table with one row per entry.
    """
    price = lambda suffix: pricing.select(
        F.col("entry").alias(f"_k{suffix}"), F.struct("prompt_per_mtok", "completion_per_mtok").alias(f"_p{suffix}"))
    keyed = usage.withColumn("_k1", F.concat_ws(":", "provider", "model")).withColumn("_k2", F.col("provider"))
    default = pricing.filter(F.col("entry") == "default").agg(F.max(F.struct("prompt_per_mtok", "completion_per_mtok")))
    joined = keyed.join(price(1), "_k1", "left").join(price(2), "_k2", "left").withColumn("_p3", default.scalar())
    chosen = F.coalesce("_p1", "_p2", "_p3")
    tokens = lambda name: F.greatest(F.lit(0), F.col(name)).cast("double") / 1_000_000
    cost = tokens("prompt_tokens") * chosen["prompt_per_mtok"] + tokens("completion_tokens") * chosen["completion_per_mtok"]
    none = F.col("prompt_tokens").isNull() & F.col("completion_tokens").isNull()
    return joined.select(*usage.columns, F.when(none, 0.0).otherwise(cost).alias("cost"))


def budget_admission(priced: DataFrame, max_calls: int | None = None, max_cost: float | None = None,
                     batch: str = "batch_id", order: str = "ord", scale: int = 1_000_000_000) -> DataFrame:
    """Add ``admitted``: requests in order until the call cap, or the known cost of the admitted ones, is reached.

    The cost is checked before a request, so one request may overshoot. Costs are added as integer billionths, which
    makes the running sum independent of how the batch is cut into pieces.
    """
    units = F.coalesce(F.floor(F.col("cost") * scale + 0.5), F.lit(0)).cast("bigint")
    running = running_totals(priced.withColumn("_u", units), [batch], [order], {"_spent": F.col("_u")}, rank="_n")
    before = F.col("_spent") - F.col("_u")
    admitted = F.lit(True)
    if max_calls is not None:
        admitted = admitted & (F.col("_n") <= max_calls)
    if max_cost is not None:
        # Spending never falls, so the strict prefix alone decides.
        admitted = admitted & (before < int(max_cost * scale + 0.5))
    return running.select(*priced.columns, admitted.alias("admitted"))


def budget_snapshot(admitted: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Calls, known cost, tokens and skipped requests per batch; one unknown price makes the estimate unknown."""
    ok = F.col("admitted")
    known = F.bround(F.coalesce(F.sum(F.when(ok, F.floor(F.col("cost") * 1_000_000_000 + 0.5))), F.lit(0)) / 1_000_000_000, 6)
    rows = admitted.groupBy(batch).agg(
        F.count_if(ok).alias("calls"), known.alias("known_cost_usd"), F.count_if(ok & F.col("cost").isNull()).alias("unknown_cost_requests"),
        F.count_if(~ok).alias("skipped"), F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"))
    return rows.withColumn("estimated_cost_usd", F.when(F.col("unknown_cost_requests") == 0, F.col("known_cost_usd")))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == state).alias(state) for state in JOB_STATES])


def job_telemetry(jobs: DataFrame) -> DataFrame:
    """Counts of engines, and of fallback reasons among completed jobs, as (metric, label, n)."""
    rows = F.array_compact(F.array(
        F.when(F.col("engine") != "", F.struct(F.lit("engine").alias("metric"), F.col("engine").alias("label"))),
        F.when((F.col("status") == "completed") & (F.col("error") != ""), F.struct(F.lit("fallback").alias("metric"), F.col("error").alias("label")))))
    return jobs.select(F.inline(rows)).groupBy("metric", "label").agg(F.count(F.lit(1)).alias("n"))


def job_expired(jobs: DataFrame, as_of: int, ttl_seconds: int) -> DataFrame:
    return jobs.filter((F.col("updated") < as_of - ttl_seconds) & F.col("status").isin("completed", "failed", "canceled"))


def idempotency(requests: DataFrame) -> DataFrame:
    """First job per (client, key) and whether another body hash reused the key."""
    first = F.struct("created", "job_id")
    return requests.groupBy("client_id", "idempotency_key").agg(
        F.min_by("job_id", first).alias("job_id"), F.min_by("request_hash", first).alias("request_hash"),
        (F.min("request_hash") != F.max("request_hash")).alias("conflict"), F.count(F.lit(1)).alias("requests"))


SOURCE_CLASSES = ("trusted_branch", "fork_pr", "local_artifact")


def resolve_trust(df: DataFrame) -> DataFrame:
    """Add source_class and the capability flags; a detected fork beats every stated class.

    Reads explicit, configured, environment_class, event_name, head_repo, base_repo, source_project, target_project.
    """
    blank = lambda name: F.nullif(F.lower(F.trim(F.col(name))), F.lit(""))
    stated = F.coalesce(blank("explicit"), blank("configured"), blank("environment_class"))
    same = (F.coalesce("head_repo", F.lit("")) != "") & (F.coalesce("base_repo", F.lit("")) != "") & (F.col("head_repo") == F.col("base_repo"))
    projects = (F.coalesce("source_project", F.lit("")) != "") & (F.coalesce("target_project", F.lit("")) != "")
    detected = (
        F.when(F.lower("event_name").isin("pull_request", "pull_request_target"), F.when(same, "trusted_branch").otherwise("fork_pr"))
        .when(projects, F.when(F.col("source_project") != F.col("target_project"), "fork_pr").otherwise("trusted_branch")))
    resolved = F.when(detected == "fork_pr", "fork_pr").otherwise(F.coalesce(stated, detected, F.lit("local_artifact")))
    trusted = F.col("source_class").isin("trusted_branch", "local_artifact")
    return df.withColumn("valid", F.coalesce(stated.isin(*SOURCE_CLASSES), F.lit(True))).withColumn("source_class", resolved).withColumn(
        "allow_source_context", trusted).withColumn("allow_enrichment", trusted).withColumn("allow_llm", trusted).withColumn("allow_delivery", trusted)


def feedback_candidates(feedback: DataFrame) -> DataFrame:
    """Candidate labels of reviewed feedback: the reviewed value, else the predicted one."""
    best = lambda name: F.coalesce(F.nullif(F.col(f"actual_{name}"), F.lit("")), F.col(f"predicted_{name}")).alias(name)
    return feedback.filter(F.col("review_status") == "reviewed").select(
        "feedback_id", "run_id", "report_sha256", best("kind"), best("severity"), F.col("actual_owner").alias("owner"),
        F.col("actual_outcome").alias("outcome"))


def review_accuracy(feedback: DataFrame, *ratings: str) -> DataFrame:
    """Share of correct answers among rated reviews, per rating column."""
    rows = [
        F.struct(F.lit(name).alias("rating"), F.count_if(F.col(name) == "correct").alias("correct"),
                 F.count_if(F.col(name).isin("correct", "incorrect")).alias("rated")) for name in ratings]
    totals = feedback.filter(F.col("review_status") == "reviewed").agg(F.array(*rows).alias("r"))
    return totals.select(F.inline("r")).withColumn("accuracy", ratio(F.col("correct"), F.col("rated"), 6, None))


def failure_taxonomy(docs: DataFrame, *dimensions: str) -> DataFrame:
    return docs.groupBy(*(dimensions or ("stage", "kind", "severity", "component"))).agg(F.count(F.lit(1)).alias("failures"))


def changed_artifacts(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Artifacts of the current listing that are new or whose (size, modified) differs."""
    before = previous.select(key, F.struct("size", "modified").alias("_before"))
    joined = current.join(before, key, "left")
    return joined.filter(~F.struct("size", "modified").eqNullSafe(F.col("_before"))).select(*current.columns)
