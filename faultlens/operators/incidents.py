"""Incident identity, recurrence, retention and reuse."""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import collapse, strip
from faultlens.plans.ordered import running_totals
from faultlens.plans.upsert import latest_per_key

IDENTITY_VERSION = "incident-v2"
CONTEXT_VERSION = "rca-context-v1"
RECURRENCE_THRESHOLD = 3
DELIVERY_CLAIM_SECONDS = 300
# Fixed value: deployment fields that separate deploy incidents.
DEPLOY_IDENTITY = ("platform", "environment", "cluster", "namespace", "target", "release", "revision", "artifact")
UNIT = "\x1f"


def normalize_noise(text: Column, preserve_case: bool = False) -> Column:
    """Message without timestamps, addresses, temporary paths and line numbers."""
    base = text if preserve_case else F.lower(text)
    return collapse(F.regexp_replace(base, P.INCIDENT_NOISE, " "))


def _equality_identity(core: Column) -> Column:
    """Identity of ``assert a == b`` / ``expected b, got a`` over literals; null for anything else.

    The helper is defined inside so that executors need no copy of this package.
    """
    import ast

    from pyspark.sql.types import StringType

    errors = (SyntaxError, ValueError, TypeError, MemoryError, RecursionError)

    def literal(source: str) -> str | None:
        node = ast.parse(source.strip(), mode="eval").body
        ast.literal_eval(node)
        return ast.dump(node)

    def identify(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            if text.startswith("assert "):
                test = ast.parse(text).body
                node = test[0].test if len(test) == 1 and isinstance(test[0], ast.Assert) and test[0].msg is None else None
                if not (isinstance(node, ast.Compare) and len(node.ops) == 1 and isinstance(node.ops[0], ast.Eq)):
                    return None
                sides = [ast.unparse(node.left), ast.unparse(node.comparators[0])]
            else:
                expected, _, actual = text.removeprefix("expected ").rpartition(", got ")
                sides = [actual, expected]
            return "\x1f".join(["literal-equality", *map(literal, sides)])
        except errors:
            return None

    def identify_batch(texts: pd.Series) -> pd.Series:
        return texts.map(identify)

    return F.pandas_udf(identify_batch, StringType())(core)


def assertion_identity(text: Column) -> Column:
    """Literal equalities written either way get one identity; any other diagnostic stays verbatim."""
    core = F.regexp_replace(F.regexp_replace(strip(text), r"^E\s+", ""), r"^AssertionError:\s*", "")
    shaped = core.startswith("assert ") | core.rlike(r"(?s)^expected .+, got .+\z")
    return F.coalesce(_equality_identity(F.when(shaped, core)), F.concat(F.lit("diagnostic" + UNIT), strip(text)))


def fingerprint(df: DataFrame, tests: DataFrame, frames: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Add ``dedup_key`` from scope, stage, kind, failed tests and, unless every test is named, message and frames.

    ``df`` needs project_scope, stage, kind, message and, for deploys, the deployment identity fields. Tests and
    frames are at most 100 per artifact.
    """
    identified = tests.withColumn("_a", assertion_identity(F.col("assertion")))
    test_text = F.concat_ws(UNIT, F.replace("file", F.lit("\\"), F.lit("/")), "name", "_a")
    per_test = identified.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(test_text)), "\x1e").alias("_tests"),
        F.min(((F.col("name") != "") & (F.col("assertion") != "")).cast("int")).alias("_named"),
    )
    frame_text = F.concat_ws(UNIT, F.replace("file", F.lit("\\"), F.lit("/")), F.coalesce("function", F.lit("")))
    per_frame = frames.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame_text.alias("x")))), lambda r: r["x"]),
                     "\x1e").alias("_frames"))
    named = F.coalesce(F.col("_named"), F.lit(0)) == 1
    parts = [
        F.lit(IDENTITY_VERSION), F.col("project_scope"), F.col("stage"), F.col("kind"), F.coalesce("_tests", F.lit("")),
        F.when(named, "").otherwise(normalize_noise(F.col("message"), preserve_case=True)),
        F.when(named, "").otherwise(F.coalesce("_frames", F.lit(""))),
    ]
    deploy = [F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in DEPLOY_IDENTITY]
    parts.append(F.when(F.col("stage") == "deploy", F.concat_ws(UNIT, *deploy)).otherwise(""))
    digest = F.sha2(F.concat_ws("\x1d", *parts), 256)
    joined = df.join(per_test, key, "left").join(per_frame, key, "left")
    return joined.withColumn("dedup_key", F.concat(F.lit(IDENTITY_VERSION + ":"), digest)).drop(
        "_tests", "_named", "_frames")


def context_fingerprint(dedup_key: Column, evidence: Column, source: Column, model: Column, prompt: Column,
                        policy: Column | None = None) -> Column:
    """Digest of the exact analysis inputs; empty when source, model or prompt is empty."""
    blank = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(model, F.lit("")) == "") | (F.coalesce(prompt, F.lit("")) == "")
    digest = F.sha2(F.concat_ws("\x1d", dedup_key, evidence, source, model, prompt, policy if policy is not None else F.lit("")), 256)
    return F.when(blank, "").otherwise(F.concat(F.lit(CONTEXT_VERSION + ":"), digest))


def recurrence(occurrences: DataFrame, order: Sequence[str], store: DataFrame | None = None,
               threshold: int = RECURRENCE_THRESHOLD) -> DataFrame:
    """Running occurrence number per incident, continued from the stored counts; unknown kinds are not counted, null ones are.

    A hot incident is ranked in consecutive pieces, never as one group.
    """
    unknown = F.col("kind").eqNullSafe("unknown")
    counted = occurrences.filter(~unknown)
    ranked = running_totals(counted, ["dedup_key"], list(order), rank="_n")
    if store is not None:
        prior = store.select(F.col("key").alias("dedup_key"), F.col("count").alias("_prior"))
        ranked = ranked.join(prior, "dedup_key", "left")
    else:
        ranked = ranked.withColumn("_prior", F.lit(0))
    total = F.coalesce(F.col("_prior"), F.lit(0)) + F.col("_n")
    seen = ranked.select(
        *occurrences.columns, total.cast("bigint").alias("occurrence_count"),
        F.when(total > 1, F.col("dedup_key")).alias("is_duplicate_of"), (total >= threshold).alias("recurring"))
    healthy = occurrences.filter(unknown).select(
        *occurrences.columns, F.lit(1).cast("bigint").alias("occurrence_count"),
        F.lit(None).cast("string").alias("is_duplicate_of"), F.lit(False).alias("recurring"))
    return seen.unionByName(healthy)


def incident_state(occurrences: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per incident: count, first message, first and last sighting."""
    rank = F.struct(*[F.col(c) for c in order])
    return occurrences.filter(~F.col("kind").eqNullSafe("unknown")).groupBy(F.col("dedup_key").alias("key")).agg(
        F.min_by("kind", rank).alias("kind"), F.min_by("message", rank).alias("message"),
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"))


def merge_state(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored incidents plus a batch of new sightings: counts add up, stored metadata stays."""
    new = batch.select("key", *[F.col(c).alias(f"_n_{c}") for c in ("kind", "message", "count", "created_at", "last_seen")])
    joined = store.join(new, "key", "full")
    updated = {
        "kind": F.coalesce("kind", "_n_kind"), "message": F.coalesce("message", "_n_message"),
        "count": F.coalesce("count", F.lit(0)) + F.coalesce("_n_count", F.lit(0)),
        "created_at": F.coalesce("created_at", "_n_created_at"), "last_seen": F.greatest("last_seen", "_n_last_seen"),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in store.columns])


def prune(incidents: DataFrame, as_of: Column, retention_days: int = 90, max_entries: int | None = None) -> DataFrame:
    """Drop delivered incidents past retention, then, where a store bound is given, evict delivered and oldest first."""
    kept = incidents.filter(~(F.col("filed") & (F.col("last_seen") < as_of - F.make_dt_interval(F.lit(retention_days)))))
    return kept if max_entries is None else kept.orderBy(F.asc("filed"), F.desc("last_seen"), F.desc("key")).limit(max_entries)


def list_incidents(incidents: DataFrame, kind: str | None = None, filed: bool | None = None, limit: int | None = None) -> DataFrame:
    if limit is not None and not 1 <= limit <= 1000:
        raise ValueError("limit must be in [1, 1000]")
    rows = incidents
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if filed is not None:
        rows = rows.filter(F.col("filed") == filed)
    ordered = rows.orderBy(F.desc("last_seen"), F.desc("key"))
    return ordered if limit is None else ordered.limit(limit)


def lookup(incidents: DataFrame, keys: DataFrame) -> DataFrame:
    return incidents.join(keys.select("key").distinct(), "key", "left_semi")


def reuse_decision(current: DataFrame, store: DataFrame, minimum: int, known: DataFrame | None = None) -> DataFrame:
    """``reuse``: known_issue, stored_snapshot or fresh for each (dedup_key, context_fingerprint, kind, model)."""
    stored = store.select(
        F.col("key").alias("dedup_key"), F.col("count").alias("_count"), F.col("context_fingerprint").alias("_context"),
        F.col("root_cause").alias("_snapshot"), F.col("model").alias("_model"))
    rows = current.join(stored, "dedup_key", "left")
    if known is not None:
        rows = rows.join(known.select("dedup_key", F.lit(True).alias("_known")).distinct(), "dedup_key", "left")
    else:
        rows = rows.withColumn("_known", F.lit(False))
    eligible = (
        (F.col("kind") != "unknown") & (F.col("context_fingerprint") != "")
        & (F.col("context_fingerprint") == F.col("_context")) & (F.coalesce("_snapshot", F.lit("")) != "")
    )
    decision = (
        F.when(~F.coalesce(eligible, F.lit(False)), "fresh")
        .when(F.coalesce("_known", F.lit(False)), "known_issue")
        .when((F.col("_count") >= minimum) & F.col("_model").eqNullSafe(F.col("model")), "stored_snapshot")
        .otherwise("fresh")
    )
    return rows.select(*current.columns, decision.alias("reuse"))


def invalidate(incidents: DataFrame, keys: DataFrame) -> DataFrame:
    """Clear snapshots of the given keys; counts and deliveries stay."""
    hit = incidents.join(keys.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    cleared = {name: F.when(F.col("_hit"), "").otherwise(F.col(name)) for name in ("root_cause", "context_fingerprint")}
    return hit.select(*[cleared.get(c, F.col(c)).alias(c) for c in incidents.columns])


def known_issues(feedback: DataFrame, reports: DataFrame) -> DataFrame:
    """Latest reviewed, useful and resolved feedback per fingerprint whose report is unchanged on disk."""
    good = feedback.filter(
        (F.col("review_status") == "reviewed") & F.col("usefulness").isin("useful", "partial")
        & F.col("actual_outcome").isin("root_cause_confirmed", "resolved") & (F.col("dedup_key") != ""))
    newest = latest_per_key(good, ["dedup_key"], ["created_at", "feedback_id"])
    return newest.join(reports.select("run_id", "report_sha256", "dedup_key"), ["run_id", "report_sha256", "dedup_key"])


def record_triage(incidents: DataFrame, triage: DataFrame) -> DataFrame:
    """Write component, title and snapshot; an evicted incident is created again."""
    new = triage.select("key", *[F.col(c).alias(f"_n_{c}") for c in triage.columns if c != "key"])
    joined = incidents.join(new, "key", "full").withColumn("_hit", F.col("_n_component").isNotNull())
    has = F.coalesce(F.col("_n_root_cause"), F.lit("")) != ""
    updated = {
        "component": F.coalesce("_n_component", "component"), "title": F.coalesce("_n_title", "title"),
        "kind": F.coalesce("kind", "_n_kind"), "count": F.coalesce("count", F.lit(1).cast("bigint")),
        "filed": F.coalesce("filed", F.lit(False)),
        "root_cause": F.when(has, F.col("_n_root_cause")).otherwise(F.coalesce("root_cause", F.lit(""))),
        "context_fingerprint": F.when(has, F.col("_n_context_fingerprint")).when(F.col("_hit"), "").otherwise(
            F.col("context_fingerprint")),
        "last_seen": F.coalesce("last_seen", "_n_last_seen"),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in incidents.columns])


def already_delivered(incidents: DataFrame, destination: str) -> DataFrame:
    """Whether each incident was delivered to a destination; the legacy flag stands for the first one."""
    stated = F.map_contains_key(F.coalesce("deliveries", F.create_map().cast("map<string,string>")), destination)
    legacy = F.lit(destination == "github") & F.col("filed")
    return incidents.select("key", (stated | legacy).alias("delivered"))
