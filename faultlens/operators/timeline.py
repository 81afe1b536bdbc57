"""Deployment timelines, release comparison and investigation rows.

A timeline has at most 41 entries per artifact and is built and ordered inside the artifact's row.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.text import first, iso_to_ns, whole
from faultlens.operators import triage
from faultlens.operators.extract import customer_impact
from faultlens.plans.ordered import running_totals


# Identity fields of a release and their previous counterparts.
RELEASE_FIELDS = (
    "revision", "commit", "image_digest", "manifest_digest", "resource_fingerprint", "migration_version",
    "runtime_version", "dependency_fingerprint", "feature_flag_version",
)


def _entry(**fields: Column) -> Column:
    blank, none = F.lit(""), F.lit(None)
    order = {
        "event_id": blank, "message": blank, "stage": blank, "kind": F.lit("unknown"), "role": F.lit("context"), "source": blank,
        "timestamp_ns": none.cast("bigint"), "timestamp": blank, "sequence": none.cast("int"), "trace_id": blank,
        "span_id": blank, "parent_span_id": none.cast("string"),
    }
    return F.struct(*[fields.get(name, default).alias(name) for name, default in order.items()])


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _basis(entry: Column) -> Column:
    return F.when(entry["timestamp_ns"].isNotNull(), "timestamp_ns").when(entry["sequence"].isNotNull(), "sequence").otherwise("log_order")


def build_timeline(df: DataFrame, deployment_fields: Sequence[str] = ()) -> DataFrame:
    """Add ``entries`` (ordered), ``ordering_basis``, ``grouping`` and the event ids by role.

    Reads ``events`` plus optional string columns workflow, job_name, run_id, platform, environment, service, target,
    release, revision, outcome, started_at and recovery.
    """
    t = lambda name: _text(df, name)
    job = F.concat_ws(" / ", F.nullif(t("workflow"), F.lit("")), F.nullif(t("job_name"), F.lit("")))
    has_run = (t("job_name") != "") | (t("workflow") != "") | (t("run_id") != "")
    run = _entry(event_id=F.lit("ctx-ci"), stage=F.lit("ci"), source=F.lit("ci"),
                 message=F.when(job != "", F.concat(F.lit("CI job: "), job)).otherwise("CI run"))
    labelled = lambda label, name: F.when(t(name) != "", F.concat(F.lit(label + "="), t(name)))
    summary = F.concat(F.lit("Deployment: "), F.concat_ws(
        " ", F.nullif(t("platform"), F.lit("")), labelled("env", "environment"),
        F.coalesce(F.nullif(t("service"), F.lit("")), F.nullif(t("target"), F.lit(""))),
        labelled("release", "release"), labelled("revision", "revision"), labelled("outcome", "outcome")))
    known = ("platform", "environment", "service", "target", "release", "revision", "outcome", "started_at", "recovery")
    stated = F.concat(*[t(name) for name in dict.fromkeys([*known, *deployment_fields])]) != ""
    deploy = _entry(event_id=F.lit("ctx-deploy"), stage=F.lit("deploy"), source=F.lit("deployment"), message=summary,
                    timestamp=t("started_at"), timestamp_ns=iso_to_ns(t("started_at")))
    recovery = _entry(event_id=F.lit("rec-001"), stage=F.lit("deploy"), role=F.lit("recovery"), source=F.lit("recovery"),
                      message=F.concat(F.lit("Recovery: "), t("recovery")),
                      kind=F.when(t("recovery").contains("rollback"), "rollback").otherwise("unknown"))
    names = ("event_id", "message", "stage", "kind", "role", "timestamp_ns", "timestamp", "sequence", "trace_id", "span_id", "parent_span_id")
    events = F.transform("events",
                         lambda e: _entry(source=F.lit("failure_event"), **{name: e[name] for name in names}))
    optional = lambda condition, entry: F.when(condition, F.array(entry)).otherwise(F.slice(F.array(entry), 1, 0))
    raw = F.concat(optional(has_run, run), optional(stated, deploy), events, optional(t("recovery") != "", recovery))
    event_bases = F.array_distinct(F.transform(F.filter("_raw", lambda e: e["source"] == "failure_event"), _basis))
    all_bases = F.array_distinct(F.transform("_raw", _basis))
    mixed = F.size("_event_bases") > 1

    def keyed(entry: Column, i: Column) -> Column:
        clocked, counted = entry["timestamp_ns"].isNotNull(), entry["sequence"].isNotNull()
        rank = F.when(mixed, 0).when(clocked, 0).when(counted, 1).otherwise(2)
        time = F.when(~mixed & clocked, entry["timestamp_ns"]).otherwise(F.lit(0).cast("bigint"))
        number = F.when(~mixed & (clocked | counted), F.coalesce(entry["sequence"], F.lit(0))).otherwise(0)
        return F.struct(rank.alias("g"), time.alias("t"), number.alias("s"), i.alias("i"), entry.alias("e"))

    def finish(row: Column, position: Column) -> Column:
        entry, basis = row["e"], _basis(row["e"])
        uncertainty = (
            F.when(basis == "sequence", "clock not available; ordered by sequence fallback")
            .when(basis == "log_order", "no clock or sequence; ordered by source order").otherwise(""))
        return F.struct(
            position.alias("position"),
            *[entry[c].alias(c) for c in (*names, "source")],
            basis.alias("ordering_basis"), uncertainty.alias("uncertainty"))

    bases = F.when(F.size("_event_bases") > 0, F.col("_event_bases")).otherwise(F.col("_all_bases"))
    overall = F.when(F.size(bases) > 1, "mixed").otherwise(F.coalesce(first(bases), F.lit("log_order")))
    failures = F.filter("entries", lambda e: e["source"] == "failure_event")
    linked = F.size(F.filter(failures, lambda e: (e["trace_id"] != "") | (e["span_id"] != "")))
    grouping = (
        F.when(F.size(failures) == 0, "none").when((linked > 0) & (linked < F.size(failures)), "mixed")
        .when(linked > 0, "runtime").otherwise("pipeline"))
    ids = lambda role: F.transform(F.filter("entries", lambda e: e["role"] == role), lambda e: e["event_id"])
    return (
        df.withColumn("_raw", raw).withColumn("_event_bases", event_bases).withColumn("_all_bases", all_bases)
        .withColumn("_sorted", F.array_sort(F.transform("_raw", keyed)))
        .withColumn("entries", F.transform("_sorted", finish))
        .withColumn("ordering_basis", overall).withColumn("grouping", grouping)
        .withColumn("primary_event_id", F.coalesce(first(ids("primary")), F.lit("")))
        .withColumn("downstream_event_ids", ids("downstream")).withColumn("recovery_event_ids", ids("recovery"))
        .drop("_raw", "_event_bases", "_all_bases", "_sorted")
    )


def timeline_table(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    return df.select(key, F.inline(whole("entries")))


def compare_releases(df: DataFrame) -> DataFrame:
    """Add ``release_changed`` (null when not comparable) and ``release_changed_fields``."""
    parts, comparable = [], F.lit(False)
    for name in ("revision", "commit", "image_digest"):
        now, before = _text(df, name), _text(df, f"previous_{name}")
        both = (now != "") & (before != "")
        comparable = comparable | both
        parts.append(F.when(both & (now != before), F.lit(name)))
    fields = F.array_compact(F.array(*parts))
    return df.withColumn("release_changed_fields", fields).withColumn(
        "release_changed", F.when(comparable, F.size("release_changed_fields") > 0))


def release_changes(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Long table (key, field, current, previous, status) over the fields with a previous value."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("field"), _text(df, name).alias("current"), _text(df, f"previous_{name}").alias("previous"))
        for name in RELEASE_FIELDS if f"previous_{name}" in df.columns])
    long = df.select(key, F.inline(F.filter(rows, lambda r: r["previous"] != "")))
    return long.withColumn("status", F.when(F.col("current") == "", "unknown").when(
        F.col("current") != F.col("previous"), "changed").otherwise("unchanged"))


def previous_releases(deployments: DataFrame, keys: Sequence[str] = ("service", "environment"),
                      order: Sequence[str] = ("started_at",)) -> DataFrame:
    """Previous identity per (service, environment) when deployments do not carry it.

    The previous deployment is the largest earlier (order, identity); it is found piecewise, so a service with a large
    share of all deployments is split over tasks. ``order`` must be unique per key.
    """
    names = [name for name in ("revision", "commit", "image_digest") if name in deployments.columns]
    identity = F.struct(*[F.col(c) for c in order], *[F.col(name).alias(f"_v_{name}") for name in names])
    rows = running_totals(deployments, list(keys), list(order), maxes_before={"_previous": identity})
    return rows.select(*deployments.columns, *[
        F.coalesce(F.col(f"_previous._v_{name}"), F.lit("")).alias(f"previous_{name}") for name in names])


def budget_number(value: Column) -> Column:
    """``"7.5%"`` as 7.5; null when empty or unreadable."""
    return F.regexp_replace(value, "%+$", "").try_cast("double")


def runbooks(df: DataFrame, configured: DataFrame, service: str = "service", target: str = "target") -> DataFrame:
    """Add ``runbook_service``, ``runbook_url`` and ``runbook_source``; an explicit URL wins over the configured one."""
    named = df.withColumn("runbook_service", F.coalesce(F.nullif(_text(df, service), F.lit("")), _text(df, target)))
    table = configured.select(F.col("service").alias("runbook_service"), F.col("url").alias("_url"))
    own = F.nullif(_text(df, "runbook_url"), F.lit(""))
    joined = named.drop("runbook_url").withColumn("_own", own) if "runbook_url" not in df.columns else named.withColumn("_own", own).drop("runbook_url")
    url = F.coalesce("_own", "_url", F.lit(""))
    return joined.join(table, "runbook_service", "left").withColumn("runbook_url", url).withColumn(
        "runbook_source", F.when(F.col("runbook_url") != "", "explicit_trusted_configuration").otherwise("missing")).drop("_own", "_url")


def investigate(df: DataFrame) -> DataFrame:
    """Investigation row: parsed budget, customer impact and effective severity.

    Needs environment, customer_impact, error_budget_remaining, recovery, text and static_severity.
    """
    budget = budget_number(_text(df, "error_budget_remaining"))
    return df.withColumn("budget", budget).withColumn(
        "impact", customer_impact(_text(df, "customer_impact"), _text(df, "text"), _text(df, "recovery"))
    ).withColumn("effective_severity", triage.effective_severity(
        F.col("static_severity"), _text(df, "environment"), _text(df, "customer_impact"), F.col("budget")))
