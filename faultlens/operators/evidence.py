"""Evidence items, observed facts, support status and reviewed hypotheses, all inside the artifact's row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import clip, collapse, found, strip, whole

# Evidence order, provenance and whether an item can support a hypothesis.
LIST_KINDS = (
    ("failure_event", "events", "artifact", "failure.events", "ingest.logs", True),
    ("stack_frame", "frames", "artifact", "failure.stacktrace", "ingest.stacktrace", True),
    ("failed_test", "failed_tests", "artifact", "failure.failed_tests", "ingest.tests", True),
)
LIST_KINDS_LATE = (
    ("connector_observation", "enrichment", "connector", "enrichment", "ingest.enrich", True),
    ("connector_audit", "connector_audits", "connector", "context.connector_audits", "connectors.deployment", False),
    ("metric_sample", "metric_samples", "connector", "devops.metric_samples", "connectors.observability", True),
    ("trace_span", "trace_spans", "connector", "devops.trace_spans", "connectors.observability", True),
    ("source_context", "source_evidence", "repository", "context.source_evidence", "source.context", False),
)
WHOLE_KINDS = (
    ("changed_files", "changed_files", "repository", "git.changed_files", "ingest.git"),
    ("owners", "owners", "repository", "context.owners", "ingest.owners"),
    ("correlated_commits", "correlated_commits", "repository", "git.correlated_commits", "ingest.git"),
)
CONTEXT_KINDS = (
    ("run_context", "run", "context", "context.run", "ingest.context"),
    ("deployment_context", "deployment", "context", "context.deployment", "ingest.context"),
)
MAX_ADVICE_CHARS, MAX_ADVICE_ITEMS = 512, 8
CONFIDENCES = ("high", "medium", "low")
CONTROL = r"[\x00-\x1F\x7F]"


def _item(kind: str, value: Column, source: str, locator: Column, collector: str, supports: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), value.alias("value"), F.lit(source).alias("source_type"), locator.alias("locator"),
        F.lit(collector).alias("collector"), supports.alias("supports"))


def _supports(kind: str, item: Column) -> Column:
    if kind == "stack_frame":
        return strip(item["file"]) != ""
    if kind == "failed_test":
        return (item["name"] != "") | (item["assertion"] != "")
    if kind == "failure_event":
        return strip(item["message"]) != ""
    return F.lit(True)


def _as_text(df: DataFrame, column: str, item: Column) -> Column:
    element = df.schema[column].dataType.elementType.typeName()
    return item if element == "string" else F.to_json(item)


def evidence_items(df: DataFrame) -> DataFrame:
    """Add ``evidence``: typed items in fixed order with run-scoped ids ``ev-001``…

    Array columns that the table lacks are treated as empty.
    """
    def listed(kind, column, source, locator, collector, supports):
        if column not in df.columns:
            return None
        place = lambda i: F.concat(F.lit(locator + "["), i.cast("string"), F.lit("]"))
        return F.transform(column, lambda x, i: _item(
            kind, _as_text(df, column, x), source, place(i), collector, _supports(kind, x) if supports else F.lit(False)))

    def single(condition, item):
        return F.when(condition, F.array(item)).otherwise(F.slice(F.array(item), 1, 0))

    message = F.col("message")
    parts = [single(message != "", _item(
        "failure_message", message, "artifact", F.lit("failure.message"), "ingest.logs", strip(message) != ""))]
    parts += [listed(*spec) for spec in LIST_KINDS]
    parts += [
        single(F.size(column) > 0, _item(kind, F.to_json(column), source, F.lit(locator), collector, F.lit(False)))
        for kind, column, source, locator, collector in WHOLE_KINDS if column in df.columns]
    parts += [listed(*spec) for spec in LIST_KINDS_LATE]
    for kind, column, source, locator, collector in CONTEXT_KINDS:
        if column in df.columns:
            fields = df.schema[column].dataType.fieldNames()
            stated = F.concat(*[F.coalesce(F.col(f"{column}.{name}").cast("string"), F.lit("")) for name in fields]) != ""
            parts.append(single(stated, _item(kind, F.to_json(column), source, F.lit(locator), collector, F.lit(False))))
    items = F.concat(*[part for part in parts if part is not None])
    named = F.transform(items, lambda x, i: F.struct(
        F.format_string("ev-%03d", i + 1).alias("id"),
        *[x[name].alias(name) for name in ("kind", "value", "source_type", "locator", "collector", "supports")]))
    return df.withColumn("evidence", named)


def evidence_table(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    return df.select(key, F.inline(whole("evidence")))


def supporting_ids(evidence: Column) -> Column:
    return F.transform(F.filter(evidence, lambda x: x["supports"]), lambda x: x["id"])


def observed_facts(df: DataFrame) -> DataFrame:
    """Add ``facts``: the classification, then failed tests and frames, each with its evidence id."""
    of = lambda kind: F.filter("evidence", lambda x: x["kind"] == kind)
    lead = F.slice(F.transform(
        F.when(F.size(of("failure_event")) > 0, of("failure_event")).otherwise(of("failure_message")), lambda x: x["id"]), 1, 1)
    fact = lambda kind, value, refs: F.struct(F.lit(kind).alias("kind"), value.alias("value"), refs.alias("evidence_refs"))
    head = F.array(fact("failure_classification", F.to_json(F.struct("stage", "kind")), lead))
    per_item = lambda kind: F.transform(of(kind), lambda x: fact(kind, x["value"], F.array(x["id"])))
    rows = [per_item("failed_test"), per_item("stack_frame")]
    named = F.transform(F.concat(head, *rows), lambda x, i: F.struct(
        F.format_string("fact-%03d", i + 1).alias("id"), x["kind"].alias("kind"), x["value"].alias("value"), x["evidence_refs"].alias("evidence_refs")))
    return df.withColumn("facts", named)


def support_status(kind: Column, engine: Column, evidence: Column, refs: Column, contradicting: Column) -> Column:
    """insufficient_evidence, unsupported or supported from the references that exist."""
    ids = F.transform(evidence, lambda x: x["id"])
    against = F.array_intersect(contradicting, ids)
    backed = F.arrays_overlap(refs, supporting_ids(evidence))
    return (
        F.when((kind == "unknown") & (engine == "fallback"), "insufficient_evidence")
        .when(F.size(against) > 0, "unsupported").when(backed, "supported")
        .when((kind == "unknown") | (F.size(evidence) == 0), "insufficient_evidence").otherwise("unsupported"))


def safe_advice(value: Column) -> Column:
    """Advice text without control characters or operationally unsafe instructions, at most 512 characters."""
    ok = (strip(value) != "") & (F.length(value) <= MAX_ADVICE_CHARS) & ~value.rlike(CONTROL) & ~found(value, P.UNSAFE_ADVICE)
    return F.coalesce(ok, F.lit(False))


def safe_advice_list(values: Column) -> Column:
    return F.coalesce((F.size(values) <= MAX_ADVICE_ITEMS) & F.forall(values, safe_advice), F.lit(False))


def valid_hypothesis(kind: Column, evidence: Column, h: Column) -> Column:
    """Whether a supplied hypothesis may be merged: bounded fields, safe advice, existing disjoint references.

    High confidence needs a known kind, no contradiction and at least one supporting reference.
    """
    ids = F.transform(evidence, lambda x: x["id"])
    refs, against = h["evidence_refs"], h["contradicting_evidence_refs"]
    text_ok = lambda v: (strip(v) != "") & (F.length(v) <= 2000) & ~v.rlike(CONTROL)
    subset = lambda a: (F.size(a) <= MAX_ADVICE_ITEMS) & (F.size(F.array_except(a, ids)) == 0)
    ok = (
        text_ok(h["hypothesis"]) & text_ok(h["fix_suggestion"]) & h["confidence"].isin(*CONFIDENCES)
        & safe_advice(h["fix_suggestion"]) & safe_advice_list(h["recommended_checks"])
        & (F.size(h["missing_information"]) <= MAX_ADVICE_ITEMS)
        & F.forall(h["missing_information"], lambda m: (F.length(m) <= 512) & ~m.rlike(CONTROL))
        & subset(refs) & subset(against) & ~F.arrays_overlap(refs, against)
        & ((h["confidence"] != "high") | (
            (kind != "unknown") & (F.size(against) == 0) & F.arrays_overlap(refs, supporting_ids(evidence)))))
    return F.coalesce(ok, F.lit(False))


def merge_hypothesis(df: DataFrame, hypotheses: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Replace the rule hypothesis by a valid supplied one; rule facts stay as tagged evidence.

    Needs hypothesis, confidence, fix_suggestion, rule_evidence, kind and evidence; ``hypotheses`` has one struct ``h``
    per key.
    """
    joined = df.join(hypotheses.select(key, "h"), key, "left").withColumn(
        "_ok", F.col("h").isNotNull() & valid_hypothesis(F.col("kind"), F.col("evidence"), F.col("h")))
    rules = F.transform("rule_evidence", lambda e: F.concat(F.lit("[rule] "), e))
    cited = F.transform(
        F.filter("evidence", lambda x: F.array_contains(F.col("h.evidence_refs"), x["id"])),
        lambda x: F.concat(F.lit("[ref "), x["id"], F.lit("] "), x["kind"], F.lit(": "), x["value"]))
    chosen = lambda name: F.when(F.col("_ok"), F.col(f"h.{name}")).otherwise(F.col(name)).alias(name)
    engine = F.when(~F.col("_ok"), "fallback").when(F.size("rule_evidence") > 0, "merged").otherwise("llm")
    kept = [c for c in df.columns if c not in ("hypothesis", "confidence", "fix_suggestion", "rule_evidence")]
    return joined.select(
        *kept, chosen("hypothesis"), chosen("confidence"), chosen("fix_suggestion"),
        F.when(F.col("_ok"), F.array_distinct(F.concat(rules, cited))).otherwise(F.col("rule_evidence")).alias("rule_evidence"),
        engine.alias("engine"))


def rule_evidence(df: DataFrame) -> Column:
    """Short statements of the facts behind a rule hypothesis."""
    some = lambda column: column in df.columns
    join = lambda values: F.array_join(values, ", ")
    parts = [F.when(F.col("message") != "", F.concat(F.lit("log message: "), "message"))]
    if some("frames"):
        parts.append(F.when(F.size("frames") > 0, F.concat(
            F.lit("stacktrace frames: "), join(F.transform("frames", lambda f: f["file"])))))
    if some("failed_tests"):
        parts.append(F.when(F.size("failed_tests") > 0, F.concat(
            F.lit("failed tests: "), join(F.transform("failed_tests", lambda t: t["name"])))))
    if some("changed_files"):
        parts.append(F.when(F.size("changed_files") > 0, F.concat(
            F.lit("changed files: "), join(F.array_sort(F.array_distinct("changed_files"))))))
    commits = F.transform("correlated_commits", lambda c: F.concat(F.lit("changed frame commit: "), c)) if some(
        "correlated_commits") else F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*parts)), commits)


def digest_rows(df: DataFrame, key: str = "artifact_id", shown: int = 10) -> DataFrame:
    """Ticket digest, a report view: bounded title, labels and the first ``shown`` frames and tests.

    Needs component, severity, summary, is_duplicate_of, frames and failed_tests.
    """
    headline = F.when(F.col("summary") == "", "CI/CD failure").otherwise(F.col("summary"))
    title = clip(collapse(F.concat(F.lit("["), "component", F.lit("] "), headline)), 120)
    return df.select(
        key, F.when(F.col("is_duplicate_of").isNotNull(), F.concat(F.lit("Duplicate: "), title)).otherwise(title).alias("title"),
        F.array(F.concat(F.lit("severity:"), "severity"), F.concat(F.lit("component:"), "component")).alias("labels"),
        F.transform(F.slice("frames", 1, shown), lambda f: F.concat(f["file"], F.lit(":"), f["line"].cast("string"))).alias("top_frames"),
        F.transform(F.slice("failed_tests", 1, shown), lambda t: t["name"]).alias("top_tests"))
