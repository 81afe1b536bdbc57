"""Quality metrics over labelled predictions, corpus audits and document checks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.redaction import hit_total, redact_counted
from faultlens.functions.text import collapse, ratio
from faultlens.plans.upsert import latest_per_key


def label_metrics(df: DataFrame, expected: str = "expected", predicted: str = "predicted", labels: Sequence[str] = ()) -> DataFrame:
    """Support, precision and recall per label; the pairs are counted once before they are unfolded."""
    pairs = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("e").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named")))
    long = pairs.select(F.when(F.col("e") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.inline(sides))
    rows = long.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("named").alias("named"),
        F.sum(F.when(F.col("support") > 0, F.col("hit")).otherwise(0)).alias("tp"))
    if labels:
        wanted = df.sparkSession.createDataFrame([(label,) for label in sorted(labels)], "label string")
        rows = rows.join(wanted, "label", "full").fillna(0, ["support", "named", "tp"])
    return rows.select("label", "support", ratio(F.col("tp"), F.col("named"), 6).alias("precision"),
                       ratio(F.col("tp"), F.col("support"), 6).alias("recall"))


def macro_metrics(metrics: DataFrame) -> DataFrame:
    """Mean precision and recall over labels with support."""
    active = metrics.filter(F.col("support") > 0)
    return active.agg(
        F.bround(F.coalesce(F.avg("precision"), F.lit(0.0)), 6).alias("macro_precision"),
        F.bround(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("macro_recall"))


def accuracy(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    return df.agg(ratio(F.count_if(F.col(expected) == F.col(predicted)), F.count(F.lit(1)), 6).alias("accuracy"))


def test_key(name: Column) -> Column:
    """Test identity without runner-specific path prefixes."""
    return F.substring_index(collapse(F.replace(name, F.lit("\\"), F.lit("/"))), "::", -1)


def set_metrics(expected: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall of two sets of rows identified by ``keys``."""
    left = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    right = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    counts = left.join(right, list(keys), "full").agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    return counts.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 6).alias("precision"),
                         ratio(F.col("tp"), F.col("tp") + F.col("fn"), 6).alias("recall"))


def dedup_metrics(df: DataFrame, group: str = "duplicate_group", key: str = "dedup_key") -> DataFrame:
    """Pairwise precision and recall in closed form from group sizes; no pairs are formed."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    same_both = cells.filter(F.col(group).isNotNull()).agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("tp"))
    by_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("pred"))
    by_group = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(pairs("n")), F.lit(0.0)).alias("exp"))
    totals = same_both.select("tp", by_key.scalar().alias("pred"), by_group.scalar().alias("exp"))
    whole = lambda c: c.cast("bigint")
    return totals.select(
        whole(F.col("tp")).alias("tp"), whole(F.col("pred") - F.col("tp")).alias("fp"), whole(F.col("exp") - F.col("tp")).alias("fn"),
        ratio(F.col("tp"), F.col("pred"), 6).alias("precision"), ratio(F.col("tp"), F.col("exp"), 6).alias("recall"))


def redaction_recall(df: DataFrame, secrets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Share of expected secrets that no longer occur after redaction."""
    from faultlens.operators.logtext import leaked_secrets

    leaked = leaked_secrets(df, secrets, key, text).groupBy().agg(F.count(F.lit(1)).alias("leaked"))
    return secrets.groupBy().agg(F.count(F.lit(1)).alias("expected")).withColumn("leaked", leaked.scalar()).withColumn(
        "recall", ratio(F.col("expected") - F.col("leaked"), F.col("expected"), 6, 1.0))


def failure_detection(df: DataFrame) -> DataFrame:
    """Healthy false positives and missed failures; needs is_failure (nullable), expected and predicted kind."""
    healthy = F.coalesce(~F.col("is_failure"), F.lit(False))
    failing = F.coalesce(F.col("is_failure"), F.col("expected") != "unknown")
    detected = F.col("predicted") != "unknown"
    counts = df.agg(
        F.count_if(healthy).alias("healthy_support"), F.count_if(failing).alias("failure_support"),
        F.count_if(healthy & detected).alias("false_positives"), F.count_if(failing & ~detected).alias("missed_failures"))
    return counts.withColumn("false_positive_rate", ratio(F.col("false_positives"), F.col("healthy_support"), 6, None)).withColumn(
        "recall", ratio(F.col("failure_support") - F.col("missed_failures"), F.col("failure_support"), 6, None))


BANDS = ("high", "low", "medium")


def calibration(df: DataFrame, band: str = "band", correct: str = "correct", score: str = "score") -> DataFrame:
    """Support, accuracy and mean completeness per confidence band, every band listed."""
    rows = df.agg(*[
        agg for name in BANDS for agg in (
            F.count_if(F.col(band) == name).alias(f"{name}_n"), F.count_if((F.col(band) == name) & F.col(correct)).alias(f"{name}_c"),
            F.avg(F.when(F.col(band) == name, F.col(score))).alias(f"{name}_s"))])
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("band"), F.col(f"{name}_n").alias("support"),
                 ratio(F.col(f"{name}_c"), F.col(f"{name}_n"), 6, None).alias("empirical_accuracy"),
                 F.bround(f"{name}_s", 6).alias("mean_evidence_completeness")) for name in BANDS])))


def threshold_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Checks (path, direction, threshold) against metrics (path, value); a missing metric fails."""
    joined = thresholds.join(metrics, "path", "left")
    value, limit = F.col("value"), F.col("threshold")
    missing = value.isNull() | F.isnan(value)
    violated = F.when(F.col("direction") == "minimum", value < limit).otherwise(value > limit)
    return joined.select(
        "path", "direction", "threshold", "value", (~missing & ~F.coalesce(violated, F.lit(True))).alias("passed"),
        F.when(missing, "no supported measurement").when(violated, F.concat(F.lit("violates "), "direction")).otherwise("").alias("reason"))


def decision_metrics(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Decision accuracy with precision and recall of flaky and regression decisions."""
    flaky, regression = ("retry_recovered", "historically_flaky", "flaky_suspect"), ("new_failure", "likely_regression")
    counts = [ratio(F.count_if(F.col(expected) == F.col(predicted)), F.count(F.lit(1)), 6).alias("accuracy")]
    for name, group in (("flaky", flaky), ("regression", regression)):
        e, p = F.col(expected).isin(*group), F.col(predicted).isin(*group)
        counts += [ratio(F.count_if(e & p), F.count_if(p), 6).alias(f"{name}_precision"),
                   ratio(F.count_if(e & p), F.count_if(e), 6).alias(f"{name}_recall")]
    return df.agg(*counts)


# ------------------------------------------------------------------ corpus audit

# Fixed value: licences that allow redistribution.
ALLOWED_LICENSES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0")


def _violations(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    # The checks are projected before they are unfolded: exploding an array that reads nested fields directly loses rows
    # in nested-column pruning.
    rows = df.select(key, failed.alias("_failed"))
    return rows.select(key, F.explode(F.slice("_failed", 1, len(checks))).alias("violation")).filter(F.col("violation").isNotNull())


def spans_valid(spans: Column, text: Column) -> Column:
    """Ordered, non-empty spans inside the text whose quoted text agrees. Offsets count characters from 0."""
    inside = F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text))
                      & (s["text"].isNull() | (s["text"] == F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    ordered = F.forall(
        F.transform(spans, lambda s, i: F.when(i == 0, True).otherwise(s["start"] >= F.try_element_at(spans, F.when(i > 0, i))["end"])),
        lambda ok: ok)
    return (F.size(spans) > 0) & inside & ordered


def audit_manifest(artifacts: DataFrame, sources: DataFrame, key: str = "case_id", licenses: Sequence[str] = ALLOWED_LICENSES) -> DataFrame:
    """Violation rows (case, violation) of a corpus: licence, source, digest, residual secrets, spans and uniqueness.

    ``artifacts`` has case_id, path, raw_sha256, sanitized_sha256, source_id, license, text, spans.
    """
    known = sources.select(F.col("source_id"), F.col("license").alias("_source_license"))
    joined = artifacts.join(known, "source_id", "left")
    checks = {
        "license_not_approved": F.col("license").isin(*licenses),
        "source_not_declared": F.col("_source_license").isNotNull(),
        "license_differs_from_source": F.col("_source_license").isNull() | (F.col("license") == F.col("_source_license")),
        "sanitized_sha256_mismatch": F.sha2(F.col("text"), 256) == F.col("sanitized_sha256"),
        "residual_sensitive_match": hit_total(redact_counted("text")) == 0,
        "invalid_spans": spans_valid(F.col("spans"), F.col("text")),
    }
    rows = _violations(joined, key, checks)
    for column in (key, "path", "raw_sha256"):
        repeated = artifacts.groupBy(F.lower(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        hit = artifacts.withColumn("_v", F.lower(column)).join(repeated, "_v", "left_semi")
        rows = rows.unionByName(hit.select(key, F.lit(f"duplicate_{column}").alias("violation")))
    return rows


def corpus_coverage(artifacts: DataFrame) -> DataFrame:
    """Counts by source, split, format and licence as (dimension, value, n)."""
    suffix = F.lower(F.substring_index("path", ".", -1))
    long = artifacts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("dimension"), value.alias("value"))
        for name, value in (("source", F.col("source_id")), ("split", F.col("split")), ("format", suffix), ("license", F.col("license")))])))
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ reports

LEAK = (r"(?i)bearer\s+[a-z0-9_\-\.]{15,}", r"(?i)(password|secret|token|api_key|apikey)\s*[:=]\s*['\"][^\s'\"]{6,}['\"]")
CAPABILITIES = ("source_context", "enrichment", "llm", "delivery")


def report_checks(reports: DataFrame, key: str = "run_id") -> DataFrame:
    """Eight checks per stored report as (key, name, status).

    Needs readable, violations, schema_version, trust (struct or null), has_cycles, entries, platform, target,
    audits (array of output texts), metric_samples, trace_spans and source_evidence counts.
    """
    c = F.col
    known = c("trust.source_class").isin("trusted_branch", "fork_pr", "local_artifact")
    open_fork = (c("trust.source_class") == "fork_pr") & F.coalesce(
        *[F.when(c(f"trust.{name}"), True) for name in CAPABILITIES], F.lit(False))
    leaking = F.exists("audits", lambda a: a.rlike(LEAK[0]) | a.rlike(LEAK[1]))
    deployed = c("platform") != ""
    status = {
        "digest_integrity": F.when(c("readable"), "PASS").otherwise("FAIL"),
        "schema_compliance": F.when(c("violations") > 0, "FAIL").when(c("schema_version") == "2.0", "PASS").otherwise("WARN"),
        "trust_profile": F.when(c("trust").isNull(), "WARN").when(~F.coalesce(known, F.lit(False)) | open_fork, "FAIL").otherwise("PASS"),
        "timeline_causality": F.when(c("has_cycles") | (c("entries") == 0), "WARN").otherwise("PASS"),
        "deployment_context": F.when(deployed & (c("target") != ""), "PASS").otherwise("WARN"),
        "connector_hygiene": F.when(leaking, "FAIL").when(F.size("audits") > 0, "PASS").when(deployed, "WARN").otherwise("PASS"),
        "observability": F.when((c("metric_samples") > 0) | (c("trace_spans") > 0) | ~deployed, "PASS").otherwise("WARN"),
        "source_evidence": F.when(c("source_evidence") > 0, "PASS").otherwise("WARN"),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("status")) for name, value in status.items()])
    return reports.select(key, F.inline(rows))


def report_status(checks: DataFrame, key: str = "run_id") -> DataFrame:
    """Worst check status per report."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return checks.groupBy(key).agg(F.max(rank).alias("_r")).select(
        key, F.when(F.col("_r") == 2, "FAIL").when(F.col("_r") == 1, "WARN").otherwise("PASS").alias("status"))


def latest_validation(validations: DataFrame) -> DataFrame:
    return latest_per_key(validations, ["run_id"], ["created_at", "validation_id"])


def count_validations(validations: DataFrame) -> DataFrame:
    return validations.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.upper("status") == name).alias(name.lower()) for name in ("PASS", "WARN", "FAIL")])


def stale_reports(validations: DataFrame, reports: DataFrame, key: str = "run_id", text: str = "text") -> DataFrame:
    """Whether each validated report is missing or has different bytes now."""
    now = reports.select(key, F.sha2(F.col(text), 256).alias("_now"))
    return validations.join(now, key, "left").select(
        *validations.columns, (~F.col("report_sha256").eqNullSafe(F.col("_now"))).alias("stale"))


# The vocabulary of a stored document.
STAGES = ("ci", "build", "test", "deploy", "unknown")
ENGINES = ("llm", "fallback", "merged")
SEVERITIES = ("critical", "high", "medium", "low")
CONFIDENCES = ("high", "medium", "low")


def document_violations(docs: DataFrame, kinds: Sequence[str], key: str = "run_id") -> DataFrame:
    """Violation rows of nested documents: required fields, vocabularies, id shapes and reference integrity.

    A document has schema_version, meta(engine, generated_at), failure(stage, kind, message),
    root_cause(hypothesis, confidence), triage(severity, priority), evidence(array of id) and
    hypotheses(array of supporting and contradicting references).
    """
    c = F.col
    ids = c("evidence")
    refs = F.flatten(F.transform("hypotheses", lambda h: F.concat(h["supporting_evidence_refs"], h["contradicting_evidence_refs"])))
    disjoint = F.forall("hypotheses", lambda h: ~F.arrays_overlap(h["supporting_evidence_refs"], h["contradicting_evidence_refs"]))
    checks = {
        "schema_version": c("schema_version").isin("1.4", "2.0"),
        "meta.engine": c("meta.engine").isin(*ENGINES),
        "meta.generated_at": F.try_to_timestamp(c("meta.generated_at")).isNotNull(),
        "failure.stage": c("failure.stage").isin(*STAGES),
        "failure.kind": c("failure.kind").isin(*kinds),
        "failure.message": c("failure.message").isNotNull(),
        "root_cause.hypothesis": F.coalesce(c("root_cause.hypothesis"), F.lit("")) != "",
        "root_cause.confidence": c("root_cause.confidence").isin(*CONFIDENCES),
        "triage.severity": c("triage.severity").isin(*SEVERITIES),
        "triage.priority": c("triage.priority").between(1, 5),
        "evidence.id": F.forall(ids, lambda i: i.rlike(r"^ev-[0-9]{3,6}$")),
        "evidence.unique": F.size(F.array_distinct(ids)) == F.size(ids),
        "hypothesis.refs_exist": F.size(F.array_except(refs, ids)) == 0,
        "hypothesis.refs_disjoint": disjoint,
    }
    return _violations(docs, key, checks)
