"""The whole analysis of a log: one row per artifact from redaction to hypothesis."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.redaction import redact_counted, hit_total
from faultlens.functions.text import split_lines
from faultlens.operators import classify, extract, triage


def analyze_artifacts(artifacts: DataFrame, text: str = "text", key: str = "artifact_id", environment: Column | None = None,
                      component_rules: Sequence[tuple[str, str]] = (), hits_change: Column | None = None) -> DataFrame:
    """One row per artifact: redactions, classification, events, frames, failed tests, correlation ids, deployment hints,
    severity, component, hypothesis, fix, confidence and completeness.

    Everything after the first step reads the redacted text, in its own row: no artifact is redacted or sent anywhere twice. ``hits_change`` tells whether a frame lies on a changed file.
    """
    changed = F.lit(False) if hits_change is None else hits_change
    clean = artifacts.withColumn("_c", redact_counted(text)).withColumn("redaction_hits", hit_total(F.col("_c"))).withColumn(
        text, F.col("_c.text")).drop("_c").withColumn("_split", split_lines(text))
    rows = extract.failed_tests(classify.extract_events(classify.classify_artifacts(clean, text), text, "_split"), text, "_split")
    rows = rows.withColumn("frames", extract.stack_frames(text, F.col("_split"))).withColumn("deployment", extract.deployment_hints(text))
    paths = F.concat(F.transform("frames", lambda f: f["file"]), F.transform("failed_tests", lambda t: t["file"]))
    static = triage.severity_of(F.col("kind"), F.col("message"), changed)
    located = (F.size("frames") > 0) | (F.size("failed_tests") > 0)
    decided = rows.withColumns({
        "severity": triage.impact_severity(static, F.lit("") if environment is None else environment, F.col("deployment.customer_impact")),
        "component": triage.assign_component(paths, component_rules),
        "hypothesis": triage.hypothesis_of(F.col("kind")), "fix": triage.fix_of(F.col("kind"), F.col(text)),
        "confidence": triage.confidence_of(F.col("kind"), F.col("message"), F.size("frames"), F.size("failed_tests"), changed),
        "completeness": triage.completeness(F.col("kind"), F.size("events") > 0, F.col("message"), located, changed, F.lit(False)),
    })
    return decided.withColumn("context", extract.context_of(text, F.col("_split"))).drop("_split")
