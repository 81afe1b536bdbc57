"""Quality gates: policy rules over classifications, findings and coverage, many gates per job.

Every rule reads one aggregated row per gate, so the work before that row is map-side combinable; the tests and findings
behind a reason stay in long tables instead of lists.
"""
from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.plans.ordered import running_totals

OUTCOME_RANK = {"pass": 0, "warn": 1, "block": 2}
FLAKY = ("retry_recovered", "historically_flaky", "flaky_suspect")
REGRESSIONS = ("new_failure", "likely_regression")


def effective_rules(policy: Mapping[str, Any], environment: str = "") -> dict[str, Any]:
    """Base rules overlaid with those of one environment."""
    environments = policy.get("environments", {})
    if environment and environment not in environments:
        raise ValueError(f"quality-gate policy has no environment named {environment!r}")
    return {**policy["rules"], **environments.get(environment, {})}


def classification_facts(classifications: DataFrame, gate: str = "gate_id") -> DataFrame:
    """One row of counters per gate. Severity columns are booleans of correlated incidents when present."""
    c = F.col
    regression = c("decision").isin(*REGRESSIONS)
    severity = lambda name: F.count_if(regression & c(name)) if name in classifications.columns else F.lit(0)
    return classifications.groupBy(gate).agg(
        F.count(F.lit(1)).alias("tests"),
        *[F.count_if(c("decision") == d).alias(d) for d in REGRESSIONS],
        F.count_if(c("decision").isin(*FLAKY)).alias("flaky"),
        F.count_if(c("duration_regression")).alias("duration_regression"),
        F.count_if(c("candidate_status").isin("failed", "error") & (c("decision") == "insufficient_history")).alias("unresolved"),
        F.count_if(c("decision") == "insufficient_history").alias("insufficient"),
        F.count_if(c("duration_candidate_ms").isNull() | c("duration_baseline_median_ms").isNull()).alias("untimed"),
        severity("critical_incident").alias("critical_incident"), severity("high_incident").alias("high_incident"),
    )


def _worst(rules: Mapping[str, Any], names: list[str]) -> str:
    return max((rules[name] for name in names), key=OUTCOME_RANK.__getitem__)


def gate_reasons(gates: DataFrame, rules: Mapping[str, Any], facts: DataFrame, sarif: DataFrame | None = None,
                 changed: DataFrame | None = None, delta: DataFrame | None = None, gate: str = "gate_id") -> DataFrame:
    """Ordered reasons (gate, ord, evidence_id, rule, outcome, message, missing) of each gate.

    ``sarif`` holds finding counts, ``changed`` changed-line detail and ``delta`` the coverage delta per gate; a gate
    absent from one of them lacks that evidence. Required but missing evidence is itself a reason.
    """
    def attach(df: DataFrame, side: DataFrame | None, prefix: str) -> DataFrame:
        if side is None:
            return df.withColumn(f"_{prefix}", F.lit(False))
        marked = side.select(gate, *[F.col(x).alias(f"{prefix}_{x}") for x in side.columns if x != gate], F.lit(True).alias(f"_{prefix}"))
        return df.join(marked, gate, "left").withColumn(f"_{prefix}", F.coalesce(f"_{prefix}", F.lit(False)))

    wide = gates.select(gate).distinct()
    for side, prefix in ((facts, "t"), (sarif, "s"), (changed, "c"), (delta, "d")):
        wide = attach(wide, side, prefix)
    n = lambda name: F.coalesce(F.col(f"t_{name}"), F.lit(0))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    percent = lambda value, sign=False: F.format_string("%+.1f%%" if sign else "%.1f%%", value * 100)
    items: list[tuple[Column, str, str, Column, bool]] = []
    on = lambda name: rules.get(name, "pass") != "pass"
    add = lambda condition, rule, outcome, message, missing=False: items.append((condition, rule, outcome, message, missing))

    for decision in REGRESSIONS:
        if on(decision):
            add(n(decision) > 0, decision, rules[decision], text(n(decision).cast("string"), f" test(s) classified as {decision}"))
    required = [name for name in REGRESSIONS if on(name)]
    if required:
        add((n("tests") == 0) | (n("unresolved") > 0), "history_evidence", _worst(rules, required),
            F.lit("History-dependent policy rules could not be evaluated"), True)
    if on("flaky"):
        add(n("flaky") > 0, "flaky", rules["flaky"], text(n("flaky").cast("string"), " test(s) have flaky evidence"))
        add((n("tests") == 0) | (n("insufficient") > 0), "flaky_evidence", rules["flaky"],
            F.lit("Flaky-test policy could not be fully evaluated without historical evidence"), True)
    if on("duration_regression"):
        add(n("duration_regression") > 0, "duration_regression", rules["duration_regression"],
            text(n("duration_regression").cast("string"), " test(s) exceeded duration regression thresholds"))
        add((n("tests") == 0) | (n("untimed") > 0), "duration_regression_evidence", rules["duration_regression"],
            F.lit("Duration-regression policy could not be evaluated without sufficient historical samples"), True)
    for level in ("critical", "high"):
        if on(f"{level}_severity"):
            count = n(f"{level}_incident")
            add(count > 0, f"{level}_severity", rules[f"{level}_severity"],
                text(count.cast("string"), f" test failure(s) correlate with {level} severity incidents"))
    sarif_rules = (("sarif_error", "error_count", " unsuppressed SARIF error(s) found"),
                   ("critical_sarif", "critical_count", " critical SARIF finding(s) found"),
                   ("sarif_warning", "warning_count", " unsuppressed SARIF warning(s) found"))
    for rule, column, words in sarif_rules:
        if on(rule) and sarif is not None:
            count = F.coalesce(F.col(f"s_{column}"), F.lit(0))
            add(count > 0, rule, rules[rule], text(count.cast("string"), words))
    configured = [rule for rule, _, _ in sarif_rules if on(rule)]
    if configured:
        add(~F.col("_s"), "sarif_evidence", _worst(rules, configured),
            F.lit("SARIF policy rules could not be evaluated because no valid SARIF evidence was supplied"), True)
    if rule := rules.get("changed_line_coverage"):
        outcome, minimum = rule["outcome"], float(rule["minimum"])
        if changed is not None:
            incomplete = (F.col("c_unavailable_files") > 0) | (F.col("c_unmapped_lines") > int(rule.get("max_unmapped_lines", 0)))
            add(F.col("_c") & F.coalesce(incomplete, F.lit(False)), "changed_line_coverage_evidence", outcome,
                F.lit("Changed-line coverage evidence is incomplete for the configured source scope"), True)
            if outcome != "pass":
                low = (F.col("c_total") > 0) & (F.col("c_rate") < minimum)
                add(F.coalesce(low, F.lit(False)), "changed_line_coverage", outcome,
                    text("Changed-line coverage ", percent(F.col("c_rate")), f" is below {minimum:.1%}"))
        add(~F.col("_c"), "changed_line_coverage_evidence", outcome,
            F.lit("Changed-line coverage policy could not be evaluated"), True)
    if rule := rules.get("coverage_delta"):
        outcome, minimum = rule["outcome"], float(rule["minimum"])
        if delta is not None:
            unequal = (F.col("d_candidate_only_files") > 0) | (F.col("d_baseline_only_files") > 0)
            add(F.coalesce(unequal, F.lit(False)), "coverage_delta_evidence", outcome,
                F.lit("Coverage delta requires equivalent candidate and baseline file scopes"), True)
            if outcome != "pass":
                add(F.coalesce(F.col("d_delta") < minimum, F.lit(False)), "coverage_delta", outcome,
                    text("Coverage delta ", percent(F.col("d_delta"), True), f" is below {minimum:+.1%}"))
            add(F.col("_d") & ~F.coalesce(unequal, F.lit(False)) & F.col("d_delta").isNull(), "coverage_delta_evidence", outcome,
                F.lit("Coverage delta requires non-empty baseline and candidate coverage"), True)
        add(~F.col("_d"), "coverage_delta_evidence", outcome,
            F.lit("Coverage delta policy requires explicit baseline and candidate coverage"), True)

    if not items:
        items.append((F.lit(False), "none", "pass", F.lit(""), False))
    reasons = F.filter(F.array(*[
        F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(outcome).alias("outcome"), message.alias("message"),
                                   F.lit(missing).alias("missing")))
        for condition, rule, outcome, message, missing in items
    ]), lambda r: r.isNotNull())
    return wide.select(gate, F.posexplode(reasons).alias("_p", "r")).select(
        gate, (F.col("_p") + 1).alias("ord"), F.format_string("gate-ev-%03d", F.col("_p") + 1).alias("evidence_id"), "r.*")


def gate_outcomes(gates: DataFrame, reasons: DataFrame, gate: str = "gate_id") -> DataFrame:
    """Worst outcome and analysis status per gate; a gate without reasons passes."""
    rank = F.array_position(F.array(*[F.lit(name) for name in OUTCOME_RANK]), F.col("outcome"))
    worst = reasons.groupBy(gate).agg(
        F.max(rank).cast("int").alias("_rank"), F.max(F.col("missing").cast("int")).alias("_missing"), F.count(F.lit(1)).alias("reasons"))
    joined = gates.select(gate).distinct().join(worst, gate, "left")
    return joined.select(
        gate, F.element_at(F.array(*[F.lit(name) for name in OUTCOME_RANK]), F.coalesce("_rank", F.lit(1))).alias("policy_outcome"),
        F.when(F.coalesce("_missing", F.lit(0)) == 1, "insufficient_evidence").otherwise("succeeded").alias("analysis_status"),
        F.coalesce("reasons", F.lit(0)).alias("reasons"))


def full_gate(rules: Mapping[str, Any], decisions: DataFrame, conflicts: DataFrame, sarif: DataFrame | None = None,
              changed: DataFrame | None = None, delta: DataFrame | None = None, gate: str = "gate_id") -> DataFrame:
    """Outcome of each gate among ``decisions`` from classifications, findings and coverage.

    ``conflicts`` lists results of a gate that contradict each other: such a gate is blocked whatever its reasons, as its
    evidence can't be trusted.
    """
    gates = decisions.select(gate).distinct()
    outcomes = gate_outcomes(gates, gate_reasons(gates, rules, classification_facts(decisions, gate), sarif, changed, delta, gate), gate)
    marked = outcomes.join(conflicts.groupBy(gate).agg(F.count(F.lit(1)).alias("conflicts")), gate, "left").fillna(0, ["conflicts"])
    bad = F.col("conflicts") > 0
    return marked.select(
        gate, F.when(bad, "block").otherwise(F.col("policy_outcome")).alias("policy_outcome"),
        F.when(bad, "conflicting_evidence").otherwise(F.col("analysis_status")).alias("analysis_status"), "reasons", "conflicts")


def defect_drafts(reasons: DataFrame, outcomes: DataFrame, gate: str = "gate_id") -> DataFrame:
    """Title and body for each gate that does not pass; a gate has at most one reason per rule."""
    row = F.concat(F.lit("- ["), "outcome", F.lit("] "), "message", F.lit(" (`"), "evidence_id", F.lit("`)"))
    lines = reasons.groupBy(gate).agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))).alias("_rows"))
    joined = outcomes.filter(F.col("policy_outcome") != "pass").join(lines, gate)
    body = F.concat(F.lit("Policy outcome: **"), "policy_outcome", F.lit("**\n\nEvidence:\n"),
                    F.array_join(F.transform("_rows", lambda r: r["row"]), "\n"))
    title = F.concat(F.lit("QA quality gate "), "policy_outcome", F.lit(": "), F.size("_rows").cast("string"), F.lit(" policy reason(s)"))
    return joined.select(gate, title.alias("title"), body.alias("body_md"))


def provenance_ids(evidence: DataFrame, gate: str = "gate_id", artifact: str = "path", order: str = "ord") -> DataFrame:
    """``artifact-0001`` ids per gate by first appearance and ``…-test-0001`` ids per row of an artifact.

    Both positions come from piecewise running totals, so a gate or artifact of any size is split over tasks.
    """
    firsts = evidence.groupBy(gate, artifact).agg(F.min(order).alias("_first"))
    numbered = running_totals(firsts, [gate], ["_first", artifact], rank="_a").select(gate, artifact, "_a")
    within = running_totals(evidence, [gate, artifact], [order], rank="_t")
    joined = within.join(numbered, [gate, artifact])
    artifact_id = F.format_string("artifact-%04d", F.col("_a"))
    return joined.select(*evidence.columns, artifact_id.alias("artifact_evidence_id"),
                         F.concat(artifact_id, F.format_string("-test-%04d", F.col("_t"))).alias("evidence_id"))


def reason_provenance(tests: DataFrame, gate: str = "gate_id") -> DataFrame:
    """Evidence ids behind each decision rule, long form (gate, rule, evidence_id)."""
    rule = F.when(F.col("decision").isin(*FLAKY), "flaky").otherwise(F.col("decision"))
    return tests.withColumn("rule", rule).filter(F.col("rule").isin(*REGRESSIONS, "flaky")).select(
        gate, "rule", "evidence_id").distinct()
