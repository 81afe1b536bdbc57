"""Cross-run test history: aggregates, flaky and regression classification.

All per-test numbers come from aggregates that combine map-side; "latest N" uses a rank filter that Spark limits before
the shuffle. A test that holds a large share of the history therefore never gathers in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions.redaction import redact
from faultlens.functions.text import clip, collapse, leaf_identity, ratio, strip
from faultlens.plans.joins import mentions
from faultlens.plans.upsert import latest_per_key, merge_latest

KEY = ["suite", "test"]
RESULT_KEY = ["suite", "test", "run_id", "attempt"]
STATUSES = ("passed", "failed", "skipped", "error", "unknown")
RUNNERS = ("pytest", "junit", "jest", "vitest", "go", "rspec", "cargo", "dotnet", "unknown")

# Runner label aliases.
RUNNER_ALIASES = {
    "go_test": "go", "golang": "go", "go_test_json": "go", "go test": "go", "jestjs": "jest", "jest": "jest",
    "vitest": "vitest", "junit": "junit", "junit5": "junit", "surefire": "junit", "xml": "junit", "pytest": "pytest",
    "rspec": "rspec", "cargo": "cargo", "cargo_test": "cargo", "dotnet": "dotnet", "vstest": "dotnet",
    "nunit": "dotnet", "xunit": "dotnet", "unknown": "unknown", "": "unknown",
}
# Decision thresholds.
MIN_SAMPLES = 5
MIN_DURATION_SAMPLES = 5
FLAKY_LOWER, FLAKY_UPPER, KNOWN_RATE = 0.05, 0.80, 0.80
DURATION_RATIO, DURATION_MIN_MS = 2.0, 100
LATEST_ROWS = 100


def normalize_runner(label: Column) -> Column:
    clean = F.translate(F.lower(strip(F.coalesce(label, F.lit("")))), "- ", "__")
    table = F.create_map(*[F.lit(item) for pair in RUNNER_ALIASES.items() for item in pair])
    return F.coalesce(F.try_element_at(table, clean), F.lit("unknown"))


def failure_signature(message: Column) -> Column:
    """Digest of a redacted message without addresses, dates and times; empty for an empty message."""
    text = collapse(F.coalesce(message, F.lit("")))
    masked = redact(text)
    for pattern, mark in (
        (r"\b0x[0-9a-fA-F]{6,}\b", "<addr>"), (r"\b\d{4}-\d{2}-\d{2}\b", "<date>"), (r"\b\d{1,2}:\d{2}:\d{2}\b", "<time>"),
    ):
        masked = F.regexp_replace(masked, pattern, mark)
    return F.when(text == "", "").otherwise(F.sha2(masked, 256))


def safe(value: Column, limit: int | None = None) -> Column:
    clean = redact(strip(F.coalesce(value, F.lit(""))))
    return clean if limit is None else clip(clean, limit)


def normalize_results(df: DataFrame) -> DataFrame:
    """Sanitized history rows: redacted identity fields, known runner, attempt at least 1, duration at least 0."""
    out = df.withColumn("runner", normalize_runner(F.col("runner"))).withColumn("test", safe(leaf_identity("test")))
    for name in ("suite", "commit_sha", "branch", "environment", "run_id"):
        if name in df.columns:
            out = out.withColumn(name, safe(F.col(name)))
    return out.withColumn("attempt", F.greatest(F.lit(1), F.col("attempt"))).withColumn(
        "duration_ms", F.when(F.col("duration_ms") < 0, 0).otherwise(F.col("duration_ms"))
    )


def from_failed_tests(tests: DataFrame, runner: Column, run: Sequence[str] = ()) -> DataFrame:
    """History rows (attempt 1, failed) of extracted failed tests; ``run`` names context columns to keep."""
    named = tests.filter(F.col("name") != "")
    return named.select(
        safe(F.when(F.coalesce(F.col("file"), F.lit("")) == "", "unknown").otherwise(F.col("file")), 300).alias("suite"),
        safe(leaf_identity("name")).alias("test"), F.lit("failed").alias("status"), F.lit(1).alias("attempt"),
        F.lit(None).cast("int").alias("duration_ms"), normalize_runner(runner).alias("runner"),
        failure_signature(F.col("assertion")).alias("failure_signature"), *run,
    )


def upsert_results(store: DataFrame, updates: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    return merge_latest(store, updates, RESULT_KEY, list(order))


def latest_results(results: DataFrame, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """One row per (suite, test, run, attempt), last write wins."""
    return latest_per_key(results, RESULT_KEY, list(order))


def within_days(results: DataFrame, as_of: Column, days: int | None, column: str = "recorded_at") -> DataFrame:
    """Rows of the last ``days`` before ``as_of``; the filter reaches the scan."""
    if days is None:
        return results
    if days < 1:
        raise ValueError("days must be >= 1")
    return results.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


retain = within_days


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(*KEY).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def _failures() -> Column:
    return F.count_if(F.col("status").isin("failed", "error"))


def _passes() -> Column:
    return F.count_if(F.col("status") == "passed")


def failure_rates(results: DataFrame) -> DataFrame:
    rows = results.groupBy(*KEY).agg(_failures().alias("failures"), _passes().alias("passes"))
    rate = ratio(F.col("failures"), F.col("failures") + F.col("passes"), 6, None)
    return rows.select(*KEY, rate.alias("failure_rate"))


def first_last_seen(results: DataFrame) -> DataFrame:
    return results.groupBy(*KEY).agg(F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"))


def duration_stats(results: DataFrame) -> DataFrame:
    """Exact count, median, mean, p95, min and max of non-null durations per test.

    Durations are first counted per value, so the ordered pass sees one row per distinct millisecond value.
    """
    histogram = results.filter(F.col("duration_ms").isNotNull()).groupBy(*KEY, "duration_ms").agg(
        F.count(F.lit(1)).alias("n"))
    key = Window.partitionBy(*KEY)
    upto = key.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(key))
    total, upto_col = F.col("total"), F.col("upto")
    # 0-based positions in sorted order.
    p95 = F.greatest(F.lit(0), F.bround(F.lit(0.95) * total.cast("double")).cast("bigint") - 1)
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    at = lambda position: F.min(F.when(upto_col > position, F.col("duration_ms")))
    return (
        cumulative.groupBy(*KEY)
        .agg(
            F.max("total").alias("count"), at(low).alias("_low"), at(high).alias("_high"),
            F.sum(F.col("n") * F.col("duration_ms")).alias("_sum"), at(p95).alias("p95_ms"),
            F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        )
        .select(
            *KEY, "count", F.expr("cast((_low + _high) div 2 as int)").alias("median_ms"),
            F.expr("cast(_sum div count as int)").alias("mean_ms"), "p95_ms", "min_ms", "max_ms",
        )
    )


def approximate_duration_stats(results: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Sketch form of :func:`duration_stats`: one mergeable summary per test and no ordered pass."""
    return results.groupBy(*KEY).agg(
        F.count("duration_ms").alias("count"),
        F.percentile_approx("duration_ms", [0.5, 0.95], accuracy).alias("median_p95_ms"),
        F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
    )


def environment_breakdown(results: DataFrame) -> DataFrame:
    return results.groupBy(*KEY, "environment").agg(F.count(F.lit(1)).alias("n"))


def latest_history(results: DataFrame, limit: int | None = None, order: Sequence[Column] | None = None) -> DataFrame:
    """Rows per test, the newest first by (recorded_at, attempt), at most ``limit`` if given."""
    order = order or [F.desc("recorded_at"), F.desc("attempt")]
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def list_tests(results: DataFrame, suite_prefix: str = "", limit: int | None = None) -> DataFrame:
    """Catalogue of tests with samples and failures; the runner is that of the newest row."""
    rows = results.filter(F.col("test") != "unknown")
    if suite_prefix:
        rows = rows.filter(F.lower("suite").startswith(suite_prefix.lower()))
    out = rows.groupBy(*KEY).agg(
        F.max_by("runner", F.struct("recorded_at", "runner")).alias("runner"),
        F.count(F.lit(1)).alias("samples"), _failures().alias("failures"),
    )
    return out if limit is None else out.orderBy(*KEY).limit(limit)


def insufficiency(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each candidate test has any history, with its counts and failure rate."""
    counts = status_counts(results).join(failure_rates(results), KEY)
    joined = candidates.select(*KEY).distinct().join(counts, KEY, "left")
    present = F.col(STATUSES[0]).isNotNull()
    return joined.select(
        *KEY, F.when(present, "analyzed").otherwise("insufficient_history").alias("decision"),
        F.when(present, "").otherwise("no history rows for this test in the window").alias("reason"), "failure_rate",
        *[F.coalesce(s, F.lit(0)).alias(s) for s in STATUSES],
    )


def leaderboard(results: DataFrame) -> DataFrame:
    """Status counts, failure rate, seen range and duration numbers per test in one result."""
    base = results.groupBy(*KEY).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"),
    ).withColumn("failure_rate", ratio(
        F.col("failed") + F.col("error"), F.col("failed") + F.col("error") + F.col("passed"), 6, None))
    return base.join(duration_stats(results), KEY, "left")


def conflicts(results: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, suite, test, attempt) keys that carry contradicting evidence."""
    evidence = F.struct("status", F.col("duration_ms"), "failure_signature", "environment")
    keys = [*scope, *KEY, "attempt"]
    # Contradiction needs only the extremes of the evidence, which combine map-side.
    grouped = results.groupBy(*keys).agg(F.min(evidence).alias("_lo"), F.max(evidence).alias("_hi"))
    return grouped.filter(~F.col("_lo").eqNullSafe(F.col("_hi"))).select(*keys)


def without_duplicates(results: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Equal evidence kept once per (scope, suite, test, attempt)."""
    return results.dropDuplicates([*scope, *KEY, "attempt"])


def duration_regression(candidate: Column, count: Column, median: Column, p95: Column) -> Column:
    """``struct<regression, delta_ms, median_ms>`` of a candidate duration against its history."""
    usable = candidate.isNotNull() & (F.coalesce(count, F.lit(0)) >= MIN_DURATION_SAMPLES)
    delta = candidate - median
    slow = (candidate > median * F.lit(DURATION_RATIO)) & (candidate > p95) & (delta >= DURATION_MIN_MS)
    return F.struct(
        F.coalesce(usable & slow, F.lit(False)).alias("regression"),
        F.when(usable, F.when(slow, delta).otherwise(F.greatest(delta, F.lit(0)))).cast("int").alias("delta_ms"),
        F.when(usable, median).cast("int").alias("median_ms"),
    )


def run_candidates(results: DataFrame, scope: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per (scope, suite, test): the highest attempt with retry facts about the other attempts."""
    failed = F.col("status").isin("failed", "error")
    row = F.struct(*[F.col(c) for c in results.columns if c not in (*scope, *KEY)])
    grouped = results.groupBy(*scope, *KEY).agg(
        F.max_by(row, F.struct("attempt", "status")).alias("_c"),
        F.count(F.lit(1)).alias("attempts"),
        F.min(F.when(failed, F.col("attempt"))).alias("first_failed"),
        F.max(F.when(F.col("status") == "passed", F.col("attempt"))).alias("last_passed"),
    )
    return grouped.select(*scope, *KEY, "_c.*", "attempts", "first_failed", "last_passed")


def environment_correlation(history: DataFrame) -> DataFrame:
    """Failures and passes of every test in every environment, over all of its history."""
    return history.groupBy(*KEY, "environment").agg(_failures().alias("failed"), _passes().alias("passed"))


def classify_results(candidates: DataFrame, history: DataFrame | None, baseline_commit: str | None = None,
                     as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """Nine-way decision for every candidate of :func:`run_candidates`.

    History is reduced to one row per test (counts, duration numbers, facts of its latest 100 rows), then joined once.
    """
    status = F.col("status")
    failing = status.isin("failed", "error")
    recovered = (F.col("attempts") > 1) & (
        ((status == "passed") & (F.col("first_failed") < F.col("attempt")))
        | (failing & (F.col("last_passed") > F.col("attempt")))
    )
    recovered = F.coalesce(recovered, F.lit(False))
    if history is None:
        decision = F.when(recovered, "retry_recovered").otherwise("insufficient_history")
        return candidates.withColumn("decision", decision).withColumn(
            "confidence", F.when(recovered, "high").otherwise("low")
        ).withColumn("sample_count", F.when(recovered, F.col("attempts")).otherwise(F.lit(0)))

    window = within_days(history, as_of, days) if days is not None else history
    counts = window.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("h_total"), _failures().alias("h_failed"), _passes().alias("h_passed"))
    durations = duration_stats(window).select(*KEY, F.col("count").alias("d_count"), F.col("median_ms").alias("d_median"),
                                              F.col("p95_ms").alias("d_p95"))
    recent = latest_history(window, LATEST_ROWS)
    failed_row = F.col("status").isin("failed", "error")
    per_env = recent.groupBy(*KEY, "environment").agg(_failures().alias("f"), _passes().alias("p"))
    # Environments per test are few: at most one entry per row of the latest 100.
    recent_facts = per_env.groupBy(*KEY).agg(
        F.sum("f").alias("r_failed"), F.sum("p").alias("r_passed"),
        F.map_from_entries(F.collect_list(F.struct("environment", F.struct("f", "p")))).alias("r_env"),
    )
    tests = counts.join(durations, KEY, "left").join(recent_facts, KEY, "left")
    if baseline_commit:
        at_base = recent.filter(F.col("commit_sha") == baseline_commit).groupBy(*KEY).agg(
            F.max((F.col("status") == "passed").cast("int")).alias("b_passed"),
            F.max(failed_row.cast("int")).alias("b_failed"))
        tests = tests.join(at_base, KEY, "left")
    else:
        tests = tests.withColumn("b_passed", F.lit(None).cast("int")).withColumn("b_failed", F.lit(None).cast("int"))

    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    total, failed, passed = zero("h_total"), zero("h_failed"), zero("h_passed")
    rate = ratio(failed, failed + passed, 6, None)
    own = F.try_element_at(F.col("r_env"), F.col("environment"))
    own_failed = F.coalesce(own["f"], F.lit(0))
    others_failed = zero("r_failed") - own_failed
    others_passed = zero("r_passed") - F.coalesce(own["p"], F.lit(0))
    env_only = (F.col("environment") != "") & (own_failed >= 3) & (others_failed == 0) & (others_passed >= 3)
    base_passed, base_failed = zero("b_passed") == 1, zero("b_failed") == 1
    enough = total >= MIN_SAMPLES

    decision = (
        F.when(recovered, "retry_recovered")
        .when(status == "passed", F.when(enough, "passed").otherwise("insufficient_history"))
        .when(~enough, "insufficient_history")
        .when(env_only, "environment_specific")
        .when(base_passed & ~base_failed, "likely_regression")
        .when(base_failed & ~base_passed, "known_failure")
        .when((failed == 0) | (rate == 0), "new_failure")
        .when(rate >= KNOWN_RATE, "known_failure")
        .when((rate >= FLAKY_LOWER) & (rate < FLAKY_UPPER) & (passed >= 2) & (failed >= 2), "historically_flaky")
        .when((rate > 0) & (rate < FLAKY_LOWER), "flaky_suspect")
        .otherwise("likely_regression")
    )
    timing = duration_regression(F.col("duration_ms"), F.col("d_count"), F.col("d_median"), F.col("d_p95"))
    by_baseline = base_passed != base_failed
    confidence = (
        F.when(F.col("decision") == "retry_recovered", "high")
        .when(status == "passed", F.when(enough, "high").when(F.col("timing.regression"), "medium").otherwise("low"))
        .when(F.col("decision") == "insufficient_history", "low")
        .when((F.col("decision") == "environment_specific") | by_baseline, "high")
        .when(F.col("decision").isin("new_failure", "known_failure", "historically_flaky"),
              F.when(total >= 10, "high").otherwise("medium"))
        .otherwise("medium")
    )
    retried = F.col("decision") == "retry_recovered"
    joined = candidates.join(tests, KEY, "left").withColumn("decision", decision).withColumn("timing", timing)
    return joined.select(
        *candidates.columns, "decision", confidence.alias("confidence"),
        F.when(retried, F.col("attempts")).otherwise(total).alias("sample_count"),
        F.when(~retried, rate).alias("historical_failure_rate"),
        F.when(retried, False).otherwise(F.col("timing.regression")).alias("duration_regression"),
        F.when(~retried, F.col("timing.delta_ms")).alias("duration_delta_ms"),
        F.when(~retried, F.col("timing.median_ms")).alias("duration_baseline_median_ms"),
    )


def related_incidents(candidates: DataFrame, feedback: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Reviewed feedback per candidate: equal signature, or a predicted component that contains the suite.

    Containment becomes an equi join on the first characters of suites, checked on the whole suite.
    """
    reviewed = feedback.filter(F.col("review_status") == "reviewed").select(
        "feedback_id", "dedup_key", "predicted_component",
        F.coalesce(F.nullif("actual_severity", F.lit("")), "predicted_severity").alias("severity"))
    wanted = candidates.select(*id_columns, "suite", "failure_signature")
    by_key = wanted.join(reviewed, wanted["failure_signature"] == reviewed["dedup_key"]).select(
        *id_columns, "feedback_id", "severity")
    suites = wanted.select("suite").distinct()
    components = reviewed.select("predicted_component").distinct()
    pieces = mentions(components, "predicted_component", F.array("predicted_component"), suites, "suite")
    by_suite = (
        wanted.join(pieces, "suite").join(reviewed, "predicted_component")
        .select(*id_columns, "feedback_id", "severity")
    )
    return by_key.unionByName(by_suite).distinct()
