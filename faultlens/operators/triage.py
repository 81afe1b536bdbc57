"""Severity, component, ownership and rule hypothesis."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import found
from faultlens.plans.joins import glob_to_regex, interval_join, suffix_match

# Severity by kind and severity priorities.
HIGH_KINDS = (
    "import_error", "compilation_error", "image_pull_error", "registry_auth_failure", "migration_failed",
    "config_missing", "dependency_resolution", "ci_failure", "deployment_failed", "rollback", "permission_error",
    "health_check_failed", "readiness_timeout", "oom_killed", "crash_loop", "liveness_probe_failed",
    "readiness_probe_failed", "scheduling_failed", "quota_exceeded", "network_failure", "disk_full",
    "tls_certificate_error",
)
MEDIUM_KINDS = ("timeout", "api_rate_limited")
SEVERITIES = ("critical", "high", "medium", "low")
PRODUCTION = ("production", "prod", "live")


def priority_of(severity: Column) -> Column:
    """critical 1, high 2, medium 3, low 4."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def severity_of(kind: Column, message: Column, hits_change: Column) -> Column:
    """Severity by kind; a crash message or a changed file under a failing test raises it."""
    return (
        F.when(kind.isin(*HIGH_KINDS), "high")
        .when(kind.isin(*MEDIUM_KINDS), "medium")
        .when(kind == "flaky", "low")
        .when(found(message, P.CRASH), "high")
        .when(kind == "test_failure", F.when(hits_change, "high").otherwise("medium"))
        .otherwise("low")
    )


def _worse(left: Column, right: Column) -> Column:
    return F.when(priority_of(right) < priority_of(left), right).otherwise(left)


def impact_severity(severity: Column, environment: Column, impact: Column) -> Column:
    """Raise for confirmed customer impact in production; never lower."""
    production = F.lower(F.trim(F.coalesce(environment, F.lit("")))).isin(*PRODUCTION)
    level = F.lower(F.trim(F.coalesce(impact, F.lit(""))))
    target = F.when(level == "outage", "critical").when(level == "degraded", "high")
    return F.when(production & target.isNotNull(), _worse(severity, target)).otherwise(severity)


def override_severity(severity: Column, environment: Column, kind: Column, overrides: Mapping[tuple[str, str], str]) -> Column:
    """Configured (environment, kind) severities replace the computed one when valid."""
    result = severity
    for (env, name), level in overrides.items():
        if level in SEVERITIES:
            result = F.when((environment == env) & (kind == name), level).otherwise(result)
    return result


def effective_severity(static: Column, environment: Column, impact: Column, budget: Column) -> Column:
    """Static severity, customer impact, and a nearly spent production error budget (below 10)."""
    base = F.when(static.isin(*SEVERITIES), static).otherwise("medium")
    raised = impact_severity(base, environment, impact)
    production = F.lower(F.trim(F.coalesce(environment, F.lit("")))).isin(*PRODUCTION)
    return F.when(production & (budget < 10), _worse(raised, F.lit("high"))).otherwise(raised)


def top_directory(path: Column) -> Column:
    return F.when(path.startswith("/"), "/").otherwise(F.element_at(F.split(path, "/"), 1))


def assign_component(paths: Column, component_rules: Sequence[tuple[str, str]], located: Column | None = None) -> Column:
    """Component of an ordered path array: first path with a matching glob, else its first directory.

    ``located`` limits the directory fallback to frame and test paths. Rules are configuration, so they become
    literals of the expression; nothing is joined.
    """
    located = paths if located is None else located

    def component(path: Column) -> Column:
        chain = None
        for pattern, name in component_rules:
            hit = path.rlike(glob_to_regex(pattern)) | path.rlike(glob_to_regex(pattern.rstrip("/") + "/*"))
            chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
        return F.lit(None).cast("string") if chain is None else chain

    mapped = F.filter(F.transform(paths, component), lambda c: c.isNotNull())
    folders = F.filter(F.transform(F.filter(located, lambda p: p != ""), top_directory), lambda d: d != "")
    return F.coalesce(
        F.try_element_at(mapped, F.lit(1)), F.try_element_at(folders, F.lit(1)), F.lit("unowned")
    )


def owner_rules(codeowners: DataFrame, scope: str = "scope", text: str = "text") -> DataFrame:
    """Ordered rules (scope, ord, pattern, owners) of ownership files; comments and short lines drop out."""
    from faultlens.functions.text import collapse, split_lines

    lines = codeowners.select(scope, F.posexplode(split_lines(text)).alias("ord", "line"))
    words = lines.withColumn("_w", F.split(collapse(F.substring_index("line", "#", 1)), " "))
    return words.filter(F.size("_w") >= 2).select(
        scope, "ord",
        F.regexp_replace(F.col("_w")[0], "^/+", "").alias("pattern"),
        F.slice("_w", 2, F.size("_w")).alias("owners"),
    )


def resolve_owners(paths: DataFrame, rules: DataFrame, scope: str = "scope", path: str = "path") -> DataFrame:
    """Owners of each distinct (scope, path): the last matching rule of that scope; no owners where none matches.

    A path meets the rules of its own folders (and those that name only an end, or nothing) by an equi join, and each of them is then
    checked in full, so the work is in proportion to the rules that may match, however many a scope has.
    """
    from faultlens.plans.joins import glob_key, glob_to_regex_column, path_keys

    keyed = rules.select(scope, "ord", "pattern", "owners", glob_to_regex_column(F.col("pattern")).alias("_regex"), glob_key(F.col("pattern")).alias("_key"))
    asked = paths.select(scope, path).distinct()
    clean = F.regexp_replace(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "^/+", "")
    matches = F.rlike(F.col("_clean"), F.col("_regex")) | (F.col("pattern").endswith("/") & F.col("_clean").startswith(F.col("pattern")))
    last = (
        asked.withColumn("_clean", clean).withColumn("_key", F.explode(path_keys(F.col("_clean")))).join(keyed, [scope, "_key"]).filter(matches)
        .groupBy(scope, path).agg(F.max(F.struct("ord", "pattern", "owners")).alias("_rule")))
    return asked.join(last, [scope, path], "left").select(scope, path, F.coalesce("_rule.owners", F.array().cast("array<string>")).alias("owners"))


def owners_for_paths(path_lists: DataFrame, rules: DataFrame, key: str, scope: str = "scope") -> DataFrame:
    """Owners per ``key`` over its ordered paths (pos, path): the last path with any matching rule wins."""
    resolved = resolve_owners(path_lists, rules, scope)
    joined = path_lists.join(resolved, [scope, "path"]).filter(F.size("owners") > 0)
    return joined.groupBy(key).agg(F.max_by("owners", "pos").alias("owners"))


def frames_on_changed_files(frames: DataFrame, changed: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Distinct (key, file, path) where a frame file and a changed path match on ``/`` boundaries."""
    slash = lambda name: F.replace(F.col(name), F.lit("\\"), F.lit("/"))
    left = frames.select(key, slash("file").alias("file")).distinct()
    right = changed.select(key, slash("path").alias("path")).distinct()
    return suffix_match(left, right, "file", "path", [key]).distinct()


def correlated_commits(frames: DataFrame, changed: DataFrame, commits: DataFrame, key: str = "artifact_id",
                       limit: int | None = None) -> DataFrame:
    """Latest commit subject of each changed file hit by a frame, ranked by path; the first ``limit`` of a key if given."""
    hits = frames_on_changed_files(frames, changed, key).select(key, "path").distinct()
    latest = commits.groupBy("path").agg(F.max_by(F.struct("sha", "subject"), F.struct("ts", "sha")).alias("c"))
    window = Window.partitionBy(key).orderBy("path")
    ranked = hits.join(latest, "path").withColumn("rank", F.row_number().over(window)).select(key, "path", "c.sha", "c.subject", "rank")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def line_provenance(frames: DataFrame, blame: DataFrame, width: int = 256) -> DataFrame:
    """Blame range (file, start_line, end_line, sha) that holds each frame line."""
    return interval_join(frames, blame, ["file"], "line", "start_line", "end_line", width)


# Confidence-free hypothesis and first check per kind.
FIX_BY_KIND = {
    "import_error": "Inspect the missing dependency or import path/module name in the isolated build environment.",
    "compilation_error": "Inspect the compile error at the reported file:line and compare the build config / dependencies.",
    "test_failure": "Inspect the failing assertion and the code under test before changing the expected value.",
    "timeout": "Collect the timed-out step's duration and stack evidence; inspect the slow or hanging path.",
    "flaky": "Rerun the same test in an isolated diagnostic attempt and compare the failed and passing traces.",
    "ci_failure": "Inspect the failed CI job or step and correct the command, configuration, or dependency that returned non-zero.",
    "deployment_failed": "Inspect the deployment tool output and compare the rejected manifest, release configuration, and target environment.",
    "rollback": "Inspect the rollout history and failed release revision; confirm recovery state before any retry.",
    "health_check_failed": "Inspect application startup logs and probe configuration; compare observed health-check thresholds.",
    "image_pull_error": "Verify the image name, tag, registry availability, and image-pull credential reference in the target environment.",
    "migration_failed": "Review the migration error and inspect schema/data state before deciding whether a rerun is safe.",
    "permission_error": "Inspect the denied operation, identity, and minimum required permission without changing access.",
    "readiness_timeout": "Inspect pod events and startup logs; compare readiness conditions with the observed startup duration.",
    "oom_killed": "Inspect container memory limits and the workload memory profile; fix the leak or raise the limit only after sizing it.",
    "crash_loop": "Inspect the previous container log and startup configuration; fix the process crash before redeploying.",
    "liveness_probe_failed": "Verify the liveness endpoint and startup timing; avoid restarting a process that is still initializing.",
    "readiness_probe_failed": "Verify the readiness endpoint, dependencies, and startup timing before routing traffic to the workload.",
    "scheduling_failed": "Inspect pod scheduling events, node selectors, taints, and resource requests.",
    "quota_exceeded": "Inspect the relevant quota, current usage, and deployment resource request before proposing a change.",
    "network_failure": "Collect service DNS, network-policy, endpoint, and target-dependency diagnostics before retrying.",
    "registry_auth_failure": "Inspect the registry credential reference and image-pull secret assignment without exposing their values.",
    "config_missing": "Inspect the required ConfigMap, Secret, or environment-variable reference and compare the release manifest.",
    "dependency_resolution": "Resolve the dependency conflict: align the conflicting pins/peer requirements, then refresh the lockfile.",
    "disk_full": "Inspect runner disk space usage, cache/artifact growth, and volume capacity before retrying the job.",
    "tls_certificate_error": "Inspect the certificate chain, hostname, expiry, and trust configuration without disabling verification.",
    "api_rate_limited": "Inspect the Retry-After value, rate-limit behavior, and provider quota diagnostics before retrying.",
    "unknown": "Investigate manually: reproduce the failure locally with the reported log.",
}
HYPOTHESIS_BY_KIND = {
    "import_error": "Module import failed; a dependency or module is missing or broken.",
    "compilation_error": "Build/compilation error reported in the artifact.",
    "test_failure": "Test assertion failed; the code under test diverges from expectations.",
    "timeout": "Execution exceeded the allowed time; likely a slow/hanging path.",
    "flaky": "Failure appears intermittent/flaky, possibly order- or environment-dependent.",
    "ci_failure": "The CI pipeline reported a failed job or step with a non-zero result.",
    "deployment_failed": "The deployment tool reported that the release could not be applied.",
    "rollback": "The deployment was rolled back after an unsuccessful release.",
    "health_check_failed": "The deployed workload failed its readiness or liveness health check.",
    "image_pull_error": "The target environment could not pull the container image needed for deployment.",
    "migration_failed": "A database or application migration failed during deployment.",
    "permission_error": "The deployment identity was denied access to a required resource.",
    "readiness_timeout": "The deployed workload did not become ready before the rollout deadline.",
    "oom_killed": "The deployed container was terminated because it exceeded its memory limit.",
    "crash_loop": "The deployed container repeatedly crashed during startup or runtime.",
    "liveness_probe_failed": "The deployed workload failed its liveness probe.",
    "readiness_probe_failed": "The deployed workload failed its readiness probe.",
    "scheduling_failed": "The scheduler could not place the workload on a suitable node.",
    "quota_exceeded": "The deployment exceeded an available resource quota or capacity limit.",
    "network_failure": "The deployed workload could not reach a required network dependency.",
    "registry_auth_failure": "The workload could not authenticate to the container registry.",
    "config_missing": "The deployment referenced missing configuration or a required environment variable.",
    "dependency_resolution": "The package manager could not resolve a consistent dependency graph for the requested versions.",
    "disk_full": "The job ran out of disk space while downloading or writing artifacts.",
    "tls_certificate_error": "A TLS certificate presented by the registry/mirror is expired, self-signed, or untrusted.",
    "api_rate_limited": "A remote API rejected the request with HTTP 429; the run hit a rate limit.",
    "unknown": "No strong automated signal; requires manual investigation.",
}
# Refined checks for a generic job failure.
CI_FIXES = {
    "lockfile": "Refresh the dependency lockfile with the supported package manager, commit it, and rerun with a clean dependency cache.",
    "artifact": "Verify the producer job uploads the named artifact and the consumer job downloads the same name and run attempt.",
    "permission": "Verify the CI token's minimum required permissions and whether the run originated from an untrusted fork.",
    "service": "Check the dependent service health and CI service-container readiness before retrying the job.",
    "runner": "Use a supported runner image/label and verify required toolchain versions are installed.",
}


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(mapping["unknown"]))


def _any_word(text: Column, *words: str) -> Column:
    result = text.contains(words[0])
    for word in words[1:]:
        result = result | text.contains(word)
    return result


def hypothesis_of(kind: Column) -> Column:
    return _lookup(HYPOTHESIS_BY_KIND, kind)


def fix_of(kind: Column, text: Column) -> Column:
    """First check per kind; a generic job failure is refined by words of its log."""
    low = F.lower(text)
    refined = (
        F.when(_any_word(low, "lock file", "package-lock", "yarn.lock"), CI_FIXES["lockfile"])
        .when(_any_word(low, "artifact") & _any_word(low, "not found", "missing"), CI_FIXES["artifact"])
        .when(_any_word(low, "permission", "forbidden", "resource not accessible"), CI_FIXES["permission"])
        .when(_any_word(low, "service") & _any_word(low, "unavailable", "connection refused"), CI_FIXES["service"])
        .when(_any_word(low, "runner") & _any_word(low, "unsupported", "not found"), CI_FIXES["runner"])
    )
    return F.coalesce(F.when(kind == "ci_failure", refined), _lookup(FIX_BY_KIND, kind))


def confidence_of(kind: Column, message: Column, frames: Column, tests: Column, hits_change: Column) -> Column:
    """Band from the evidence at hand; ``frames`` and ``tests`` are counts."""
    known = kind.isin(*[k for k in HYPOTHESIS_BY_KIND if k != "unknown"])
    located = (frames > 0) | (tests > 0)
    return (
        F.when(~known, "low")
        .when((message != "") & located & hits_change, "high")
        .when(located, "medium")
        .otherwise("low")
    )


def completeness(kind: Column, has_primary: Column, message: Column, located: Column, hits_change: Column,
                 enriched: Column) -> Column:
    """``struct<score, reasons>``: share of evidence collected, capped at 0.95."""
    parts = [
        (kind != "unknown", 20, "recognized failure kind"),
        (has_primary, 15, "primary failure event observed"),
        (message != "", 10, "concrete failure message observed"),
        (located, 20, "stack frame or failed test observed"),
        (hits_change, 15, "stack frame intersects the explicit repository diff"),
        (enriched, 10, "bounded connector evidence observed"),
    ]
    points = F.lit(10)
    for condition, weight, _ in parts:
        points = points + F.when(condition, weight).otherwise(0)
    reasons = F.filter(F.array(*[F.when(c, F.lit(text)) for c, _, text in parts]), lambda r: r.isNotNull())
    return F.struct(
        (F.least(points, F.lit(95)) / F.lit(100)).cast("double").alias("score"),
        F.when(F.size(reasons) == 0, F.array(F.lit("no deterministic failure evidence"))).otherwise(reasons).alias("reasons"),
    )
