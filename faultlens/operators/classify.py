"""Stage and kind classification of whole logs and single lines.

Everything stays inside one row: no shuffle, no Python. A log is classified by the earliest strong failure signal;
ordered predicates decide only when no signal is found.
"""
from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import (
    clip, first, found, group, let, normalize_lines, place, split_lines, strip, unwrap_line, whole,
)

# Kinds that name a deployment problem, its aggregate symptoms and its direct causes.
DEPLOY_KINDS = (
    "deployment_failed", "rollback", "health_check_failed", "image_pull_error", "migration_failed",
    "permission_error", "readiness_timeout", "oom_killed", "crash_loop", "liveness_probe_failed",
    "readiness_probe_failed", "scheduling_failed", "quota_exceeded", "network_failure",
    "registry_auth_failure", "config_missing",
)
AGGREGATE_DEPLOY_KINDS = ("readiness_timeout", "health_check_failed", "deployment_failed")
DIRECT_DEPLOY_KINDS = (
    "registry_auth_failure", "image_pull_error", "oom_killed", "crash_loop", "liveness_probe_failed",
    "readiness_probe_failed", "scheduling_failed", "quota_exceeded", "config_missing", "migration_failed",
    "network_failure", "permission_error",
)

# Fixed values: (pattern, kind, priority); a lower priority wins a tie on position.
SIGNALS = (
    (P.REGISTRY_AUTH, "registry_auth_failure", 10),
    (P.IMAGE_PULL, "image_pull_error", 11),
    (P.OOM, "oom_killed", 12),
    (P.CRASH_LOOP, "crash_loop", 13),
    (P.LIVENESS, "liveness_probe_failed", 14),
    (P.READINESS_PROBE, "readiness_probe_failed", 15),
    (P.SCHEDULING, "scheduling_failed", 16),
    (P.QUOTA, "quota_exceeded", 17),
    (P.CONFIG, "config_missing", 18),
    (P.MIGRATION, "migration_failed", 19),
    (P.DEPLOY_TIMEOUT, "readiness_timeout", 20),
    (P.HEALTH, "health_check_failed", 21),
    (P.ROLLBACK, "rollback", 22),
    (P.NETWORK, "network_failure", 23),
    (P.PERMISSION, "permission_error", 24),
    (P.DEPLOY_FAILURE, "deployment_failed", 25),
    (P.DEPENDENCY, "dependency_resolution", 30),
    (P.DISK_FULL, "disk_full", 31),
    (P.TLS, "tls_certificate_error", 32),
    (P.IMPORT, "import_error", 33),
    (P.COMPILE, "compilation_error", 34),
    (P.TIMEOUT, "timeout", 35),
    (P.RATE_LIMIT, "api_rate_limited", 36),
    (P.TEST_FAIL, "test_failure", 41),
    (P.CI_FAILURE, "ci_failure", 60),
)

# The order in which a deploy-stage text is tested for a kind.
DEPLOY_KIND_ORDER = (
    (P.REGISTRY_AUTH, "registry_auth_failure"),
    (P.IMAGE_PULL, "image_pull_error"),
    (P.OOM, "oom_killed"),
    (P.CRASH_LOOP, "crash_loop"),
    (P.LIVENESS, "liveness_probe_failed"),
    (P.READINESS_PROBE, "readiness_probe_failed"),
    (P.SCHEDULING, "scheduling_failed"),
    (P.QUOTA, "quota_exceeded"),
    (P.NETWORK, "network_failure"),
    (P.CONFIG, "config_missing"),
    (P.MIGRATION, "migration_failed"),
    (P.PERMISSION, "permission_error"),
)


def _cases(pairs, default) -> Column:
    chain = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default)


def stage_of(text: Column) -> Column:
    """Stage of normalized text by the first matching marker family."""
    return let(_lowered(text), lambda r: _stage_of(partial(found, r["text"], low=r["low"])))


def _lowered(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lower(text).alias("low"))


def _stage_of(has) -> Column:
    return _cases(
        [
            (has(P.DEPLOY_MARKERS), "deploy"),
            (has(P.DEPENDENCY), "build"),
            (has(P.TEST_MARKERS) | has(P.PYTEST_FAILED), "test"),
            (has(P.COMPILE), "build"),
            (has(P.CI_FOOTER), "ci"),
            (has(P.BUILD_MARKERS), "build"),
            (has(P.TLS), "build"),
            (has(P.CI_MARKERS), "ci"),
            (has(P.GENERIC_ERROR), "build"),
        ],
        F.lit("unknown"),
    )


def kind_of(text: Column, stage: Column, flaky: Column | None = None) -> Column:
    """Failure kind of normalized text whose stage is known.

    ``flaky`` carries rerun proof for whole logs; on one line only a runner summary can prove it.
    """
    # A lambda sees the columns of its row as values, so stage and proof are bound with the text.
    bound = F.struct(text.alias("text"), F.lower(text).alias("low"), stage.alias("stage"), (F.lit(None).cast("boolean") if flaky is None else flaky).alias("flaky"))
    return let(bound, lambda r: _kind_of(partial(found, r["text"], low=r["low"]), r["stage"], None if flaky is None else r["flaky"]))


def _kind_of(has, stage: Column, flaky: Column | None) -> Column:
    flaky = has(P.JEST_FLAKY_SUMMARY) if flaky is None else flaky
    deploy = [(has(pattern), kind) for pattern, kind in DEPLOY_KIND_ORDER]
    deploy += [
        (has(P.ROLLBACK) & ~has(P.ROLLBACK_DONE_ANYWHERE), "rollback"),
        (has(P.DEPLOY_TIMEOUT), "readiness_timeout"),
        (has(P.HEALTH) | has(P.READINESS), "health_check_failed"),
        (has(P.DEPLOY_FAILURE), "deployment_failed"),
    ]
    common = [
        (has(P.DEPENDENCY), "dependency_resolution"),
        (has(P.DISK_FULL), "disk_full"),
        (has(P.TLS), "tls_certificate_error"),
        (has(P.RATE_LIMIT) & (stage != "deploy"), "api_rate_limited"),
        (has(P.IMPORT), "import_error"),
        (has(P.CRASH) & (stage == "test"), "test_failure"),
        (has(P.CRASH), "compilation_error"),
        (has(P.TIMEOUT), "timeout"),
        (has(P.COMPILE), "compilation_error"),
        ((stage == "test") & flaky, "flaky"),
        (has(P.TEST_FAIL), "test_failure"),
        (has(P.CI_FAILURE), "ci_failure"),
    ]
    deploy_kind = _cases(deploy, F.lit(None).cast("string"))
    return F.coalesce(F.when(stage == "deploy", deploy_kind), _cases(common, F.lit("unknown")))


def _first_then(records: Column, earlier: str, later: str) -> Column:
    """Whether some name's first ``earlier`` precedes its first ``later`` among (name, pos, result) records."""
    relevant = F.array_sort(F.filter(records, lambda r: r["result"].isin(earlier, later)))
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit("").alias("opening"), F.lit(False).alias("hit"))

    def step(state, r):
        same = state["name"] == r["name"]
        return F.struct(
            r["name"].alias("name"),
            F.when(same, state["opening"]).otherwise(r["result"]).alias("opening"),
            (state["hit"] | F.coalesce(same & (state["opening"] == earlier) & (r["result"] == later), F.lit(False)))
            .alias("hit"),
        )

    return F.aggregate(relevant, start, step, lambda state: state["hit"])


def flaky_proof(text: Column, lines: Column) -> Column:
    """Rerun-then-pass evidence: pytest RERUN before PASSED, Go repeat FAIL before PASS, or a flaky summary.

    A marked-failed test that later passes is covered by the runner's own summary line.
    """
    def rerun_record(line, position):
        name = F.coalesce(F.nullif(group(line, P.RERUN_RESULT, 1), F.lit("")), group(line, P.RERUN_RESULT, 4))
        result = F.coalesce(F.nullif(group(line, P.RERUN_RESULT, 2), F.lit("")), group(line, P.RERUN_RESULT, 3))
        return F.struct(name.alias("name"), position.alias("pos"), result.alias("result"))

    def go_record(line, position):
        return F.struct(
            group(line, P.GO_RESULT, 2).alias("name"), position.alias("pos"), group(line, P.GO_RESULT, 1).alias("result")
        )

    reruns = F.transform(F.filter(lines, lambda x: x.rlike(r"RERUN|PASSED")), rerun_record)
    go_rows = F.transform(F.filter(lines, lambda x: x.startswith("--- ")), go_record)
    return (
        (text.contains("RERUN") & _first_then(reruns, "RERUN", "PASSED"))
        | (found(text, P.GO_COUNT) & _first_then(go_rows, "FAIL", "PASS"))
        | found(text, P.JEST_FLAKY_SUMMARY)
    )


def _stage_near(text: Column, position: Column, kind: str) -> Column:
    """Stage of a context-dependent signal, from at most 2 500 characters before it up to the end of its line."""
    start = F.greatest(position - 2500, F.lit(1))

    def decide(window: Column) -> Column:
        ci = found(window, P.CI_MARKERS) | found(window, P.CI_FOOTER)
        if kind == "api_rate_limited":
            return F.when(found(window, P.DEPLOY_MARKERS), "deploy").otherwise("ci")
        if kind == "timeout":
            return _cases(
                [
                    (found(window, P.DEPLOY_MARKERS), "deploy"),
                    (ci, "ci"),
                    (found(window, P.TEST_MARKERS) | found(window, P.PYTEST_FAILED), "test"),
                    (found(window, P.COMPILE) | found(window, P.BUILD_MARKERS), "build"),
                    (found(text, P.CI_MARKERS) | found(text, P.CI_FOOTER), "ci"),
                ],
                F.lit("unknown"),
            )
        return F.when(ci, "ci").otherwise("build")

    tail = F.substring_index(F.substr(text, position), "\n", 1)
    window = F.concat(F.substr(text, start, position - start), tail)
    return let(window, decide)


def _signals(text: Column, flaky: Column) -> Column:
    """Matched signals as (pos, prio, kind), unordered."""
    def listed(r: Column) -> Column:
        slots = []
        for pattern, kind, priority in SIGNALS:
            position = place(r["text"], pattern, r["low"])
            if kind == "rollback":
                position = F.when(found(r["text"], P.ROLLBACK_DONE_NEAR, r["low"]), 0).otherwise(position)
            if kind == "test_failure":
                position = F.when(r["flaky"], 0).otherwise(position)
            slots.append((position, kind, priority))
        located = F.greatest(F.regexp_instr(r["text"], F.lit(P.FLAKY_POSITION)), F.lit(1))
        slots.append((F.when(r["flaky"], located).otherwise(0), "flaky", 40))
        return F.array(*[
            F.struct(position.cast("int").alias("pos"), F.lit(priority).alias("prio"), F.lit(kind).alias("kind"))
            for position, kind, priority in slots
        ])

    return let(F.struct(text.alias("text"), F.lower(text).alias("low"), flaky.alias("flaky")), listed)


def _with_stage(text: Column, signal: Column) -> Column:
    """Attach the stage; only five kinds need to look at the surrounding text."""
    contextual = ("dependency_resolution", "disk_full", "tls_certificate_error", "timeout", "api_rate_limited")
    position = signal["pos"]
    stage = _cases(
        [(signal["kind"].isin(*DEPLOY_KINDS), "deploy"),
         (signal["kind"].isin("test_failure", "flaky"), "test"),
         (signal["kind"].isin("compilation_error", "import_error"), "build"),
         (signal["kind"] == "ci_failure", "ci")]
        + [(signal["kind"] == kind, _stage_near(text, position, kind)) for kind in contextual],
        F.lit("unknown"),
    )
    return F.struct(position.alias("pos"), signal["prio"].alias("prio"), signal["kind"].alias("kind"), stage.alias("stage"))


def _is_summary_row(text: Column, position: Column) -> Column:
    """The signal's line is a bare runner summary without any diagnostic word."""
    before = F.substring_index(F.substr(text, F.lit(1), position - 1), "\n", -1)
    line = F.concat(before, F.substring_index(F.substr(text, position), "\n", 1))
    return let(line, lambda x: found(x, P.SUMMARY_TEST_LINE) & ~found(x, P.SUMMARY_TEST_DETAIL))


def _primary(text: Column, ordered: Column) -> Column:
    """The signal that names the failure: earliest, with two exceptions."""
    timeout = F.filter(ordered, lambda s: s["kind"] == "timeout")
    test = first(F.filter(ordered, lambda s: s["kind"] == "test_failure"))
    promote = (F.size(timeout) > 0) & F.coalesce(_is_summary_row(text, test["pos"]), F.lit(False))
    queue = F.when(
        promote, F.concat(timeout, F.filter(ordered, lambda s: s["kind"] != "timeout"))
    ).otherwise(ordered)

    def choose(items: Column) -> Column:
        head = first(items)
        direct = F.filter(items, lambda s: (s["stage"] == "deploy") & s["kind"].isin(*DIRECT_DEPLOY_KINDS))
        aggregate = head["kind"].isin(*AGGREGATE_DEPLOY_KINDS) & (head["stage"] == "deploy")
        return F.when(aggregate & (F.size(direct) > 0), F.array_min(direct)).otherwise(head)

    return let(queue, choose)


def message_of(text: Column, lines: Column) -> Column:
    """The most telling line of a normalized log; ``lines`` are its non-blank lines."""
    strong = F.filter(lines, lambda x: found(x, P.STRONG_ERROR))
    chained = F.when(found(text, P.CHAINED_TRACEBACK) & (F.size(strong) >= 2), F.try_element_at(strong, F.lit(-1)))

    def after(header: str, span: int, wanted) -> Column:
        """For each header line, the first wanted line among the next ``span``; nulls where none."""
        marks = F.filter(
            F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"), found(x, header).alias("hit"))),
            lambda r: r["hit"],
        )
        return F.transform(
            marks,
            lambda r: F.struct(
                r["line"].alias("line"),
                first(F.filter(F.slice(lines, r["i"] + 2, span), wanted)).alias("next"),
            ),
        )

    warnings = F.filter(after(P.K8S_HEADER, 32, lambda x: found(x, P.K8S_WARNING)), lambda r: r["next"].isNotNull())
    kubernetes = F.when(text.contains(":") & text.rlike("(?i)events:"), first(warnings)["next"])
    npm_rows = first(after(P.NPM_CODE, 5, lambda x: found(x, P.NPM_ROW) & ~found(x, P.NPM_NOISE)))
    npm = F.when(text.rlike("(?i)npm ERR!"), F.coalesce(npm_rows["next"], npm_rows["line"]))
    return strip(F.coalesce(
        chained,
        kubernetes,
        npm,
        first(strong),
        first(F.filter(lines, lambda x: found(x, P.TEST_FAIL))),
        first(F.filter(lines, lambda x: found(x, P.ERROR_LINE))),
        F.try_element_at(lines, F.lit(-1)),
        F.lit(""),
    ))


def summary_of(kind: Column, message: Column) -> Column:
    return F.when(message == "", F.concat(F.lit("failure detected ("), kind, F.lit(")"))).otherwise(clip(message, 200))


def classify_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``stage`` and ``kind`` of every single line."""
    clean = df.withColumn("_clean", unwrap_line(F.regexp_replace(F.col(line), P.ANSI, "")))
    staged = clean.withColumn("stage", stage_of(F.col("_clean")))
    return staged.withColumn("kind", kind_of(F.col("_clean"), F.col("stage"))).drop("_clean")


def failure_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``signals``: matched failure signals with stage, ordered by (pos, prio)."""
    return (
        df.withColumn("_lines1", normalize_lines(text))
        .withColumn("_text1", F.array_join("_lines1", "\n"))
        .withColumn("_flaky", flaky_proof(F.col("_text1"), F.col("_lines1")))
        .withColumn("_hits", F.filter(_signals(F.col("_text1"), F.col("_flaky")), lambda s: s["pos"] > 0))
        .withColumn("signals", F.array_sort(F.transform("_hits", lambda s: _with_stage(F.col("_text1"), s))))
        .drop("_hits")
    )


def classify_artifacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``stage``, ``kind``, ``summary`` and ``message`` of each log."""
    text1 = F.col("_text1")
    located = failure_signals(df, text).withColumn(
        "_primary", F.when(F.size("signals") > 0, _primary(text1, F.col("signals")))
    )
    # Fallback stage, kind and the message see the prefix rule applied a second time.
    deeper = located.withColumn("_lines2", normalize_lines(text1)).withColumn("_text2", F.array_join("_lines2", "\n"))
    text2 = F.col("_text2")
    staged = deeper.withColumn("_stage", F.when(F.col("_primary").isNull(), stage_of(text2)))
    kinded = staged.withColumn(
        "kind",
        F.when(F.col("_primary").isNotNull(), F.col("_primary.kind"))
        .otherwise(kind_of(text2, F.col("_stage"), F.col("_flaky"))),
    )
    decided = kinded.withColumn(
        "stage",
        F.when(F.col("kind") == "unknown", "unknown").otherwise(F.coalesce("_primary.stage", "_stage")),
    ).withColumn("_rows", F.filter("_lines2", lambda x: strip(x) != ""))
    return (
        decided.withColumn("message", message_of(text2, F.col("_rows")))
        .withColumn("summary", summary_of(F.col("kind"), F.col("message")))
        .drop("_lines1", "_text1", "_lines2", "_text2", "_flaky", "_primary", "_stage", "_rows", "signals")
    )


# ------------------------------------------------------------------ events

def trace_of(line: Column) -> Column:
    """``struct<trace_id, span_id, parent_span_id>``; a traceparent's span is the initiating parent."""
    def judge(r: Column) -> Column:
        explicit = (r["trace"] != "") | (r["span"] != "") | r["parent"].isNotNull()
        context = lambda index: group(line, P.TRACEPARENT, index)
        return F.struct(
            F.when(explicit, r["trace"]).otherwise(context(1)).alias("trace_id"),
            F.when(explicit, r["span"]).otherwise("").alias("span_id"),
            F.when(explicit, r["parent"]).otherwise(F.nullif(context(2), F.lit(""))).alias("parent_span_id"),
        )

    return let(F.struct(
        group(line, P.TRACE_FIELD).alias("trace"), group(line, P.SPAN_FIELD).alias("span"),
        F.nullif(group(line, P.PARENT_FIELD), F.lit("")).alias("parent")), judge)


def clock_of(line: Column) -> Column:
    """``struct<timestamp, timestamp_ns, sequence>`` of one line."""
    from faultlens.functions.text import iso_to_ns

    def judge(r: Column) -> Column:
        return F.struct(
            F.when(r["ns"].isNotNull(), "").otherwise(r["iso"]).alias("timestamp"),
            F.coalesce(r["ns"], F.when(r["iso"] != "", iso_to_ns(r["iso"]))).alias("timestamp_ns"),
            F.nullif(r["number"], F.lit("")).cast("int").alias("sequence"),
        )

    return let(F.struct(
        F.nullif(group(line, P.NS_FIELD), F.lit("")).try_cast("bigint").alias("ns"), group(line, P.ISO_TIME).alias("iso"),
        group(line, P.SEQUENCE_FIELD).alias("number")), judge)


_ANY_TRACE = "|".join((P.TRACE_FIELD, P.SPAN_FIELD, P.PARENT_FIELD, P.TRACEPARENT))


def _may_trace(line: Column) -> Column:
    return line.contains("trace") | line.contains("span") | line.contains("parent") | line.contains("00-")


def extract_events(df: DataFrame, text: str = "text", lines: str | None = None) -> DataFrame:
    """Add ``events``: the primary failure, then all distinct downstream failures in log order.

    Needs ``stage``, ``kind`` and ``message``. Only lines with an error word are classified. ``lines`` names a column of the text's lines, if there is one.
    """
    own = lines is None
    if own:
        df, lines = df.withColumn("_lines", F.when(F.col("kind") != "unknown", split_lines(text))), "_lines"
    lines = F.col(lines)
    suspects = F.array_distinct(F.transform(
        F.filter(lines, lambda x: found(x, P.ERROR_LINE)),
        lambda x: F.struct(
            strip(x).alias("message"), unwrap_line(F.regexp_replace(x, P.ANSI, "")).alias("clean")
        ),
    ))
    staged = F.transform(
        F.col("_suspects"),
        lambda e: F.struct(e["message"].alias("message"), e["clean"].alias("clean"), stage_of(e["clean"]).alias("stage")),
    )
    kinded = F.transform(
        F.col("_staged"),
        lambda e: F.struct(
            e["stage"].alias("stage"), kind_of(e["clean"], e["stage"]).alias("kind"), e["message"].alias("message")
        ),
    )
    downstream = F.array_distinct(F.filter(
        F.col("_kinded"),
        lambda e: (e["kind"] != "unknown")
        & ~((e["stage"] == F.col("stage")) & (e["kind"] == F.col("kind")) & (e["message"] == F.col("message"))),
    ))
    traced = first(F.filter(lines, lambda x: _may_trace(x) & x.rlike(_ANY_TRACE)))

    def bare(trace: Column) -> Column:
        return (trace["trace_id"] == "") & (trace["span_id"] == "") & trace["parent_span_id"].isNull()

    # Ids and clock of a line are read once and bound, not once for each of their fields.
    read = F.transform(F.col("_events"), lambda e: F.struct(e.alias("e"), trace_of(e["message"]).alias("own"), clock_of(e["message"]).alias("clock")))

    def describe(row: Column, index: Column) -> Column:
        event, own, clock = row["e"], row["own"], row["clock"]
        inherits = (index == 0) & bare(own)
        field = lambda name: F.when(inherits, F.col("_head")[name]).otherwise(own[name]).alias(name)
        return F.struct(
            F.format_string("ev-%03d", index + 1).alias("event_id"),
            event["stage"].alias("stage"), event["kind"].alias("kind"),
            F.when(index == 0, "primary").otherwise("downstream").alias("role"),
            event["message"].alias("message"),
            field("trace_id"), field("span_id"), field("parent_span_id"),
            clock["timestamp"].alias("timestamp"), clock["timestamp_ns"].alias("timestamp_ns"),
            F.coalesce(clock["sequence"], index + 1).alias("sequence"),
        )

    primary = F.array(F.struct(F.col("stage"), F.col("kind"), F.col("message")))
    return (
        df.withColumn("_suspects", F.when(F.col("kind") != "unknown", suspects))
        .withColumn("_staged", staged)
        .withColumn("_kinded", kinded)
        .withColumn("_traced", F.when(F.col("kind") != "unknown", F.coalesce(traced, F.lit(""))))
        .withColumn("_events", F.when(F.col("kind") != "unknown", F.concat(primary, downstream)))
        .withColumn("_head", trace_of(F.col("_traced")))
        .withColumn("_read", read)
        .withColumn("events", F.coalesce(F.transform("_read", describe), F.array()))
        .drop("_suspects", "_staged", "_kinded", "_traced", "_events", "_head", "_read", *(["_lines"] if own else []))
    )


def event_table(df: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Long form: one row per event with its 1-based ``seq``."""
    return df.select(key, F.posexplode(whole("events")).alias("_p", "e")).select(key, (F.col("_p") + 1).alias("seq"), "e.*")
