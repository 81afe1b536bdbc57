"""Test reports: JUnit XML, generic test JSON and line-delimited Go output.

Readers take a table of documents (key, text) and give long tables; :mod:`faultlens.sources.artifacts` loads files.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultlens.functions.text import clip, duration_ms, leaf_identity, split_lines, strip
from faultlens.operators.history import failure_signature, safe
from faultlens.sources.json_tree import json_nodes
from faultlens.sources.records import read_elements

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_RERUN_TAGS = "flakyFailure|flakyError|rerunFailure|rerunError"
_NOTE = "array<struct<_message:string,_VALUE:string>>"
_CASE_SCHEMA = (
    "_name string, _classname string, _file string, _time string, "
    f"failure {_NOTE}, error {_NOTE}, flakyFailure {_NOTE}, flakyError {_NOTE}, rerunFailure {_NOTE}, rerunError {_NOTE}"
)


def element_blocks(text: Column, tag: str) -> Column:
    """Source of every ``tag`` element, self-closed or not, at any depth; such elements do not nest."""
    name = r"(?:[\w.-]+:)?" + tag
    pattern = f"(?s)<{name}(?=[\\s/>]){_ATTRIBUTES}>(?:(?<=/>)|.*?</{name}\\s*>)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def safe_xml(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents without a document type declaration."""
    return df.filter(~F.upper(F.col(text)).contains("<!DOCTYPE"))


def _note_text(note: Column) -> Column:
    return F.coalesce(F.nullif(note["_message"], F.lit("")), note["_VALUE"], F.lit(""))


def junit_cases(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """One row per testcase: name, suite, time and its ordered failure, error and rerun notes."""
    return cases_of(safe_xml(df, text).select(key, F.posexplode(element_blocks(F.col(text), "testcase")).alias("pos", "_xml")), key)


def read_junit_cases(spark: SparkSession, folder: str, pattern: str = "*.xml", key: str = "path") -> DataFrame:
    """The cases of all reports below a folder, as ``junit_cases`` gives them. A report may be larger than a row: it is read in pieces.

    A case without its end tag is left out.
    """
    elements = read_elements(spark, folder, "testcase", pattern)
    blocks = elements.select(key, "pos", F.try_element_at(element_blocks(F.col("xml"), "testcase"), F.lit(1)).alias("_xml"))
    return cases_of(blocks.filter("_xml IS NOT NULL"), key)


def cases_of(blocks: DataFrame, key: str) -> DataFrame:
    """Cases of testcase elements (``key, pos, _xml``)."""
    parsed = blocks.withColumn("c", F.from_xml("_xml", _CASE_SCHEMA, {"mode": "PERMISSIVE"}))
    kinds = F.regexp_extract_all("_xml", F.lit(r"<(?:[\w.-]+:)?(failure|error)(?=[\s/>])"), F.lit(1))
    body = parsed.select(
        key, "pos", "c",
        kinds.alias("_kinds"),
        F.regexp_extract("_xml", r"<(?:[\w.-]+:)?(" + _RERUN_TAGS + r")(?=[\s/>])", 1).alias("_rerun"),
        F.col("_xml").rlike(r"<(?:[\w.-]+:)?skipped(?=[\s/>])").alias("skipped"),
    )
    empty = F.array().cast(_NOTE)

    def note(kind: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice("_kinds", 1, i + 1), lambda x: x == kind))
        source = F.when(kind == "error", F.coalesce("c.error", empty)).otherwise(F.coalesce("c.failure", empty))
        return F.struct(
            F.when(kind == "error", "error").otherwise("failed").alias("status"),
            F.coalesce(_note_text(F.try_element_at(source, nth)), F.lit("")).alias("message"),
        )

    rerun = F.coalesce(*[
        F.when(F.col("_rerun") == tag, _note_text(F.try_element_at(F.col(f"c.{tag}"), F.lit(1))))
        for tag in _RERUN_TAGS.split("|")
    ], F.lit(""))
    return body.select(
        key, "pos",
        F.coalesce(F.nullif("c._name", F.lit("")), F.lit("unknown")).alias("name"),
        F.coalesce("c._file", "c._classname", F.lit("")).alias("file"),
        F.coalesce(F.nullif("c._classname", F.lit("")), F.nullif("c._file", F.lit("")), F.lit("unknown")).alias("suite"),
        duration_ms(F.col("c._time")).alias("duration_ms"),
        F.transform("_kinds", note).alias("notes"),
        (F.col("_rerun") != "").alias("rerun"), rerun.alias("rerun_message"), "skipped",
    )


def junit_results(df: DataFrame, key: str = "artifact_id", text: str = "text", context: Sequence[str] = ()) -> DataFrame:
    """Full history rows of JUnit reports; reruns expand into failed(1) and passed(2), n failures into n attempts."""
    rows = results_of(junit_cases(df, key, text), key)
    return rows if not context else rows.join(df.select(key, *context), key)


def results_of(cases: DataFrame, key: str = "artifact_id") -> DataFrame:
    """History rows of cases."""
    row = lambda status, attempt, message: F.struct(
        status.alias("status"), attempt.alias("attempt"), message.alias("message"))
    one = lambda status: F.array(row(F.lit(status), F.lit(1), F.lit("")))
    attempts = (
        F.when(F.col("rerun"), F.array(row(F.lit("failed"), F.lit(1), F.col("rerun_message")),
                                       row(F.lit("passed"), F.lit(2), F.lit(""))))
        .when(F.size("notes") > 0, F.transform("notes", lambda n, i: row(n["status"], i + 1, n["message"])))
        .when(F.col("skipped"), one("skipped"))
        .otherwise(one("passed"))
    )
    return cases.select("*", F.inline(attempts)).select(
        key, safe(F.col("suite"), 300).alias("suite"), safe(leaf_identity("name")).alias("test"), "status", "attempt",
        "duration_ms", F.lit("junit").alias("runner"), failure_signature(F.col("message")).alias("failure_signature"))


def junit_failures(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Failing view: first failure or error of each case, rerun cases only when nothing failed."""
    cases = junit_cases(df, key, text).select(
        key, "pos", "name", "file",
        F.when(F.size("notes") > 0, "test_failure").when(F.col("rerun"), "flaky").alias("kind"),
        F.coalesce(F.try_element_at("notes", F.lit(1))["message"], F.col("rerun_message")).alias("assertion"),
    ).filter(F.col("kind").isNotNull())
    return _failing_view(cases, key)


def _failing_view(rows: DataFrame, key: str) -> DataFrame:
    from pyspark.sql import Window

    kept = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos")))
    verdict = rows.groupBy(key).agg(F.max("kind").alias("kind"))  # test_failure sorts after flaky
    return kept.join(verdict, [key, "kind"]).select(key, "kind", "rank", "name", "file", "assertion")


def report_summary(failures: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(stage, kind, summary, message) of each report from its first failing row."""
    lead = failures.groupBy(key, "kind").agg(F.min_by(F.struct("name", "assertion"), "rank").alias("f"))
    verb = F.when(F.col("kind") == "flaky", " was flaky").otherwise(" failed")
    message = F.when(F.col("f.assertion") != "", F.col("f.assertion")).otherwise(F.concat("f.name", verb))
    return lead.select(key, F.lit("test").alias("stage"), "kind", clip(message, 200).alias("summary"), message.alias("message"))


# ------------------------------------------------------------------ generic test JSON

# Outcome words and the keys that hold nested results.
OUTCOMES = {
    "passed": "passed", "pass": "passed", "success": "passed", "ok": "passed", "failed": "failed", "fail": "failed",
    "failure": "failed", "error": "error", "skipped": "skipped", "skip": "skipped", "pending": "skipped",
    "xfailed": "skipped", "rerun": "failed", "unknown": "unknown",
}
RESULT_KEYS = ("tests", "testcases", "results", "children", "cases", "testsuites", "suites")
SECTIONS = ("passed", "failed", "errors", "skipped")


def _field(*names: str) -> Column:
    """First truthy field of a JSON node."""
    values = []
    for name in names:
        value = F.get_json_object("node", f"$.{name}")
        values.append(F.when(~value.isin("", "0", "false", "0.0", "{}"), value))
    return F.coalesce(*values)


def _detail(*names: str) -> Column:
    value = _field(*names)
    nested = F.coalesce(F.get_json_object(value, "$.message"), F.lit(""))
    return F.coalesce(F.when(value.startswith("{"), nested).otherwise(value), F.lit(""))


def test_json_results(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """History rows of test JSON trees: every reachable node with an outcome and a name."""
    nodes = json_nodes(df, key, text)
    section = F.when(
        (F.size("chain") >= 2) & (F.try_element_at("chain", F.lit(-2)) == "summary"), F.try_element_at("chain", F.lit(-1)))
    section = F.when(section.isin(*SECTIONS), section)
    # Drop each ``summary, <section>`` pair; the rest must be result keys.
    path = F.concat(F.lit("/"), F.array_join("chain", "/"), F.lit("/"))
    stripped = F.regexp_replace(path, "(?<=/)summary/(?:" + "|".join(SECTIONS) + ")/", "")
    reachable = stripped.rlike("^/(?:(?:" + "|".join(RESULT_KEYS) + ")/)*/?$")
    table = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    word = F.lower(strip(_field("outcome", "status", "result")))
    outcome = F.when(section.isNotNull(), F.when(section == "errors", "error").otherwise(section)).otherwise(
        F.when(word.isNotNull() & ~word.startswith("{"), F.coalesce(F.try_element_at(table, word), F.lit("unknown"))))
    name = _field("name", "test", "test_name", "id")
    rows = nodes.filter(reachable).select(
        key, "pos", outcome.alias("status"), name.alias("_name"),
        F.coalesce(_field("classname", "file", "suite"), F.lit("unknown")).alias("_suite"),
        duration_ms(_field("duration_ms", "duration", "time")).alias("duration_ms"),
        _detail("message", "error", "traceback").alias("_message"))
    return rows.filter(F.col("status").isNotNull() & F.col("_name").isNotNull()).select(
        key, "pos", safe(F.col("_suite"), 300).alias("suite"), safe(leaf_identity("_name")).alias("test"), "status",
        F.lit(1).alias("attempt"), "duration_ms", F.lit("pytest").alias("runner"),
        failure_signature(F.col("_message")).alias("failure_signature"))


def test_json_failures(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Failing view of any JSON tree: nodes whose outcome, status or state is a failure word."""
    nodes = json_nodes(df, key, text)
    word = F.lower(F.coalesce(_field("outcome", "status", "state"), F.lit("")))
    detail = _field("longrepr", "message", "error")
    detail = F.coalesce(F.when(detail.startswith("{"), F.coalesce(
        F.nullif(F.get_json_object(detail, "$.message"), F.lit("")), F.get_json_object(detail, "$.stack"), F.lit(""))).otherwise(detail), F.lit(""))
    file = F.coalesce(_field("file"), F.get_json_object("node", "$.location.file"), F.lit(""))
    rows = nodes.filter(word.isin("failed", "failure", "error", "fail")).select(
        key, "pos", F.lit("test_failure").alias("kind"),
        F.coalesce(_field("nodeid", "fullTitle", "title", "name"), F.lit("unknown")).alias("name"),
        file.alias("file"), detail.alias("assertion"))
    return _failing_view(rows, key)


def go_json_failures(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Failed tests of ``go test -json`` output with the text printed before the failure."""
    schema = "Action string, Package string, Test string, Output string"
    lines = df.select(key, F.posexplode(split_lines(text)).alias("pos", "_line")).select(
        key, "pos", F.from_json("_line", schema).alias("r")).select(key, "pos", "r.*").filter(F.col("Test").isNotNull())
    fails = lines.filter(F.col("Action") == "fail").groupBy(key, "Test").agg(
        F.min("pos").alias("fail_pos"), F.min_by("Package", "pos").alias("file"))
    spoken = lines.filter(F.col("Output").isNotNull() & (F.col("Output") != ""))
    said = spoken.groupBy(key, "Test").agg(F.array_sort(F.collect_list(F.struct("pos", "Output"))).alias("_out"))
    joined = fails.join(said, [key, "Test"], "left")
    before = F.filter("_out", lambda o: o["pos"] <= F.col("fail_pos"))
    text_of = F.coalesce(F.array_join(F.transform(before, lambda o: o["Output"]), ""), F.lit(""))
    rows = joined.select(
        key, F.col("fail_pos").alias("pos"), F.lit("test_failure").alias("kind"), F.col("Test").alias("name"),
        F.coalesce("file", F.lit("")).alias("file"), text_of.alias("assertion"))
    return _failing_view(rows, key)


def detect_runner(text: Column, ext: Column) -> Column:
    """Runner from the file suffix, then from words of the log."""
    low = F.lower(text)
    return (
        F.when(ext == ".xml", "junit").when(ext == ".sarif", "unknown")
        .when(low.contains("pytest") | low.contains("short test summary info"), "pytest")
        .when(low.contains("vitest") | low.rlike(r"^\s*run\s+v\d+\.\d+"), "vitest")
        .when(low.contains("jest"), "jest").when(low.contains("--- fail:"), "go")
        .when(low.contains("panicked at") & low.contains("failures:"), "cargo")
        .when(low.contains("rspec"), "rspec")
        .when(low.contains(".cs:line") | (low.contains(".cs") & low.contains("failed")), "dotnet")
        .otherwise("unknown")
    )


def import_results(artifacts: DataFrame, key: str = "artifact_id") -> DataFrame:
    """History rows of a mixed artifact table (key, ext, text): XML, JSON and logs each by their own reader."""
    from faultlens.operators.extract import failed_test_table
    from faultlens.operators.history import from_failed_tests

    columns = [key, "suite", "test", "status", "attempt", "duration_ms", "runner", "failure_signature"]
    xml = junit_results(artifacts.filter(F.col("ext") == ".xml"), key).select(*columns)
    tree = test_json_results(artifacts.filter(F.col("ext") == ".json"), key).select(*columns)
    logs = artifacts.filter(F.col("ext").isin(".log", ".txt", ""))
    runner = logs.select(key, detect_runner(F.col("text"), F.col("ext")).alias("_runner"))
    failed = failed_test_table(logs, key).join(runner, key)
    rows = from_failed_tests(failed, F.col("_runner"), [key]).select(*columns)
    return xml.unionByName(tree).unionByName(rows)
