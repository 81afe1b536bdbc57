"""Static-analysis findings from SARIF documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.redaction import redact
from faultlens.functions.text import clip

_RULE = "struct<id:string,name:string,defaultConfiguration:struct<level:string>,properties:string>"
_LOCATION = (
    "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>"
)
_RESULT = (
    "struct<ruleId:string,ruleIndex:int,ruleName:string,level:string,message:string,properties:string,"
    f"suppressions:string,locations:array<{_LOCATION}>>"
)
SCHEMA = f"runs array<struct<tool:struct<driver:struct<name:string,rules:array<{_RULE}>>>,results:array<{_RESULT}>>>"
LEVELS = ("critical", "error", "warning", "note", "none")


def _safe(value: Column) -> Column:
    return redact(F.coalesce(value, F.lit("")))


def _property(source: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(source, f"$['{name}']"), F.lit("")) for name in names])


def sarif_findings(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """One row per result with resolved rule, level, location and suppression."""
    runs = df.select(key, F.posexplode(F.from_json(text, SCHEMA)["runs"]).alias("run", "r"))
    results = runs.select(
        key, "run", F.col("r.tool.driver.name").alias("tool"), F.col("r.tool.driver.rules").alias("rules"),
        F.posexplode("r.results").alias("pos", "x"),
    ).filter(F.col("x").isNotNull())
    index = F.col("x.ruleIndex")
    indexed = F.when(index >= 0, F.try_element_at("rules", index + 1))
    rule_id = F.coalesce("x.ruleId", indexed["id"], F.lit("unknown"))
    named = results.withColumn("_id", rule_id).withColumn(
        "_rule", F.coalesce(F.try_element_at(F.filter("rules", lambda r: r["id"] == F.col("_id")), F.lit(-1)), indexed))
    stated = F.col("x.level")
    base = F.lower(F.when(stated.isin(*LEVELS), stated).otherwise(
        F.coalesce("_rule.defaultConfiguration.level", F.lit("warning"))))
    own, inherited = F.col("x.properties"), F.col("_rule.properties")
    usable = own.isNull() | own.startswith("{")
    security = F.coalesce(F.get_json_object(own, "$['security-severity']"), F.get_json_object(inherited, "$['security-severity']"))
    problem = F.coalesce(_property(own, "problem.severity", "severity"), _property(inherited, "problem.severity", "severity"))
    critical = usable & (
        F.coalesce(F.lower(problem) == "critical", F.lit(False)) | F.coalesce(security.try_cast("double") >= 9.0, F.lit(False)))
    message = F.when(F.col("x.message").startswith("{"), F.get_json_object("x.message", "$.text")).otherwise(F.col("x.message"))
    suppressed = F.coalesce(F.exists(
        F.from_json("x.suppressions", "array<struct<status:string>>"),
        lambda s: s.isNotNull() & (F.coalesce(s["status"], F.lit("accepted")) == "accepted")), F.lit(False))
    place = F.try_element_at(F.col("x.locations"), F.lit(1))["physicalLocation"]
    return named.select(
        key, "run", "pos", _safe(F.col("_id")).alias("rule_id"),
        F.when(critical, "critical").otherwise(base).alias("level"), _safe(message).alias("message"),
        _safe(place["artifactLocation"]["uri"]).alias("file_path"),
        F.coalesce(place["region"]["startLine"], F.lit(0)).alias("start_line"),
        F.coalesce(place["region"]["startColumn"], F.lit(0)).alias("start_column"),
        _safe(F.coalesce(F.nullif("_rule.name", F.lit("")), F.nullif("x.ruleName", F.lit("")), F.col("_id"))).alias("rule_name"),
        _safe(F.coalesce("tool", F.lit("unknown"))).alias("tool"), suppressed.alias("suppressed"),
    )


def first_error(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """(stage, kind, summary, message) from the first result whose stated or rule level is error."""
    runs = df.select(key, F.posexplode(F.from_json(text, SCHEMA)["runs"]).alias("run", "r"))
    rows = runs.select(key, "run", F.col("r.tool.driver.rules").alias("rules"), F.posexplode("r.results").alias("pos", "x"))
    default = F.try_element_at(F.filter("rules", lambda r: r["id"] == F.col("x.ruleId")), F.lit(-1))["defaultConfiguration"]["level"]
    message = F.when(F.col("x.message").startswith("{"), F.coalesce(F.get_json_object("x.message", "$.text"), F.lit("static analysis error"))).otherwise(F.coalesce("x.message", F.lit("static analysis error")))
    errors = rows.withColumn("_level", F.coalesce(F.nullif("x.level", F.lit("")), default, F.lit("warning"))).filter(F.col("_level") == "error")
    lead = errors.groupBy(key).agg(F.min_by(message, F.struct("run", "pos")).alias("message"))
    return lead.select(key, F.lit("build").alias("stage"), F.lit("compilation_error").alias("kind"), clip("message", 200).alias("summary"), "message")


def finding_priority(level: Column, suppressed: Column) -> Column:
    return (
        F.when(suppressed, 4).when(level == "critical", 0).when(level == "error", 1)
        .when(level == "warning", 2).when(level == "note", 3).otherwise(4)
    )


def finding_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts per level without suppressed findings; critical ones also count as errors."""
    live = ~F.col("suppressed")
    return findings.groupBy(*keys).agg(
        F.count_if(live & F.col("level").isin("error", "critical")).alias("error_count"),
        F.count_if(live & (F.col("level") == "critical")).alias("critical_count"),
        F.count_if(live & (F.col("level") == "warning")).alias("warning_count"),
        F.count_if(live & (F.col("level") == "note")).alias("note_count"),
        F.count(F.lit(1)).alias("processed_count"),
    )


def finding_summary(findings: DataFrame, *keys: str, shown: int | None = None) -> DataFrame:
    """Counts per level and how many findings a view of the top ``shown`` leaves out."""
    counts = finding_counts(findings, *keys)
    omitted = F.lit(0) if shown is None else F.greatest(F.lit(0), F.col("processed_count") - shown)
    return counts.withColumn("omitted_count", omitted.cast("bigint")).withColumn("truncated", omitted > 0)


def top_findings(findings: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """The most important findings per key for a report view; counts come from :func:`finding_counts`."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(finding_priority(F.col("level"), F.col("suppressed")), *order)
    ranked = findings.withColumn("rank", F.row_number().over(window))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)
