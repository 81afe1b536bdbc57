"""Source context and test impact over tables of symbols, calls and test files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.operators import triage
from faultlens.plans.joins import interval_join, mentions


def related_tests(sources: DataFrame, test_files: DataFrame, limit: int | None = None) -> DataFrame:
    """Test files (path holds ``test``) that mention a source's stem or symbol, ranked by path per (file, symbol); the first ``limit`` of each if given.

    A mention is a substring. Identifier needles are looked for inside identifier tokens, others in the whole text.
    """
    name = F.element_at(F.split("file", "/"), -1)
    stem = F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    needles = sources.select("file", "symbol", F.explode(F.array_distinct(F.array(stem, F.coalesce("symbol", F.lit(""))))).alias("needle"))
    needles = needles.filter(F.col("needle") != "").distinct()
    tests = test_files.filter(F.lower("path").contains("test")).select("path", "text")
    identifier = F.col("needle").rlike(r"^[\p{L}\p{N}_]+$")
    tokens = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    unique = needles.select("needle").distinct()
    hits = mentions(tests, "path", tokens, unique.filter(identifier)).unionByName(
        mentions(tests, "path", F.array("text"), unique.filter(~identifier)))
    matched = needles.join(hits, "needle").select("file", "symbol", "path").distinct()
    ranked = matched.withColumn("rank", F.row_number().over(Window.partitionBy("file", "symbol").orderBy("path")))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (caller, callee, file, depth) to depth 2 between known symbols; the least depth counts, no self edges."""
    known = symbols.select(F.col("name").alias("callee")).distinct()
    direct = calls.join(known, "callee", "left_semi").select("file", "caller", "callee").distinct()
    second = direct.select("file", "caller", F.col("callee").alias("_via")).join(
        direct.select(F.col("caller").alias("_via"), "callee").distinct(), "_via").select("file", "caller", "callee")
    edges = direct.withColumn("depth", F.lit(1)).unionByName(second.withColumn("depth", F.lit(2)))
    return edges.filter(F.col("caller") != F.col("callee")).groupBy("file", "caller", "callee").agg(
        F.min("depth").alias("depth")).withColumn("label", F.lit("static_candidate"))


def recommend_tests(sources: DataFrame, related: DataFrame, edges: DataFrame, coverage: DataFrame | None = None,
                    history: DataFrame | None = None, change: str = "change_id", limit: int | None = None) -> DataFrame:
    """Scored tests per change: direct 100, coverage 70, dependency 50, history up to 20; ranked by score and name, the best ``limit`` if given.

    ``sources`` (change, file, symbol, changed), ``related`` (change, file, symbol, test), ``coverage`` (key, test),
    ``history`` (test, correlation).
    """
    key = [change, "file", "symbol"]
    linked = sources.join(related, key)
    scored = linked.select(change, "test", F.lit(100.0).alias("score"))
    if coverage is not None:
        keys = sources.select(change, F.explode(F.array_distinct(F.array("file", F.coalesce("symbol", F.lit(""))))).alias("key")).filter(F.col("key") != "")
        scored = scored.unionByName(keys.join(coverage, "key").select(change, "test", F.lit(70.0).alias("score")))
    moved = sources.filter(F.col("changed") & (F.coalesce("symbol", F.lit("")) != "")).select(change, "symbol").distinct()
    out = moved.join(edges.select(F.col("caller").alias("symbol"), F.col("callee").alias("_dep")).distinct(), "symbol")
    back = moved.join(edges.select(F.col("callee").alias("symbol"), F.col("caller").alias("_dep")).distinct(), "symbol")
    dependent = out.unionByName(back).select(change, F.col("_dep").alias("symbol")).distinct()
    scored = scored.unionByName(linked.join(dependent, [change, "symbol"], "left_semi").select(change, "test", F.lit(50.0).alias("score")))
    totals = scored.groupBy(change, "test").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("reasons"))
    if history is not None:
        bounded = F.least(F.col("correlation"), F.lit(1.0))
        totals = totals.join(history.filter(F.col("correlation") > 0).select("test", (bounded * 20.0).alias("_h")), "test", "left").select(
            change, "test", (F.col("score") + F.coalesce("_h", F.lit(0.0))).alias("score"),
            (F.col("reasons") + F.col("_h").isNotNull().cast("int")).alias("reasons"))
    window = Window.partitionBy(change).orderBy(F.desc("score"), "test")
    ranked = totals.withColumn("rank", F.row_number().over(window))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.withColumn("score", F.bround("score", 2))


def recommendation_recall(recommended: DataFrame, expected: DataFrame, change: str = "change_id") -> DataFrame:
    """Share of expected tests that were recommended, per change."""
    hit = recommended.select(change, "test", F.lit(1).alias("_hit")).distinct()
    return expected.select(change, "test").distinct().join(hit, [change, "test"], "left").groupBy(change).agg(
        F.bround(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))


def enclosing_symbols(frames: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """Narrowest symbol (file, name, start_line, end_line) around each frame line."""
    joined = interval_join(frames, symbols, ["file"], "line", "start_line", "end_line", width)
    size = F.col("end_line") - F.col("start_line")
    return joined.groupBy(*frames.columns).agg(F.min_by(F.struct("name", "start_line", "end_line"), F.struct(size, "start_line", "name")).alias("_s")).select(
        *frames.columns, F.col("_s.name").alias("symbol"), "_s.start_line", "_s.end_line")


def source_evidence(frames: DataFrame, symbols: DataFrame, changed: DataFrame, rules: DataFrame, commits: DataFrame,
                    scope: str = "scope", key: str = "artifact_id", limit: int | None = None) -> DataFrame:
    """One row per (key, frame file): first line, symbol, changed flag, owners and latest commit subject."""
    firsts = frames.groupBy(key, scope, "file").agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"))
    ranked = firsts if limit is None else firsts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("rank") <= limit)
    located = enclosing_symbols(ranked.select(key, "file", "line"), symbols).select(key, "file", "symbol")
    touched = triage.frames_on_changed_files(ranked, changed, key)
    latest = commits.groupBy("path").agg(F.max_by("subject", F.struct("ts", "sha")).alias("subject"))
    hit = touched.join(latest, "path", "left").groupBy(key, "file").agg(F.min_by("subject", "path").alias("commit"))
    owners = triage.resolve_owners(ranked.select(scope, F.col("file").alias("path")), rules, scope).withColumnRenamed("path", "file")
    return (
        ranked.join(located, [key, "file"], "left").join(hit.withColumn("changed", F.lit(True)), [key, "file"], "left")
        .join(owners, [scope, "file"], "left")
        .select(key, "file", "line", F.coalesce("symbol", F.lit("")).alias("symbol"), F.coalesce("changed", F.lit(False)).alias("changed"),
                "owners", F.coalesce("commit", F.lit("")).alias("commit"))
    )
