"""Merged coverage, rates, changed-line coverage and coverage delta, for any number of gates at once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.text import normalize_path, ratio
from faultlens.plans.joins import glob_to_regex, suffix_match


def merge_lines(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best hit count per (keys, path, line) over all reports."""
    return rows.filter(F.col("line").isNotNull()).groupBy(*keys, "path", "line").agg(F.max("hits").alias("hits"))


def merge_branches(rows: DataFrame, keys: Sequence[str] = (), report: Sequence[str] = ("report_id", "block")) -> DataFrame:
    """Branch counters per (keys, path): the best report counts; more than one report with branches is incomplete."""
    per_report = rows.groupBy(*keys, *report, "path").agg(
        F.sum("b_total").alias("b_total"), F.sum("b_covered").alias("b_covered"))
    return per_report.groupBy(*keys, "path").agg(
        F.max("b_total").alias("branches_total"), F.max("b_covered").alias("branches_covered"),
        (F.count_if(F.col("b_total") > 0) <= 1).alias("branch_data_complete"))


def file_totals(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals and rate per file of merged lines."""
    return lines.groupBy(*keys, "path").agg(
        F.count(F.lit(1)).alias("lines_total"), F.count_if(F.col("hits") > 0).alias("lines_covered")
    ).withColumn("line_rate", ratio(F.col("lines_covered"), F.col("lines_total"), 4, 1.0))


def report_totals(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals and rate over all files; empty coverage has rate 1.0."""
    rows = lines.groupBy(*keys) if keys else lines.groupBy()
    return rows.agg(
        F.count(F.lit(1)).alias("lines_total"), F.count_if(F.col("hits") > 0).alias("lines_covered"),
        F.countDistinct("path").alias("files"),
    ).withColumn("line_rate", ratio(F.col("lines_covered"), F.col("lines_total"), 4, 1.0))


def in_scope(path: Column, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> Column:
    """Path matches some include glob and no exclude glob."""
    clean = normalize_path(path)
    any_of = lambda globs: F.lit(False) if not globs else _any(clean, globs)
    return any_of(include) & ~any_of(exclude)


def _any(path: Column, globs: Sequence[str]) -> Column:
    result = F.lit(False)
    for glob in globs:
        result = result | path.rlike(glob_to_regex(glob.replace("\\", "/").removeprefix("./")))
    return result


def changed_line_detail(changed: DataFrame, lines: DataFrame, gate: str = "gate_id", lines_gate: bool = False) -> DataFrame:
    """Per gate: covered and mapped changed lines, unmapped lines, and changed files without exactly one stored match.

    ``lines_gate`` tells whether the coverage lines carry the gate key; otherwise they are shared by all gates.
    """
    keys = [gate] if lines_gate else []
    changed = changed.select(gate, normalize_path("path").alias("path"), "line").distinct()
    wanted = changed.select(*(keys or []), F.col("path").alias("changed_path")).distinct()
    stored = lines.select(*keys, F.col("path").alias("stored_path")).distinct()
    if keys:
        pairs = suffix_match(wanted, stored, "changed_path", "stored_path", keys).distinct()
    else:
        one = lambda df: df.withColumn("_all", F.lit(0))
        pairs = suffix_match(one(wanted), one(stored), "changed_path", "stored_path", ["_all"]).distinct()
    matches = pairs.groupBy(*keys, "changed_path").agg(F.count(F.lit(1)).alias("_n"), F.min("stored_path").alias("stored_path"))
    unique = matches.filter(F.col("_n") == 1).select(*keys, F.col("changed_path").alias("path"), "stored_path")
    located = changed.join(unique, [*keys, "path"], "left")
    hits = lines.select(*keys, F.col("path").alias("stored_path"), "line", "hits")
    joined = located.join(hits, [*keys, "stored_path", "line"], "left")
    known = F.col("stored_path").isNotNull()
    detail = joined.groupBy(gate).agg(
        F.count_if(known & F.col("hits").isNotNull()).alias("total"),
        F.count_if(F.col("hits") > 0).alias("covered"),
        F.count_if(known & F.col("hits").isNull()).alias("unmapped_lines"),
        F.countDistinct(F.when(~known, F.col("path"))).alias("unavailable_files"),
    )
    return detail.withColumn("rate", ratio(F.col("covered"), F.col("total"), 4, 1.0))


def coverage_delta(lines: DataFrame, keys: Sequence[str] = (), side: str = "side") -> DataFrame:
    """Candidate and baseline rates, their difference, and files that only one side has."""
    per_file = lines.groupBy(*keys, "path").agg(*[
        agg for name in ("candidate", "baseline") for agg in (
            F.count_if(F.col(side) == name).alias(f"{name}_lines"),
            F.count_if((F.col(side) == name) & (F.col("hits") > 0)).alias(f"{name}_hit"),
        )])
    sums = (per_file.groupBy(*keys) if keys else per_file.groupBy()).agg(
        F.sum("candidate_lines").alias("_ct"), F.sum("candidate_hit").alias("_cc"),
        F.sum("baseline_lines").alias("_bt"), F.sum("baseline_hit").alias("_bc"),
        F.count_if((F.col("candidate_lines") > 0) & (F.col("baseline_lines") == 0)).alias("candidate_only_files"),
        F.count_if((F.col("candidate_lines") == 0) & (F.col("baseline_lines") > 0)).alias("baseline_only_files"),
    )
    rates = sums.withColumn("candidate_rate", ratio(F.col("_cc"), F.col("_ct"), 4, 1.0)).withColumn(
        "baseline_rate", ratio(F.col("_bc"), F.col("_bt"), 4, 1.0))
    comparable = (F.col("candidate_only_files") + F.col("baseline_only_files") == 0) & (F.col("_ct") > 0)
    return rates.select(
        *keys, "candidate_rate", "baseline_rate", "candidate_only_files", "baseline_only_files",
        F.when(comparable, F.bround(F.col("candidate_rate") - F.col("baseline_rate"), 4)).alias("delta"))
