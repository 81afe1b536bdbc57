"""Logs of any size as tables of lines: what a log says, from partial results of its pieces.

No operator here needs a log, or many of its lines, in one row. Firsts, lasts and counts combine in any order; what a header says about the
lines after it is looked up by line number, and only in logs that have such headers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import found, strip, unwrap_line
from faultlens.plans.ordered import running_totals

EVENT_LINES, NPM_LINES = 32, 5  # lines looked at after a header


def _clean(line: Column) -> Column:
    """A line as whole-log classification sees it: colours and, twice, runner prefixes and JSON wrappers removed."""
    once = unwrap_line(F.regexp_replace(line, P.ANSI, ""))
    return unwrap_line(F.regexp_replace(once, P.ANSI, ""))


def log_facts(lines: DataFrame, key: str = "artifact_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """One row a log: counts, flags and the first or last line of each kind, as structs ``(order, line)``; null where there is none.

    All of it combines associatively, so pieces of a log are aggregated where they are read.
    """
    rows = lines.select(key, F.col(order).alias("_at"), _clean(F.col(line)).alias("_line"))
    row, full = F.struct("_at", "_line"), strip(F.col("_line")) != ""
    kind = {name: full & found(F.col("_line"), pattern) for name, pattern in (("strong", P.STRONG_ERROR), ("test", P.TEST_FAIL), ("error", P.ERROR_LINE))}
    first = lambda name: F.min(F.when(kind[name], row)).alias(f"first_{name}")
    any_ = lambda pattern: F.coalesce(F.max(found(F.col("_line"), pattern)), F.lit(False))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(kind["error"]).alias("error_lines"), F.count_if(kind["strong"]).alias("strong_lines"),
        first("strong"), F.max(F.when(kind["strong"], row)).alias("last_strong"), first("test"), first("error"), F.max(F.when(full, row)).alias("last_line"),
        any_(P.CHAINED_TRACEBACK).alias("chained"), any_("(?i)events:").alias("mentions_events"), any_("(?i)npm ERR!").alias("mentions_npm"),
        any_(P.K8S_HEADER).alias("event_header"), any_(P.NPM_CODE).alias("npm_header"))


def _after_headers(lines: DataFrame, facts: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """``_kubernetes`` and ``_npm`` lines of the logs with such headers: the first wanted line among the next ones that aren't blank."""
    some = facts.filter(F.col("event_header") & F.col("mentions_events") | F.col("npm_header") & F.col("mentions_npm")).select(key)
    rows = lines.join(some, key, "left_semi").select(key, F.col(order).alias("_at"), _clean(F.col(line)).alias("_line")).filter(strip(F.col("_line")) != "")
    text = F.col("_line")
    placed = running_totals(rows, [key], ["_at"], rank="_i")
    span = F.when(found(text, P.K8S_HEADER), EVENT_LINES).when(found(text, P.NPM_CODE), NPM_LINES)
    headers = placed.select(key, F.col("_i").alias("_head"), F.col("_line").alias("_own"), (span == EVENT_LINES).alias("_events"), span.alias("_span")).filter("_span IS NOT NULL")
    # A header looks at a fixed number of lines: an equi join on their places.
    looked = headers.select(key, "_head", "_own", "_events", F.explode(F.sequence(F.col("_head") + 1, F.col("_head") + F.col("_span"))).alias("_i"))
    wanted = placed.select(key, "_i", "_line", (found(text, P.K8S_WARNING)).alias("_warning"), (found(text, P.NPM_ROW) & ~found(text, P.NPM_NOISE)).alias("_row")).filter("_warning OR _row")
    hit = looked.join(wanted, [key, "_i"]).filter("(_events AND _warning) OR (NOT _events AND _row)")
    found_ = hit.groupBy(key, "_head").agg(F.min(F.struct("_i", "_line")).alias("_next"))
    per = headers.join(found_, [key, "_head"], "left").groupBy(key).agg(
        F.min(F.when(F.col("_events") & F.col("_next").isNotNull(), F.struct("_head", F.col("_next._line").alias("line")))).alias("_k"),
        F.min(F.when(~F.col("_events"), F.struct("_head", F.coalesce("_next._line", "_own").alias("line")))).alias("_n"))
    return per.select(key, F.col("_k.line").alias("_kubernetes"), F.col("_n.line").alias("_npm"))


def messages(lines: DataFrame, key: str = "artifact_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """``key, lines, error_lines, message``: the most telling line of each log, as ``classify.message_of`` finds it in a whole text.

    A one-line JSON message that holds line feeds stays one line here. A null line is blank; a log of blank lines has the message ''.
    """
    facts = log_facts(lines.withColumn(line, F.coalesce(line, F.lit(""))), key, order, line)
    told = facts.join(_after_headers(lines, facts, key, order, line), key, "left")
    chained = F.when(F.col("chained") & (F.col("strong_lines") >= 2), F.col("last_strong._line"))
    choice = F.coalesce(
        chained, F.when(F.col("mentions_events"), F.col("_kubernetes")), F.when(F.col("mentions_npm"), F.col("_npm")), F.col("first_strong._line"), F.col("first_test._line"),
        F.col("first_error._line"), F.col("last_line._line"), F.lit(""))
    return told.select(key, "lines", "error_lines", strip(choice).alias("message"))
