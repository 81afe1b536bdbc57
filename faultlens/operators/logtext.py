"""Log windows, line policies and structured redaction."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from faultlens.functions import patterns as P
from faultlens.functions.redaction import (
    KEY_BEGIN, KEY_END, MAX_DEPTH, REDACTIONS, hit_total, marker, redact, redact_counted, sensitive_key,
)
from faultlens.functions.text import found, let

HEAD_LINES, CONTEXT_LINES, READ_LIMIT = 200, 20, 2 * 1024 * 1024
OVERSIZED = "[REDACTED:oversized_line]"


def bounded_window(text: Column, read_limit: int = READ_LIMIT, head_lines: int = HEAD_LINES) -> Column:
    """Head, failure context and tail of an oversized log; a small log is returned whole.

    The head is the first lines within its budget, the context every error line with 20 lines before and after it,
    the tail the last ``read_limit`` characters. Lines before an error line repeat when error lines are close.
    """
    head_budget = min(max(read_limit // 4, 1), 256 * 1024)

    def window(lines: Column) -> Column:
        head = F.left(F.array_join(F.slice(lines, 1, head_lines), ""), F.lit(head_budget)) if head_lines else F.lit("")
        tail = F.right(text, F.lit(read_limit))
        marks = F.array_compact(F.transform(lines, lambda x, i: F.when(found(x, P.ERROR_LINE), i)))

        def context(marks: Column) -> Column:
            # Per mark: up to 20 preceding lines and the line, then the lines up to the next mark, at most 20.
            piece = lambda m, k: F.concat(
                F.slice(lines, F.greatest(m - CONTEXT_LINES, F.lit(0)) + 1, F.least(m, F.lit(CONTEXT_LINES)) + 1),
                F.slice(lines, m + 2, F.greatest(F.least(F.lit(CONTEXT_LINES), F.coalesce(
                    F.try_element_at(marks, k + 2) - m - 1, F.lit(CONTEXT_LINES))), F.lit(0))))
            joined = F.left(F.array_join(F.flatten(F.transform(marks, piece)), ""), F.lit(read_limit))
            return F.when(F.size(marks) > 0, F.concat(F.lit("\n--- failure context ---\n"), joined)).otherwise("")

        return F.concat(head, let(marks, context), F.lit("\n--- log tail ---\n"), tail)

    # Lines keep their terminator, as a stream reader returns them.
    pieces = F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")
    return F.when(F.octet_length(text) <= read_limit + 4096, text).otherwise(let(pieces, window))


def oversized_policy(line: Column, limit: int = 64 * 1024) -> Column:
    """The marker instead of a line of more than ``limit`` characters.

    A character has one to four bytes, and the number of bytes is known: characters are counted only where it leaves the matter open.
    """
    size = F.octet_length(line)
    return F.when((size > 4 * limit) | ((size > limit) & (F.length(line) > limit)), OVERSIZED).otherwise(line)


def redact_artifacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Redact ``text`` and add ``redaction_hits`` in total and ``hits_by_kind`` as an array in pattern order."""
    counted = df.withColumn("_r", redact_counted(text))
    return counted.withColumn(text, F.col("_r.text")).withColumn("redaction_hits", hit_total(F.col("_r"))).withColumn(
        "hits_by_kind", F.col("_r.hits")).drop("_r")


def hit_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Total hits per redaction kind."""
    hits = df.select(redact_counted(text)["hits"].alias("h"))
    # One sum per kind in a single map-side combined row, then turned into rows.
    sums = hits.agg(*[F.sum(F.col("h")[i]).alias(kind) for i, (kind, _) in enumerate(REDACTIONS)])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(kind, F.lit(0)).alias("hits")) for kind, _ in REDACTIONS])
    return sums.select(F.inline(rows)).filter(F.col("hits") > 0)


def redact_value(value: Column, data_type: T.DataType, name: str | None = None, depth: int = 0) -> Column:
    """Key-aware redaction of a typed value: sensitive fields are replaced whole, strings by pattern."""
    if depth >= MAX_DEPTH:
        return F.lit(marker("depth_limit")) if isinstance(data_type, T.StringType) else F.lit(None).cast(data_type)
    if name is not None and _sensitive_name(name):
        if isinstance(data_type, T.StringType):
            return F.when(value.isNull() | (value == ""), value).otherwise(marker("sensitive_field"))
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.StringType):
        return redact(value)
    if isinstance(data_type, T.StructType):
        fields = [redact_value(value[f.name], f.dataType, f.name, depth + 1).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, data_type.elementType, None, depth + 1))
    if isinstance(data_type, T.MapType) and isinstance(data_type.keyType, T.StringType):
        text_values = isinstance(data_type.valueType, T.StringType)

        def entry(k: Column, v: Column) -> Column:
            clean = redact_value(v, data_type.valueType, None, depth + 1)
            hidden = F.lit(marker("sensitive_field")) if text_values else F.lit(None).cast(data_type.valueType)
            return F.when(sensitive_key(k) & v.isNotNull() & ((v != "") if text_values else F.lit(True)), hidden).otherwise(clean)

        return F.transform_values(value, entry)
    return value


def _sensitive_name(name: str) -> bool:
    import re

    from faultlens.functions.redaction import SENSITIVE_KEY

    return re.search(SENSITIVE_KEY, re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)) is not None


def redact_columns(df: DataFrame) -> DataFrame:
    """Every column of a table redacted by its name and type."""
    return df.select(*[redact_value(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def redact_key_blocks(lines: Column) -> Column:
    """Lines with every private-key block replaced: one marker for its first line, nothing for the rest.

    The block state runs along the array of one artifact's lines.
    """
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        opens, closes = line.rlike(KEY_BEGIN), line.rlike(KEY_END)
        shown = F.when(state["inside"], F.lit(None).cast("string")).when(opens, marker("private_key")).otherwise(redact(line))
        return F.struct(
            F.when(state["inside"], ~closes).otherwise(opens & ~closes).alias("inside"),
            F.when(shown.isNull(), state["out"]).otherwise(F.array_append(state["out"], shown)).alias("out"))

    return F.aggregate(lines, start, step, lambda state: state["out"])


def key_block_lines(df: DataFrame, keys: list[str], order: str, line: str = "line", open_before: DataFrame | None = None) -> DataFrame:
    """Line-table form: lines inside a key block are dropped, its first line becomes the marker.

    A line is inside when the last marker line before it only opened a block. The last marker is a running maximum over
    ordered pieces, so one artifact's lines may fill many tasks. ``open_before`` lists keys whose block was already
    open before the first line.
    """
    from faultlens.plans.ordered import running_totals

    opens, closes = F.col(line).rlike(KEY_BEGIN), F.col(line).rlike(KEY_END)
    marks = {"_opened": F.when(opens & ~closes, F.col(order)), "_closed": F.when(closes, F.col(order))}
    running = running_totals(df, keys, [order], maxes_before=marks)
    if open_before is not None:
        running = running.join(open_before.select(*keys).distinct().withColumn("_start", F.lit(True)), keys, "left")
    else:
        running = running.withColumn("_start", F.lit(False))
    inside = (
        F.when(F.col("_opened").isNull() & F.col("_closed").isNull(), F.coalesce("_start", F.lit(False)))
        .when(F.col("_closed").isNull(), True).otherwise(F.coalesce(F.col("_opened") > F.col("_closed"), F.lit(False))))
    shown = F.when(opens, marker("private_key")).otherwise(redact(F.col(line)))
    return running.filter(~inside).withColumn(line, shown).drop("_opened", "_closed", "_start")


def open_key_blocks(df: DataFrame, keys: list[str], order: str, line: str = "line", open_before: DataFrame | None = None) -> DataFrame:
    """Keys whose last line leaves a private-key block open; ``open_before`` carries over keys without any marker."""
    opens, closes = F.col(line).rlike(KEY_BEGIN), F.col(line).rlike(KEY_END)
    last = df.filter(opens | closes).groupBy(*keys).agg(F.max_by(~closes, order).alias("_open"))
    if open_before is not None:
        last = last.join(open_before.select(*keys).distinct().withColumn("_start", F.lit(True)), keys, "full")
        return last.filter(F.coalesce("_open", "_start")).select(*keys)
    return last.filter("_open").select(*keys)


def residual_report(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Artifacts that still hold sensitive shapes; the privacy gate needs this to be empty."""
    rows = df.select(key, hit_total(redact_counted(text)).alias("residual_hits"))
    return rows.filter(F.col("residual_hits") > 0)


def leaked_secrets(df: DataFrame, secrets: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Expected secrets (key, secret) that remain in the redacted text of their artifact."""
    clean = df.select(key, redact(F.col(text)).alias("_clean"))
    return secrets.join(clean, key).filter(F.contains("_clean", "secret")).select(key, "secret")
