"""Text helpers as column expressions."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from faultlens.functions import patterns as P

# Whitespace that a Unicode-aware strip removes, and line separators.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
)
LINE_SEPARATOR = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
MESSAGE_KEYS = ("message", "msg", "log", "error", "output")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(as_col(value), F.lit(SPACES))


def collapse(value: Column | str) -> Column:
    """Runs of whitespace to one space, ends trimmed."""
    return F.btrim(F.regexp_replace(as_col(value), WHITESPACE_RUN, " "))


def clip(value: Column | str, length: int) -> Column:
    return F.left(as_col(value), F.lit(length))


def bounded(value: Column | str, length: int) -> Column:
    """Collapsed, redacted and truncated: the form every persisted field takes."""
    from faultlens.functions.redaction import redact

    return clip(redact(collapse(value)), length)


def split_lines(text: Column | str) -> Column:
    """Ordered lines without terminators; empty text has no lines."""
    text = as_col(text)
    # Behind the last terminator stands an empty piece, which is no line.
    pieces = let(F.split(text, LINE_SEPARATOR, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(pieces)


def newline_normalized(text: Column | str) -> Column:
    text = as_col(text)
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def possible(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a text holds a word that every match of the pattern holds; ``low`` is the lower-cased text, where it is at hand."""
    holds = lambda low: reduce(or_, [low.contains(word) for word in P.SCREENS[pattern]])
    return let(F.lower(text), holds) if low is None else holds(low)


def found(text: Column, pattern: str, low: Column | None = None) -> Column:
    match = text.rlike(pattern)
    return possible(text, pattern, low) & match if pattern in P.SCREENS else match


def place(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Position of the first match from 1, else 0."""
    position = F.regexp_instr(text, F.lit(pattern))
    return F.when(possible(text, pattern, low), position).otherwise(F.when(text.isNotNull(), 0)) if pattern in P.SCREENS else position


def group(text: Column, pattern: str, index: int = 1, low: Column | None = None) -> Column:
    """Captured group of the first match, empty string when absent; ``low`` is the lower-cased text, where a screen shall go first."""
    value = F.regexp_extract(text, pattern, index)
    return value if low is None else F.when(possible(text, pattern, low), value).otherwise(F.when(text.isNotNull(), ""))


def first(items: Column) -> Column:
    """First element or null."""
    return F.try_element_at(items, F.lit(1))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _json_message(line: Column) -> Column:
    """The first string among the well-known message fields of a one-line JSON object."""

    def pick(doc: Column) -> Column:
        options = []
        for key in MESSAGE_KEYS:
            child = F.try_variant_get(doc, f"$.{key}", "variant")
            options.append(
                F.when(F.schema_of_variant(child) == "STRING", F.try_variant_get(doc, f"$.{key}", "string"))
            )
        return F.coalesce(*options)

    return let(F.try_parse_json(line), pick)


def unwrap_line(line: Column) -> Column:
    """Drop one leading runner prefix and unwrap a one-line JSON message."""

    def inner(item: Column) -> Column:
        core = strip(item)
        is_object = core.startswith("{") & core.endswith("}")
        return F.when(is_object, F.coalesce(_json_message(core), item)).otherwise(item)

    return let(F.regexp_replace(line, P.CI_PREFIX, ""), inner)


def normalize_lines(text: Column | str) -> Column:
    """Lines of a log with colour codes, runner prefixes and JSON wrappers removed."""
    plain = lambda x: F.when(x.contains("\x1b"), F.regexp_replace(x, P.ANSI, "")).otherwise(x)
    return F.transform(let(let(newline_normalized(text), plain), split_lines), unwrap_line)


def whole(values: Column | str) -> Column:
    """All of an array, as an expression: generating from a bare attribute would make Spark add a filter on its size, which
    computes the array a second time."""
    return F.slice(as_col(values), 1, 1 << 30)


def normalize_log(text: Column | str) -> Column:
    return F.array_join(normalize_lines(text), "\n")


def leaf_identity(test: Column | str) -> Column:
    """Runner-agnostic last segment of a test name."""
    leaf = strip(F.coalesce(as_col(test), F.lit("")))
    for separator in ("::", "#", ".", "/", "\\"):
        leaf = strip(F.substring_index(leaf, separator, -1))
    return F.when(leaf == "", "unknown").otherwise(leaf)


def normalize_path(path: Column | str) -> Column:
    return F.regexp_replace(F.replace(as_col(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def ratio(numerator: Column, denominator: Column, digits: int, empty: float | None = 0.0) -> Column:
    """Rounded quotient, half-even, with a value for an empty denominator."""
    value = F.bround(numerator.cast("double") / denominator.cast("double"), digits)
    return F.when(denominator > 0, value).otherwise(F.lit(empty).cast("double"))


def iso_to_ns(value: Column) -> Column:
    """Epoch nanoseconds of an ISO time that names its zone; null otherwise."""
    zoned = value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    clean = F.replace(value, F.lit(","), F.lit("."))
    micros = F.unix_micros(F.try_to_timestamp(clean))
    return F.when(zoned, micros * F.lit(1000))


def duration_ms(value: Column) -> Column:
    """Seconds to whole milliseconds, never negative; null when absent or unreadable."""
    millis = strip(value).try_cast("double") * 1000
    whole = F.floor(millis).try_cast("int")
    return F.when(whole < 0, F.lit(0)).otherwise(whole)
