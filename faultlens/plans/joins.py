"""Theta joins rewritten with an equi key."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.text import let


def glob_to_regex(pattern: str) -> str:
    """Case-sensitive shell glob as an anchored Java regex; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(char) if not char.isalnum() and char != "_" else char)
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_to_regex_column(pattern: Column) -> Column:
    """The same translation for a column of patterns (bracket classes keep their meaning)."""
    escaped = F.regexp_replace(pattern, r"([\\.+^$(){}|])", r"\\$1")
    stars = F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    negated = F.replace(stars, F.lit("[!"), F.lit("[^"))
    return F.concat(F.lit("(?s)\\A"), negated, F.lit("\\z"))


TAIL = 6  # last characters of a path that pick globs without a leading folder


def glob_key(pattern: Column) -> Column:
    """What a path has to have if the glob matches it (or, ending in ``/``, begins it): the folders before the first wildcard, else the
    last characters after the last one, else nothing."""
    literal = F.regexp_extract(pattern, r"(?s)^[^*?\[]*", 0)
    folder = F.regexp_extract(literal, r"(?s)^.*/", 0)
    tail = F.when(literal == pattern, pattern).otherwise(F.regexp_extract(pattern, r"(?s)[^*?\[\]]*\z", 0))
    return F.when(folder != "", F.concat(F.lit("d:"), folder)).when((tail != "") & ~pattern.endswith("/"), F.concat(F.lit("t:"), F.right(tail, F.lit(TAIL)))).otherwise("any")


def path_keys(path: Column) -> Column:
    """All keys of globs that may match the path: a trie of its folders from the root, its last characters, and ``any``."""
    parts = F.split(path, "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    tails = F.array(*[F.when(F.length(path) >= n, F.concat(F.lit("t:"), F.right(path, F.lit(n)))) for n in range(1, TAIL + 1)])
    return F.array_compact(F.concat(F.coalesce(folders, F.array().cast("array<string>")), tails, F.array(F.lit("any"))))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path that start at a ``/`` boundary, the whole path included."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )


def suffix_match(left: DataFrame, right: DataFrame, left_path: str, right_path: str, keys: list[str]) -> DataFrame:
    """Pairs whose paths are equal or where one ends with ``/`` + the other, inside equal ``keys``.

    Two equi joins replace the theta join: right path among the left's suffixes, and left path among the right's
    proper suffixes. Both sides should be distinct on (keys, path); duplicates multiply.
    """
    ls = left.withColumn("_s", F.explode(path_suffixes(F.col(left_path))))
    forward = ls.join(right.withColumn("_s", F.col(right_path)), [*keys, "_s"])
    rs = right.withColumn("_s", F.explode(path_suffixes(F.col(right_path)))).filter(F.col("_s") != F.col(right_path))
    backward = rs.join(left.withColumn("_s", F.col(left_path)), [*keys, "_s"])
    columns = list(dict.fromkeys([*keys, *left.columns, *right.columns]))
    return forward.select(*columns).unionByName(backward.select(*columns)).filter(
        (F.col(left_path) != "") & (F.col(right_path) != "")
    )


def interval_join(
    points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str, width: int,
    how: str = "inner",
) -> DataFrame:
    """``points.point BETWEEN ranges.start AND ranges.end`` inside equal keys.

    Every range is listed once per block of ``width`` it touches, so the join has the equi key (keys, block).
    """
    cell = lambda column: F.floor(column / F.lit(width))
    blocks = ranges.withColumn("_block", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    located = points.withColumn("_block", cell(F.col(point)))
    condition = located["_block"] == blocks["_block"]
    for key in keys:
        condition = condition & (located[key] == blocks[key])
    condition = condition & located[point].between(blocks[start], blocks[end])
    joined = located.join(blocks, condition, how)
    kept = [located[name] for name in points.columns]
    kept += [blocks[name] for name in ranges.columns if name not in points.columns]
    return joined.select(*kept)


GRAM = 3  # characters of a gram; a shorter needle is one gram
BROADCAST_GRAMS = 200_000  # grams of needles that go to every task, of about 40 bytes each


def _grams(text: Column, sizes: Column) -> Column:
    """``gram, at`` of every place (from 1) of the text and each of these sizes."""
    def listed(chars: Column) -> Column:
        places = lambda n: F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1))
        gram = lambda n, i: F.when(n == 1, chars[i - 1]).when(n == 2, F.concat(chars[i - 1], chars[i])).otherwise(F.concat(chars[i - 1], chars[i], chars[i + 1]))
        return F.flatten(F.transform(sizes, lambda n: F.coalesce(
            F.transform(places(n), lambda i: F.struct(gram(n, i).alias("gram"), i.alias("at"))), F.array().cast("array<struct<gram:string,at:int>>"))))

    # Characters once, instead of a scan from the start for each place.
    return let(F.split(text, ""), listed)


def mentions(texts: DataFrame, key: str, pieces: Column, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """(``key``, ``needle``) where the needle is a substring of some of the text's pieces; the empty one is in every piece, a null one in none.

    An index of grams by place: of each needle the gram that is rarest in the texts is looked up, and what lies around each of its places is
    compared with the whole needle. Texts don't travel with their grams, and only places of rare grams are shuffled.
    """
    wanted = needles.select(needle).filter(F.length(needle) > 0).distinct()
    size = F.least(F.length(needle), F.lit(GRAM))
    own = wanted.select(needle, F.inline(_grams(F.col(needle), F.array(size))))
    sizes = wanted.agg(F.coalesce(F.collect_set(size), F.array().cast("array<int>"))).scalar()
    rows = texts.select(key, F.posexplode(F.coalesce(pieces, F.array().cast("array<string>"))).alias("_n", "_piece"))
    places = rows.withColumn("_sizes", sizes).select(key, "_n", F.inline(_grams(F.col("_piece"), F.col("_sizes"))))
    grams = own.select("gram").distinct()
    few = grams.count() <= BROADCAST_GRAMS
    beside = F.broadcast if few else lambda df: df
    counts = places.select("gram").join(beside(grams), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("_places"))
    # A needle with a gram that is nowhere is nowhere itself.
    rarest = own.join(counts, "gram", "left").groupBy(needle).agg(
        F.min(F.struct(F.coalesce("_places", F.lit(0)).alias("_places"), F.col("at").alias("_offset"), "gram")).alias("_r")).filter("_r._places > 0").select(needle, "_r.gram", "_r._offset")
    hits = places.join(beside(rarest), "gram").select(key, "_n", (F.col("at") - F.col("_offset") + 1).alias("_from"), needle).filter("_from > 0")
    whole = hits.join(rows, [key, "_n"]).filter(F.substr("_piece", F.col("_from"), F.length(needle)) == F.col(needle))
    empty = F.coalesce(needles.agg(F.max(F.col(needle) == "")).scalar(), F.lit(False))
    every = rows.filter(F.col("_piece").isNotNull() & empty).select(key, F.lit("").alias(needle)).distinct()
    return whole.select(key, needle).distinct().unionByName(every)
