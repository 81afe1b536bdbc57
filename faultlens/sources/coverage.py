"""Coverage reports of several tools as one long line table, and changed lines of unified diffs.

Each reader gives rows (key, format, block, path, line, hits, b_total, b_covered): one row per reported line, a null line
for file-level branch counters. ``block`` separates several reports of one file inside a document.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.functions.text import normalize_path, split_lines, strip
from faultlens.sources.json_tree import json_nodes
from faultlens.sources.reports import element_blocks, safe_xml

_LINE = "array<struct<_number:int,_hits:int,_branch:string,`_condition-coverage`:string>>"
_CLASS = f"_filename string, _name string, methods struct<method:array<struct<lines:struct<line:{_LINE}>>>>, lines struct<line:{_LINE}>"
_PACKAGE = "_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:int,_ci:int,_cb:int,_mb:int>>>>"


def _rows(df: DataFrame, key: str, fmt: str) -> DataFrame:
    zero = F.lit(0)
    columns = {
        "block": F.col("block") if "block" in df.columns else F.lit(0), "path": normalize_path("path"), "line": F.col("line"), "hits": F.col("hits"),
        "b_total": F.coalesce("b_total", zero), "b_covered": F.coalesce("b_covered", zero),
    }
    present = [F.col(key), F.lit(fmt).alias("format")]
    return df.select(*present, *[value.cast("string" if name == "path" else "int").alias(name) for name, value in columns.items()])


def _last_hit(rows: DataFrame, key: str) -> DataFrame:
    """Repeated lines of one file block: the last report wins, branches add up."""
    return rows.groupBy(key, "block", "path", "line").agg(
        F.max_by("hits", "p").alias("hits"), F.sum("b_total").alias("b_total"), F.sum("b_covered").alias("b_covered"))


def cobertura(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    blocks = safe_xml(df, text).select(key, F.posexplode(element_blocks(F.col(text), "class")).alias("block", "_xml"))
    parsed = blocks.select(key, "block", F.from_xml("_xml", _CLASS).alias("c"))
    empty = F.array().cast(_LINE)
    method_lines = F.flatten(F.transform(
        F.coalesce("c.methods.method", F.array().cast(f"array<struct<lines:struct<line:{_LINE}>>>")),
        lambda m: F.coalesce(m["lines"]["line"], empty)))
    lines = parsed.select(
        key, "block", F.coalesce(F.nullif("c._filename", F.lit("")), F.nullif("c._name", F.lit("")), F.lit("unknown")).alias("path"),
        F.posexplode(F.concat(method_lines, F.coalesce("c.lines.line", empty))).alias("p", "l"))
    branch = lambda i: F.when(F.col("l._branch") == "true", F.regexp_extract(
        F.coalesce(F.col("l.`_condition-coverage`"), F.lit("")), r"\((\d+)/(\d+)\)", i).try_cast("int"))
    rows = lines.select(
        key, "block", "path", "p", F.coalesce("l._number", F.lit(0)).alias("line"), F.coalesce("l._hits", F.lit(0)).alias("hits"),
        branch(2).alias("b_total"), branch(1).alias("b_covered"))
    return _rows(_last_hit(rows, key), key, "cobertura")


def jacoco(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    packages = safe_xml(df, text).select(key, F.posexplode(element_blocks(F.col(text), "package")).alias("block", "_xml"))
    files = packages.select(key, "block", F.from_xml("_xml", _PACKAGE).alias("p")).select(
        key, "block", F.col("p._name").alias("package"), F.explode("p.sourcefile").alias("f"))
    lines = files.select(
        key, "block", F.regexp_replace(F.concat_ws("/", F.coalesce("package", F.lit("")), F.col("f._name")), "^/+", "").alias("path"),
        F.posexplode("f.line").alias("p", "l"))
    total = F.coalesce("l._cb", F.lit(0)) + F.coalesce("l._mb", F.lit(0))
    rows = lines.select(
        key, "block", "path", "p", F.coalesce("l._nr", F.lit(0)).alias("line"),
        (F.coalesce("l._ci", F.lit(0)) > 0).cast("int").alias("hits"), total.alias("b_total"),
        F.when(total > 0, F.coalesce("l._cb", F.lit(0))).alias("b_covered"))
    return _rows(_last_hit(rows, key), key, "jacoco")


def lcov(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """``SF`` opens a file, ``end_of_record`` closes it; an unterminated last record counts."""
    blocks = df.select(key, F.posexplode(F.split(F.col(text), r"(?m)^[ \t]*(?=SF:)", -1)).alias("block", "_b")).filter(
        F.col("_b").startswith("SF:"))
    trimmed = F.transform(split_lines("_b"), strip)
    closed = blocks.select(key, "block", trimmed.alias("_l")).withColumn("_end", F.array_position("_l", "end_of_record"))
    body = F.when(F.col("_end") > 0, F.slice("_l", 1, F.col("_end").cast("int"))).otherwise(F.col("_l"))
    rows = closed.select(
        key, "block", strip(F.substr(F.element_at("_l", 1), F.lit(4))).alias("path"), F.posexplode(body).alias("p", "x"))
    parts = F.split(F.regexp_replace("x", "^(?:DA|BRDA):", ""), ",")
    numbers = lambda i: strip(F.try_element_at(parts, F.lit(i))).try_cast("int")
    data = rows.filter(F.col("x").startswith("DA:")).select(
        key, "block", "path", "p", numbers(1).alias("line"), numbers(2).alias("hits"), F.lit(0).alias("b_total"), F.lit(0).alias("b_covered")
    ).filter(F.col("line").isNotNull() & F.col("hits").isNotNull())
    taken = strip(F.try_element_at(parts, F.lit(4)))
    branches = rows.filter(F.col("x").startswith("BRDA:") & (F.size(parts) >= 4)).select(
        key, "block", "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("hits"), F.lit(1).alias("b_total"),
        (~taken.isin("-", "0")).cast("int").alias("b_covered"))
    files = rows.filter(F.col("p") == 0).select(
        key, "block", "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("hits"), F.lit(0).alias("b_total"), F.lit(0).alias("b_covered"))
    return _rows(_last_hit(data, key).unionByName(branches).unionByName(files), key, "lcov")


def istanbul(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    schema = "map<string,struct<statementMap:map<string,struct<start:struct<line:int>>>,s:map<string,int>,b:map<string,array<int>>>>"
    files = df.select(key, F.explode(F.from_json(text, schema)).alias("path", "f")).filter(
        F.col("f.statementMap").isNotNull() & F.col("f.s").isNotNull())
    statements = files.select(key, "path", "f.statementMap", F.explode("f.s").alias("sid", "hits"))
    lines = statements.select(
        key, "path", F.try_element_at("statementMap", F.col("sid"))["start"]["line"].alias("line"), "hits",
        F.lit(0).alias("b_total"), F.lit(0).alias("b_covered")
    ).filter(F.col("line").isNotNull() & F.col("hits").isNotNull())
    best = lines.groupBy(key, "path", "line").agg(
        F.max("hits").alias("hits"), F.lit(0).alias("b_total"), F.lit(0).alias("b_covered"))
    counts = F.filter(F.flatten(F.map_values(F.coalesce("f.b", F.create_map().cast("map<string,array<int>>")))), lambda n: n.isNotNull())
    branches = files.select(
        key, "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("hits"),
        F.size(counts).alias("b_total"), F.size(F.filter(counts, lambda n: n > 0)).alias("b_covered"))
    return _rows(best.unionByName(branches), key, "istanbul")


def istanbul_summary(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """File totals without line numbers: (key, path, lines_total, lines_covered, b_total, b_covered)."""
    pair = "struct<total:int,covered:int>"
    rows = df.select(key, F.explode(F.from_json(text, f"map<string,struct<lines:{pair},branches:{pair}>>")).alias("path", "m"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return rows.filter((F.col("path") != "total") & F.col("m.lines").isNotNull()).select(
        key, normalize_path("path").alias("path"), zero("m.lines.total").alias("lines_total"), zero("m.lines.covered").alias("lines_covered"),
        zero("m.branches.total").alias("b_total"), zero("m.branches.covered").alias("b_covered"))


def _attribute(block: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(block, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")) for name in names])


def dotnet_xml(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """Sequence and branch points with a file map; module lines when there are no points."""
    docs = safe_xml(df, text)
    file_schema = "_uid string, _id string, _fullPath string, _path string"
    files = docs.select(key, F.explode(element_blocks(F.col(text), "File")).alias("_xml")).select(
        key, F.from_xml("_xml", file_schema).alias("f")).select(
        key, F.coalesce("f._uid", "f._id").alias("fid"), F.coalesce("f._fullPath", "f._path").alias("path")
    ).filter(F.col("fid").isNotNull() & F.col("path").isNotNull()).groupBy(key, "fid").agg(F.max("path").alias("path"))

    def points(tag: str) -> DataFrame:
        raw = docs.select(key, F.explode(element_blocks(F.col(text), tag)).alias("_xml"))
        return raw.select(
            key, _attribute(F.col("_xml"), "fileid", "fileId", "file_id").alias("fid"),
            F.coalesce(_attribute(F.col("_xml"), "sl", "line").try_cast("int"), F.lit(0)).alias("line"),
            F.coalesce(_attribute(F.col("_xml"), "vc", "hits").try_cast("int"), F.lit(0)).alias("hits"),
        ).join(files, [key, "fid"], "left").withColumn("path", F.coalesce("path", F.lit("unknown")))

    sequence = points("SequencePoint").groupBy(key, "path", "line").agg(F.max("hits").alias("hits")).select(
        "*", F.lit(0).alias("b_total"), F.lit(0).alias("b_covered"))
    branches = points("BranchPoint").select(
        key, "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("hits"), F.lit(1).alias("b_total"),
        (F.col("hits") > 0).cast("int").alias("b_covered"))
    plain = docs.filter(~F.col(text).rlike(r"<(?:[\w.-]+:)?(?:SequencePoint|BranchPoint)[\s/>]"))
    modules = plain.select(key, F.explode(element_blocks(F.col(text), "Module")).alias("_m")).select(
        key, F.coalesce(_attribute(F.col("_m"), "name"), F.lit("unknown")).alias("path"),
        F.explode(element_blocks(F.col("_m"), "Line")).alias("_xml"))
    module_lines = modules.select(
        key, "path", F.coalesce(_attribute(F.col("_xml"), "number", "ln").try_cast("int"), F.lit(0)).alias("line"),
        F.coalesce(_attribute(F.col("_xml"), "hits", "count").try_cast("int"), F.lit(0)).alias("hits"),
    ).groupBy(key, "path", "line").agg(F.max("hits").alias("hits")).select("*", F.lit(0).alias("b_total"), F.lit(0).alias("b_covered"))
    return _rows(sequence.unionByName(branches).unionByName(module_lines), key, "dotnet")


def dotnet_json(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """Any ``Lines`` object below a source-file key, at any depth."""
    source = r"(?i)\.(?:cs|fs|vb)$"
    nodes = json_nodes(df, key, text).withColumn("_lines", F.from_json(F.get_json_object("node", "$.Lines"), "map<string,string>"))
    owner = F.try_element_at(F.filter("chain", lambda c: c.rlike(source)), F.lit(-1))
    rows = nodes.filter(F.col("_lines").isNotNull()).select(
        key, F.coalesce(owner, F.lit("unknown")).alias("path"), F.explode("_lines").alias("n", "h"))
    best = rows.select(key, "path", F.col("n").try_cast("int").alias("line"), F.col("h").try_cast("int").alias("hits")).filter(
        F.col("line").isNotNull() & F.col("hits").isNotNull()).groupBy(key, "path", "line").agg(F.max("hits").alias("hits"))
    return _rows(best.select("*", F.lit(0).alias("b_total"), F.lit(0).alias("b_covered")), key, "dotnet")


def coverage_format(text: Column) -> Column:
    """Format by root markers; null when unsupported or when the XML declares a document type."""
    low = F.lower(text)
    has = low.contains
    xml = strip(text).startswith("<")
    return (
        F.when(xml & has("<!doctype"), None)
        .when(xml & has("<coverage") & ~has("<coveragesession"), "cobertura")
        .when(xml & has("<report") & has("<package"), "jacoco")
        .when(xml & (has("<coveragesession") | has("<results") | has("<root")), "dotnet_xml")
        .when(xml, None)
        .when(strip(text).startswith("{") & text.rlike(r'"Lines"\s*:\s*\{'), "dotnet_json")
        .when(strip(text).startswith("{") & text.contains('"statementMap"'), "istanbul")
        .when(strip(text).startswith("{") & text.rlike(r'"lines"\s*:\s*\{'), "istanbul_summary")
        .when(text.contains("SF:") & text.contains("end_of_record"), "lcov")
    )


READERS = {
    "cobertura": cobertura, "jacoco": jacoco, "lcov": lcov, "istanbul": istanbul, "dotnet_xml": dotnet_xml,
    "dotnet_json": dotnet_json,
}


def read_coverage(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """All line-mapped formats of a mixed document table."""
    tagged = df.withColumn("_format", coverage_format(F.col(text)))
    out = None
    for name, reader in READERS.items():
        part = reader(tagged.filter(F.col("_format") == name), key, text)
        out = part if out is None else out.unionByName(part)
    return out


def changed_lines(df: DataFrame, key: str = "gate_id", text: str = "text") -> DataFrame:
    """Distinct added lines (key, path, line) of unified diffs.

    A diff is cut into file sections and hunks; inside a hunk the n-th added or context row has the line
    ``start + n``. Everything stays in the row of its diff.
    """
    sections = df.select(key, F.explode(F.split(F.col(text), r"(?m)^(?=diff --git )", -1)).alias("_s"))
    parts = sections.select(key, F.split("_s", r"(?m)^(?=@@ )", -1).alias("_p"))
    header = F.try_element_at(
        F.filter(split_lines(F.element_at("_p", 1)), lambda x: x.startswith("+++ ")), F.lit(-1))
    files = parts.select(key, header.alias("_header"), F.explode("_p").alias("_h")).filter(
        F.col("_header").isNotNull() & (F.col("_header") != "+++ /dev/null")
    ).withColumn("path", strip(F.regexp_replace("_header", r"^\+\+\+ (?:b/)?", "")))
    hunks = files.filter(F.col("_h").startswith("@@ ")).select(
        key, "path", F.regexp_extract("_h", r"^@@ [^\n]*?\+(\d+)", 1).try_cast("int").alias("start"), split_lines("_h").alias("_l"))
    body = F.filter(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))),
                    lambda x: ~x.startswith("---") & ~x.startswith("-"))
    rows = hunks.select(key, "path", "start", F.posexplode(body).alias("i", "x"))
    return rows.filter(F.col("x").startswith("+") & F.col("start").isNotNull()).select(
        key, "path", (F.col("start") + F.col("i")).alias("line")).distinct()
