"""Stack frames, failed tests, correlation ids and deployment hints from log text.

Row-local operators work on the array of lines; each runner's records are found linearly and folded in runner order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import (
    as_col, clip, first, found, group, let, possible, split_lines, strip, whole,
)

# ------------------------------------------------------------------ stack frames

def _qualified(name: Column) -> Column:
    parts = F.filter(F.split(name, r"\."), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def _frame(line: Column) -> Column:
    """First matching frame shape of a line as (file, line, function), else null."""
    def frame(file: Column, number: Column, function: Column) -> Column:
        return F.struct(file.alias("file"), number.try_cast("bigint").alias("line"), function.alias("function"))

    none = F.lit(None).cast("string")
    optional = lambda pattern, index: F.nullif(group(line, pattern, index), F.lit(""))
    simple = lambda pattern: frame(group(line, pattern, 1), group(line, pattern, 2), none)
    return (
        F.when(found(line, P.PY_FRAME), frame(group(line, P.PY_FRAME, 1), group(line, P.PY_FRAME, 2), optional(P.PY_FRAME, 3)))
        .when(found(line, P.PY_FRAME_IN), frame(group(line, P.PY_FRAME_IN, 1), group(line, P.PY_FRAME_IN, 2), group(line, P.PY_FRAME_IN, 3)))
        .when(found(line, P.PY_FRAME_SHORT), frame(group(line, P.PY_FRAME_SHORT, 1), group(line, P.PY_FRAME_SHORT, 2), optional(P.PY_FRAME_SHORT, 3)))
        .when(found(line, P.COMPILE_FRAME), simple(P.COMPILE_FRAME))
        .when(found(line, P.CONFIG_FRAME), simple(P.CONFIG_FRAME))
        .when(found(line, P.TERRAFORM_FRAME), simple(P.TERRAFORM_FRAME))
        .when(found(line, P.JAVA_FRAME), frame(
            F.replace(group(line, P.JAVA_FRAME, 2), F.lit("\\"), F.lit("/")), group(line, P.JAVA_FRAME, 3),
            _qualified(group(line, P.JAVA_FRAME, 1))))
        .when(found(line, P.V8_FRAME), frame(
            group(line, P.V8_FRAME, 2), group(line, P.V8_FRAME, 3), F.nullif(strip(group(line, P.V8_FRAME, 1)), F.lit(""))))
        .when(found(line, P.CSHARP_FRAME), simple(P.CSHARP_FRAME))
    )


def stack_frames(text: Column | str, lines: Column | None = None) -> Column:
    """Distinct frames of a log in order; ``lines`` are those of the text, where they are at hand."""
    # A cheap screen: every frame shape has ``:number``, `` line number`` or ``:line number``.
    lines = F.filter(split_lines(text) if lines is None else lines, lambda x: x.rlike(r":\d|line\s+\d"))
    found_frames = F.filter(F.transform(lines, _frame), lambda f: f.isNotNull())
    return F.array_distinct(found_frames)


def frame_table(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(stack_frames(text)).alias("pos", "f")).select(key, "pos", "f.*")


def contain_paths(frames: DataFrame, root: str = "repo_root") -> DataFrame:
    """Repo-relative frame files; files outside the root drop out.

    ``.`` and ``..`` segments are resolved; an absolute path must lie under the root.
    """
    raw = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    base = F.regexp_replace(F.col(root), "/+$", "")
    full = F.when(raw.startswith("/"), raw).otherwise(F.concat(base, F.lit("/"), raw))
    step = lambda acc, part: (
        F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, part))
    )
    resolved = F.concat(F.lit("/"), F.array_join(
        F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/"))
    return (
        frames.withColumn("_full", resolved).withColumn("_base", F.concat(base, F.lit("/")))
        .filter(F.col("_full").startswith(F.col("_base")))
        .withColumn("file", F.expr("substr(_full, length(_base) + 1)"))
        .drop("_full", "_base")
    )


SNIPPET_PAD = 2
# Fixed value: source suffixes that may be quoted.
SNIPPET_SUFFIXES = (
    ".py", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".ts", ".js", ".go", ".rs", ".java", ".yaml", ".yml", ".tf",
    ".tpl",
)


def attach_snippets(frames: DataFrame, source_line: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Add ``code``: source lines within two of each frame, as ``n | text`` rows.

    The range condition becomes an equi join on (file, line) by listing the five wanted lines of a frame.
    """
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("file", ".", -1)))
    wanted = frames.filter((F.col("line") > 0) & suffix.isin(*SNIPPET_SUFFIXES))
    targets = wanted.select(
        key, "pos", "file",
        F.explode(F.sequence(F.col("line") - SNIPPET_PAD, F.col("line") + SNIPPET_PAD)).alias("line_no"),
    ).filter(F.col("line_no") > 0)
    source = source_line.select("file", F.col("line").alias("line_no"), F.col("text").alias("_src"))
    rows = targets.join(source, ["file", "line_no"]).groupBy(key, "pos").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "_src"))).alias("_rows")  # five lines per frame
    )
    code = F.array_join(
        F.transform("_rows", lambda r: F.concat(r["line_no"].cast("string"), F.lit(" | "), r["_src"])), "\n"
    )
    return frames.join(rows.select(key, "pos", code.alias("code")), [key, "pos"], "left")


# ------------------------------------------------------------------ failed tests

def _record(name: Column, assertion: Column | None = None, file: Column | None = None, line: Column | None = None) -> Column:
    empty = F.lit("")
    return F.struct(
        name.alias("name"),
        (empty if assertion is None else assertion).alias("assertion"),
        (empty if file is None else file).alias("file"),
        (F.lit(None).cast("bigint") if line is None else line.try_cast("bigint")).alias("line"),
    )


def _indexed(lines: Column, keep) -> Column:
    """(i, line) of the lines that satisfy ``keep``; i is 0-based."""
    return F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda r: keep(r["line"])
    )


def _present(records: Column) -> Column:
    return F.filter(records, lambda r: r.isNotNull())


def pytest_failures(lines: Column) -> Column:
    def read(line: Column) -> Column:
        header = group(line, P.HEADER_LINE)
        return (
            F.when(found(line, P.FAILED_LINE), _record(group(line, P.FAILED_LINE, 1), group(line, P.FAILED_LINE, 2)))
            .when((header != "") & ~F.lower(header).contains("short test summary"), _record(header))
        )

    return _present(F.transform(F.transform(lines, strip), read))


def jest_failures(lines: Column) -> Column:
    """Jest and Vitest: the last FAIL file row names the file of the marked tests after it."""
    numbered = _indexed(lines, lambda x: strip(x).rlike(P.JEST_FAIL_FILE) | x.rlike(P.JEST_TEST_NAME))

    def detail(row: Column) -> Column:
        ahead = F.slice(lines, row["i"] + 2, 8)
        stop = first(F.filter(
            F.transform(ahead, lambda x, i: F.when(x.rlike(P.JEST_RECEIVED), i)), lambda i: i.isNotNull()
        ))
        seen = F.when(stop.isNull(), ahead).otherwise(F.slice(ahead, 1, stop + 1))
        expected = F.coalesce(group(F.try_element_at(F.filter(seen, lambda x: x.rlike(P.JEST_EXPECTED)), F.lit(-1)), P.JEST_EXPECTED), F.lit(""))
        received = F.when(stop.isNotNull(), group(F.try_element_at(ahead, stop + 1), P.JEST_RECEIVED)).otherwise("")
        return F.when((expected != "") | (received != ""), F.concat(
            F.lit("Expected: "), strip(expected), F.lit(" / Received: "), strip(received))).otherwise("")

    def vitest_detail(row: Column) -> Column:
        return F.coalesce(first(F.filter(F.transform(F.slice(lines, row["i"] + 2, 4), strip), lambda x: x != "")), F.lit(""))

    def classify(row: Column) -> Column:
        core = strip(row["line"])
        is_vitest, is_file = core.rlike(P.VITEST_FAIL), core.rlike(P.JEST_FAIL_FILE)
        return F.struct(
            F.when(is_file & ~is_vitest, group(core, P.JEST_FAIL_FILE)).alias("opens"),
            F.when(is_vitest, _record(group(core, P.VITEST_FAIL, 2), vitest_detail(row), group(core, P.VITEST_FAIL, 1)))
            .when(~is_file, _record(group(F.rtrim(row["line"]), P.JEST_TEST_NAME), detail(row))).alias("test"),
            is_vitest.alias("own_file"),
        )

    start = F.struct(
        F.lit("").alias("file"),
        F.array().cast("array<struct<name:string,assertion:string,file:string,line:bigint>>").alias("out"),
    )

    def step(state: Column, row: Column) -> Column:
        named = F.struct(
            row["test"]["name"].alias("name"), row["test"]["assertion"].alias("assertion"),
            F.when(row["own_file"], row["test"]["file"]).otherwise(state["file"]).alias("file"),
            row["test"]["line"].alias("line"),
        )
        return F.struct(
            F.coalesce(row["opens"], state["file"]).alias("file"),
            F.when(row["test"].isNull(), state["out"]).otherwise(F.array_append(state["out"], named)).alias("out"),
        )

    return F.aggregate(F.transform(numbered, classify), start, step, lambda state: state["out"])


def go_failures(lines: Column) -> Column:
    """A location row belongs to the FAIL row right before it among FAIL and location rows."""
    rows = F.filter(lines, lambda x: (x.startswith("--- FAIL:") & x.rlike(P.GO_FAIL)) | (x.contains(".go:") & x.rlike(P.GO_LOCATION)))

    def bind(rows: Column) -> Column:
        def read(line: Column, i: Column) -> Column:
            previous = F.try_element_at(rows, F.when(i > 0, i))
            return F.when(
                ~line.rlike(P.GO_FAIL) & F.coalesce(previous.rlike(P.GO_FAIL), F.lit(False)),
                _record(group(previous, P.GO_FAIL), group(line, P.GO_LOCATION, 3), group(line, P.GO_LOCATION, 1),
                        group(line, P.GO_LOCATION, 2)),
            )

        return _present(F.transform(rows, read))

    return let(rows, bind)


def rspec_failures(lines: Column) -> Column:
    """Summary rows, then numbered blocks after a ``Failures:`` row."""
    cores = F.transform(lines, strip)
    summary = F.transform(
        F.filter(cores, lambda x: x.startswith("rspec") & x.rlike(P.RSPEC_SUMMARY)),
        lambda x: _record(group(x, P.RSPEC_SUMMARY, 3), None, group(x, P.RSPEC_SUMMARY, 1), group(x, P.RSPEC_SUMMARY, 2)),
    )

    def blocks(items: Column) -> Column:
        start = F.array_position(items, "Failures:").cast("int")
        body = F.array_join(F.slice(items, start, F.size(items)), "\n")
        return F.when(start > 0, F.filter(
            F.split(body, r"(?m)^(?=\d+\)\s+\S)|^(?=Failures:$)", -1), lambda b: b.rlike(r"^\d+\)\s+\S")
        )).otherwise(F.array().cast("array<string>"))

    def read(block: Column) -> Column:
        rows = F.split(block, "\n", -1)

        def inner(rows: Column) -> Column:
            stop = first(F.filter(
                F.transform(rows, lambda x, i: F.when((i > 0) & x.rlike(P.RSPEC_LOCATION) & ~x.rlike(P.RSPEC_FAILURE), i)),
                lambda i: i.isNotNull()))
            before = F.slice(rows, 1, F.coalesce(stop, F.size(rows)))
            reason = F.try_element_at(F.filter(before, lambda x: x.rlike(P.RSPEC_FAILURE)), F.lit(-1))
            place = F.try_element_at(rows, stop + 1)
            return _record(
                strip(group(F.element_at(rows, 1), P.RSPEC_BLOCK)),
                F.coalesce(group(reason, P.RSPEC_FAILURE), F.lit("")),
                F.coalesce(group(place, P.RSPEC_LOCATION, 1), F.lit("")),
                group(place, P.RSPEC_LOCATION, 2),
            )

        return let(rows, inner)

    return F.concat(summary, F.transform(let(cores, blocks), read))


def cargo_failures(text: Column) -> Column:
    def read(block: Column) -> Column:
        name = group(block, r"(?s)^---- (\S+) stdout ----(.*)\z", 1)
        rest = group(block, r"(?s)^---- (\S+) stdout ----(.*)\z", 2)
        return F.when(found(rest, P.CARGO_PANIC), _record(
            name, group(rest, P.CARGO_PANIC, 1), group(rest, P.CARGO_PANIC, 2), group(rest, P.CARGO_PANIC, 3),
        )).otherwise(_record(name))

    return F.when(
        text.contains(" stdout ----"), F.transform(F.regexp_extract_all(text, F.lit(P.CARGO_BLOCK), F.lit(0)), read)
    ).otherwise(F.array())


def dotnet_failures(lines: Column) -> Column:
    rows = _indexed(lines, lambda x: x.contains("Failed") & x.rlike(P.DOTNET_FAIL))

    def read(row: Column) -> Column:
        ahead = F.transform(F.slice(lines, row["i"] + 2, 11), strip)

        def inner(ahead: Column) -> Column:
            marks = F.transform(ahead, lambda x: x.startswith("Stack Trace"))
            mark = F.array_position(marks, True).cast("int")
            head = F.when(mark > 0, F.slice(ahead, 1, F.greatest(mark - 1, F.lit(0)))).otherwise(ahead)
            parts = F.slice(F.filter(head, lambda x: (x != "") & (x != "Error Message:")), 1, 3)
            tail = F.when(mark > 0, F.slice(ahead, mark + 1, 11)).otherwise(F.array().cast("array<string>"))
            place = first(F.filter(tail, lambda x: x.rlike(P.DOTNET_FRAME)))
            return _record(
                group(row["line"], P.DOTNET_FAIL), F.array_join(parts, " | "),
                F.coalesce(group(place, P.DOTNET_FRAME, 1), F.lit("")), group(place, P.DOTNET_FRAME, 2),
            )

        return let(ahead, inner)

    return F.transform(rows, read)


def _merge(records: Column) -> Column:
    """Sequential merge: a record with the same leaf and a compatible file enriches the stored one.

    Only tests whose last name segment agrees, case aside, can meet, so records are sorted by it and merged within each group;
    the results return to the order of their first records.
    """
    segment = lambda name: F.lower(F.substring_index(name, "::", -1))
    usable = F.filter(records, lambda r: r["name"] != "")
    keyed = F.array_sort(F.transform(usable, lambda r, i: F.struct(segment(r["name"]).alias("leaf"), i.alias("i"), r.alias("r"))))

    def grouped(rows: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda k: (k == 1) | (
            F.element_at(rows, k)["leaf"] != F.element_at(rows, F.greatest(k - 1, F.lit(1)))["leaf"]))
        return let(places, lambda p: F.transform(p, lambda k, g: F.slice(
            rows, k, F.coalesce(F.get(p, g + 1), F.size(rows) + 1) - k)))

    groups = let(keyed, lambda rows: F.when(F.size(rows) > 0, grouped(rows)))
    merged = F.flatten(F.transform(F.coalesce(groups, F.array()), _merge_group))
    return F.transform(F.array_sort(merged), lambda m: m["t"])


def _merge_group(rows: Column) -> Column:
    """Merged tests ``struct<i, t>`` of records whose last name segments agree; ``i`` is a test's first record."""
    start = F.array().cast("array<struct<i:int,t:struct<name:string,file:string,line:bigint,assertion:string>>>")
    has_path = lambda name: name.rlike(r"(?s)^(.*?)::(.*)$")

    def step(stored: Column, row: Column) -> Column:
        r = row["r"]
        own_file = r["file"] != ""
        derived = F.when(own_file | ~has_path(r["name"]), "").otherwise(group(r["name"], r"(?s)^(.*?)::", 1))
        leaf = F.when(has_path(r["name"]), group(r["name"], r"(?s)^.*?::(.*)$", 1)).otherwise(r["name"])
        file = F.when(derived != "", derived).otherwise(r["file"])

        def place(x: Column) -> Column:
            same = F.transform(stored, lambda s: (
                (row["leaf"] == x["leaf"]) & ((x["derived"] == "") | (s["t"]["file"] == "") | (s["t"]["file"] == x["derived"]))
            ))
            index = F.array_position(same, True).cast("int") - 1
            updated = F.transform(stored, lambda s, i: F.when(i == index, F.struct(s["i"].alias("i"), F.struct(
                F.when(r["name"].contains("::"), r["name"]).otherwise(s["t"]["name"]).alias("name"),
                F.when(s["t"]["file"] == "", x["file"]).otherwise(s["t"]["file"]).alias("file"),
                F.when(F.coalesce(s["t"]["line"], F.lit(0)) == 0, F.coalesce(r["line"], s["t"]["line"])).otherwise(s["t"]["line"]).alias("line"),
                F.when(s["t"]["assertion"] == "", x["assertion"]).otherwise(s["t"]["assertion"]).alias("assertion"),
            ).alias("t"))).otherwise(s))
            new = F.struct(row["i"].alias("i"), F.struct(
                r["name"].alias("name"), x["file"].alias("file"), r["line"].alias("line"), x["assertion"].alias("assertion")).alias("t"))
            return F.when(F.exists(same, lambda hit: hit), updated).otherwise(F.array_append(stored, new))

        return let(F.struct(
            leaf.alias("leaf"), derived.alias("derived"), file.alias("file"), strip(r["assertion"]).alias("assertion")
        ), place)

    return F.aggregate(rows, start, step)


RUNNERS = {
    "pytest": lambda text, lines: pytest_failures(lines),
    "jest": lambda text, lines: jest_failures(lines),
    "go": lambda text, lines: go_failures(lines),
    "rspec": lambda text, lines: rspec_failures(lines),
    "cargo": lambda text, lines: cargo_failures(text),
    "dotnet": lambda text, lines: dotnet_failures(lines),
}


def failed_tests(df: DataFrame, text: str = "text", lines: str | None = None) -> DataFrame:
    """Add ``failed_tests``: records of all runner formats merged in runner order. ``lines`` names a column of the text's lines, if there is one."""
    body = F.col(text)
    out = df.withColumn("_lines", split_lines(text) if lines is None else F.col(lines))
    for name, parse in RUNNERS.items():
        out = out.withColumn(f"_r_{name}", parse(body, F.col("_lines")))
    records = F.concat(*[F.col(f"_r_{name}") for name in RUNNERS])
    return out.withColumn("failed_tests", _merge(records)).drop("_lines", *[f"_r_{name}" for name in RUNNERS])


def failed_test_table(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    parsed = failed_tests(df, text)
    return parsed.select(key, F.posexplode(whole("failed_tests")).alias("pos", "t")).select(key, "pos", "t.*")


# ------------------------------------------------------------------ correlation ids

def _entity_lists(text: Column, lines: Column | None = None) -> dict[str, Column]:
    """Values of each correlation id in text order; ``request`` holds method and path, with line and place in it."""
    def requests(line: Column, i: Column) -> Column:
        method, path = group(line, P.METHOD_FIELD), group(line, P.PATH_FIELD)
        pair = F.when((method != "") & (path != ""), F.array(F.concat(F.upper(method), F.lit("\n"), path)))
        inline = F.transform(
            F.regexp_extract_all(line, F.lit(P.METHOD_PATH), F.lit(0)),
            lambda m: F.concat(F.upper(group(m, P.METHOD_PATH, 1)), F.lit("\n"), group(m, P.METHOD_PATH, 2)),
        )
        both = F.concat(F.coalesce(pair, F.array().cast("array<string>")), inline)
        return F.transform(both, lambda v, j: F.struct((i.cast("bigint") * 100000 + j).alias("pos"), v.alias("value")))

    lines = F.filter(F.transform(split_lines(text) if lines is None else lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                     lambda r: r["x"].contains("/"))
    none = F.when(text.isNotNull(), F.array().cast("array<struct<pos:bigint,value:string>>"))
    values = lambda pattern: F.when(possible(text, pattern), F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v, i: F.struct(i.cast("bigint").alias("pos"), v.alias("value")))).otherwise(none)
    lists = {field: values(pattern) for field, pattern in P.ENTITY_FIELDS.items()}
    # Lines are looked at one by one only in a text that names a method at all.
    some = found(text, P.METHOD_FIELD) | found(text, P.METHOD_PATH)
    return lists | {"request": F.when(some, F.flatten(F.transform(lines, lambda r: requests(r["x"], r["i"])))).otherwise(none)}


def entity_values(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Long form (key, field, pos, value) of correlation ids in text order; ``request`` holds method and path."""
    def named(field: str, rows: Column) -> Column:
        return F.transform(rows, lambda r: F.struct(F.lit(field).alias("field"), r["pos"].alias("pos"), r["value"].alias("value")))

    rows = [named(field, found_rows) for field, found_rows in _entity_lists(F.col(text)).items()]
    return df.select(key, F.inline(F.concat(*rows)))


def context_of(text: Column | str, lines: Column | None = None) -> Column:
    """The struct that ``entity_context`` gives a text that is the only one of its key, found inside its row."""
    lists = _entity_lists(as_col(text), lines)
    found_values = F.struct(*[F.coalesce(rows, F.array().cast("array<struct<pos:bigint,value:string>>")).alias(field) for field, rows in lists.items()])

    def most(rows: Column) -> Column:
        """The most frequent value (ties: first seen): runs of equal values are counted in one pass over the sorted values."""
        run = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("pos"))
        start = F.struct(run.alias("run"), run.alias("best"))

        def step(state: Column, r: Column) -> Column:
            same = F.coalesce(state["run"]["value"] == r["value"], F.lit(False))
            grown = F.struct(r["value"].alias("value"), F.when(same, state["run"]["n"] + 1).otherwise(1).alias("n"), F.when(same, state["run"]["pos"]).otherwise(r["pos"]).alias("pos"))
            ahead = lambda run: (run["n"] > state["best"]["n"]) | ((run["n"] == state["best"]["n"]) & (run["pos"] < state["best"]["pos"]))
            return let(grown, lambda run: F.struct(run.alias("run"), F.when(ahead(run), run).otherwise(state["best"]).alias("best")))

        ordered = F.array_sort(F.transform(rows, lambda r: F.struct(r["value"].alias("value"), r["pos"].alias("pos"))))
        return F.coalesce(F.aggregate(ordered, start, step, lambda state: state["best"]["value"]), F.lit(""))

    def told(r: Column) -> Column:
        return let(most(r["request"]), lambda request: F.struct(
            *[most(r[field]).alias(field) for field in P.ENTITY_FIELDS],
            F.array_distinct(F.transform(r["user_id"], lambda u: u["value"])).alias("users"),
            F.substring_index(request, "\n", 1).alias("method"), F.substring_index(request, "\n", -1).alias("path")))

    return let(found_values, told)


def entity_context(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Most frequent value per field (ties: first seen), all users as first seen, most frequent (method, path) pair."""
    counted = entity_values(df, key, text).groupBy(key, "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    best = counted.groupBy(key).agg(*[
        F.max_by(
            F.when(F.col("field") == field, F.col("value")),
            F.when(F.col("field") == field, F.struct("n", -F.col("pos"))),
        ).alias(field)
        for field in [*P.ENTITY_FIELDS, "request"]
    ])
    users = (
        counted.filter(F.col("field") == "user_id")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_u"))
        .select(key, F.transform("_u", lambda u: u["value"]).alias("users"))
    )
    blank = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return (
        df.select(key).join(best, key, "left").join(users, key, "left")
        .select(
            key, *[blank(field) for field in P.ENTITY_FIELDS],
            F.coalesce("users", F.array().cast("array<string>")).alias("users"),
            F.coalesce(F.substring_index("request", "\n", 1), F.lit("")).alias("method"),
            F.coalesce(F.substring_index("request", "\n", -1), F.lit("")).alias("path"),
        )
    )


# ------------------------------------------------------------------ deployment context

def deployment_hints(text: Column | str) -> Column:
    """Struct of deployment facts that a log mentions; empty strings where it says nothing."""
    return let(F.struct(as_col(text).alias("text"), F.lower(as_col(text)).alias("low")), lambda r: _hints(r["text"], r["low"]))


def _hints(text: Column, low: Column) -> Column:
    has = lambda *words: _any(low, words)
    platform = (
        F.when(has("argocd", "argo cd"), "argo-cd")
        .when(has("cloudformation"), "cloudformation")
        .when(has("ecs"), "ecs")
        .when(has("kubectl", "pod/", "deployment/", "crashloopbackoff"), "kubernetes")
        .when(has("helm"), "helm")
        .when(has("terraform"), "terraform")
        .otherwise("")
    )
    release = F.coalesce(F.nullif(group(text, P.RELEASE_NAME, low=low), F.lit("")), group(text, P.RELEASE_HELM, low=low))
    return F.struct(
        platform.alias("platform"), release.alias("release"),
        F.when(found(text, P.ROLLBACK_DONE_ANYWHERE, low), "rollback_succeeded").otherwise("").alias("recovery"),
        F.when(found(text, P.OUTCOME_FAILED, low), "failed").otherwise("").alias("outcome"),
        *[group(text, pattern, low=low).alias(name) for name, pattern in P.DEPLOYMENT_HINTS.items()],
        log_impact(text, low).alias("customer_impact"),
    )


def _any(text: Column, words) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | text.contains(word)
    return result


def log_impact(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return (
        F.when(found(low, P.LOG_IMPACT_OUTAGE, low), "outage")
        .when(found(low, P.IMPACT_DEGRADED, low), "degraded")
        .when(found(low, P.LOG_IMPACT_NONE, low), "none")
        .otherwise("")
    )


# Fixed value: recovery states that count as healthy.
RECOVERY_OK = ("rollback_succeeded", "recovered", "completed", "succeeded", "successful", "healthy")


def customer_impact(explicit: Column, text: Column, recovery: Column) -> Column:
    """Explicit status, else markers in the text, else none after confirmed recovery, else unknown."""
    stated = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    return (
        F.when(stated.isin("unknown", "none", "degraded", "outage"), stated)
        .when(found(text, P.IMPACT_OUTAGE), "outage")
        .when(found(text, P.IMPACT_DEGRADED), "degraded")
        .when(F.lower(F.coalesce(recovery, F.lit(""))).isin(*RECOVERY_OK), "none")
        .otherwise("unknown")
    )


def merge_context(explicit: DataFrame, detected: DataFrame, key: str = "artifact_id") -> DataFrame:
    """Sidecar values win; log hints fill the empty fields. Both sides hold string columns per key."""
    fields = [name for name in detected.columns if name != key]
    right = detected.select(key, *[F.col(name).alias(f"_d_{name}") for name in fields])
    own = [name for name in explicit.columns if name != key]
    merged = explicit.join(right, key, "full")
    columns = []
    for name in dict.fromkeys([*own, *fields]):
        sources = ([F.nullif(F.col(name), F.lit(""))] if name in own else []) + ([F.col(f"_d_{name}")] if name in fields else [])
        columns.append(F.coalesce(*sources, F.lit("")).alias(name))
    return merged.select(key, *columns)
