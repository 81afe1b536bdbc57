import random
import re

from pyspark.sql import functions as F

from faultlens.operators.triage import resolve_owners
from faultlens.plans.joins import glob_key, path_keys

RULES = "scope string, ord int, pattern string, owners array<string>"


def matches(pattern, path):
    shape = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return bool(re.fullmatch(shape, path, re.S)) or pattern.endswith("/") and path.startswith(pattern)


def test_last_matching_rule_of_many(spark):
    rng = random.Random(8)
    folder = lambda: "/".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 4)))
    name = lambda: rng.choice(["x", "main", "m1", "Makefile", "é"]) + rng.choice(["", ".py", ".c", ".test.js"])
    shapes = [lambda: f"{folder()}/".lstrip("/") or "docs/", lambda: f"{folder()}/{name()}".lstrip("/"), lambda: f"*{name()}", lambda: f"{folder()}/*".lstrip("/"), lambda: f"{folder()}*.py",
              lambda: f"{folder()}/?{name()}".lstrip("/"), lambda: "*", lambda: "a*/", lambda: f"*{folder()}*"]
    rules = [(f"s{rng.randrange(2)}", i, rng.choice(shapes)(), [f"@o{i}"]) for i in range(600)]
    paths = [(f"s{rng.randrange(3)}", rng.choice(["", "/", "//"]) + f"{folder()}/{name()}".lstrip("/")) for _ in range(300)] + [("s0", "a*/b"), ("s0", "dos\\\\main.py".replace("\\\\", "\\")), ("s0", ""), (None, "x"), ("s0", None)]
    got = {(r.scope, r.path): r.owners for r in resolve_owners(spark.createDataFrame(paths, "scope string, path string"), spark.createDataFrame(rules, RULES)).collect()}
    assert set(got) == set(paths)
    for scope, path in set(paths):
        clean = None if path is None else path.replace("\\", "/").lstrip("/")
        hits = [owners for s, _, pattern, owners in rules if s == scope and clean is not None and matches(pattern, clean)]
        assert got[scope, path] == (hits[-1] if hits else []), (scope, path)


def test_work_follows_the_folders(spark):
    """100 000 rules of one scope: a path meets the few of its own folders."""
    rules = spark.range(100_000).select(F.lit("s").alias("scope"), F.col("id").cast("int").alias("ord"), F.format_string("src/p%d/*", "id").alias("pattern"), F.array(F.format_string("@o%d", "id")).alias("owners"))
    paths = spark.range(2000).select(F.lit("s").alias("scope"), F.format_string("src/p%d/m.py", F.col("id") * 50).alias("path"))
    met = paths.select(F.explode(path_keys(F.col("path"))).alias("k")).join(rules.select(glob_key(F.col("pattern")).alias("k")), "k")
    assert met.count() == 2000
    assert resolve_owners(paths, rules).filter(F.col("owners")[0] == F.concat(F.lit("@o"), F.regexp_extract("path", r"p(\d+)/", 1))).count() == 2000
