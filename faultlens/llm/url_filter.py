"""URL filter: host and path rules, found through a blocked Bloom filter and an exact hash join.

A rule is a canonical URL without scheme: a host, which also stands for its subdomains, and the start of a path. A URL can
only fit rules whose host is one of its host suffixes and whose path is one of its path's beginnings, so each URL has a few
keys. The Bloom filter is a table of 64-bit blocks of bounded size, joined by block number without a shuffle; what passes it
meets the rules in an exact join, which removes false positives. Of the fitting rules the longest wins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.registry import query, table

BITS_PER_KEY = 16
BITS_SET = 5
MAX_BLOCKS = 1 << 20  # 2 longs a row: bounds the broadcast filter to about 32 MB
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    start = F.instr(url, F.lit("://"))
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """Number of the key's block, and its bits in it."""
    digest = F.xxhash64(key, F.lit("bits"))
    bits = F.lit(0).cast("long")
    for i in range(BITS_SET):
        place = F.shiftrightunsigned(digest, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), bits


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter of a column: one row ``block, mask`` for each block in use, ``blocks`` at most."""
    block, bits = _block_and_bits(F.col(key), blocks)
    return keys.groupBy(block.alias("block")).agg(F.bit_or(bits).alias("mask"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` for each row.

    ``rules`` has ``host``, ``path`` and ``verdict``. The longest fitting rule wins, of equal ones the longer host and then
    the smaller text; of rules repeated with different verdicts ``block`` wins. A URL that no rule fits, also a null or
    empty one, gets a null rule and ``default``. Rules with a null or empty host fit nothing; a null path counts as empty.
    Repeated rows stay repeated; columns of ``pages`` with the names of the new ones are replaced, any other name is kept. Very long
    URLs are judged whole; an empty table of pages gives no rows.
    """
    listed = (
        rules.where(F.length("host") > 0)
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("rule_verdict") == "block").alias("b"), "rule_verdict")).alias("v"))
        .select(F.concat("rule_host", F.lit("\n"), "rule_path").alias("key"), "rule_host", "rule_path", F.col("v.rule_verdict").alias("rule_verdict"))
    )
    # Bounded by the longest host and path: the label counts and path lengths that occur in rules.
    shape = listed.agg(
        F.count("*").alias("n"), F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")
    ).first()
    blocks = 1
    while blocks < min(MAX_BLOCKS, shape.n * BITS_PER_KEY / 64):
        blocks *= 2
    labels = F.array(*map(F.lit, sorted(shape.labels))) if shape.labels else F.array().cast("array<int>")
    lengths = F.array(*map(F.lit, sorted(shape.lengths))) if shape.lengths else F.array().cast("array<int>")

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # A URL that very many rows share is dealt over some groups.
    # Columns of the pages have numbers as names inside, so none clashes.
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    rows = pages.select(*named, F.pmod(F.xxhash64(*kept), F.lit(SALTS)).alias("_salt"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    distinct = rows.select("_url", "_salt").where("_url IS NOT NULL").distinct().select("_url", "_salt", host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p))))
    candidates = distinct.where(F.length("host") > 0).select("_url", "_salt", F.explode(keys).alias("key"))
    block, bits = _block_and_bits(F.col("key"), blocks)
    possible = (
        candidates.withColumns({"block": block, "bits": bits})
        .join(F.broadcast(bloom_table(listed, "key", blocks)), "block")
        .where(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"))
        .select("_url", "_salt", "key")
    )
    best = (
        possible.join(listed, "key")
        .groupBy("_url", "_salt")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")),
                      F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), "rule_host", "rule_path")).alias("best"))
    )
    host, path = host_and_path(F.col("_url"))
    return rows.join(best, ["_url", "_salt"], "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


# Fixed values of the registered query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

SQL = f"""
WITH listed(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rested AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parted AS (
  SELECT n, page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rested),
hosted AS (SELECT n, page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, path FROM parted),
fitting AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM hosted JOIN listed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM hosted LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)
"""


@query("op1_url_filters", SQL)
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
