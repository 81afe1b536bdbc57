"""Benchmark decontamination with suffix arrays over the training words.

Every task cuts its documents into shards, sorts the suffixes of each shard that start with words some benchmark item holds,
and binary-searches every benchmark suffix in that array. Runs of hits on one diagonal are joined to the longest verbatim matches,
with their places. A document lies whole in one shard, so nothing is shuffled; the benchmark goes to the tasks in blocks of
bounded size, one block after the other over the same rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens.llm.registry import query, table
from faultlens.llm.shared import releasing

WIDTH = 10
GRAM = 3  # words that pick the suffixes worth sorting
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 16_000_000  # of benchmark text sent to every task at once

# Lower-cases A-Z; every other ASCII byte but digits and lower-case letters becomes a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class TestWindows:
    """Windows of a block of benchmark items over a vocabulary of their own; built once in each task."""

    def __init__(self, items: list[tuple], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        by_size: dict[int, list] = {}
        for number, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(width, len(ids))
            for start in range(len(ids) - size + 1 if ids else 0):
                by_size.setdefault(size, []).append((number, start, ids[start:start + size]))
        self.classes = []
        for size, rows in sorted(by_size.items()):
            words = np.array([ids for _, _, ids in rows], np.int32)
            gram = min(size, GRAM)
            self.classes.append((size, gram, np.unique(_gram_keys(words[:, :gram])), _as_keys(words, width),
                                 np.array([n for n, _, _ in rows], np.int64), np.array([s for _, s, _ in rows], np.int64)))

    def matches(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """``item number, item start, shard start, size`` arrays of all windows that occur in a shard (0: no test word)."""
        if not self.classes or not len(words):
            return
        padded = np.concatenate([words, np.zeros(self.width, np.int32)])
        for size, gram, grams, keys, numbers, starts in self.classes:
            # Sparse suffix array: suffixes whose first words are the first words of some window.
            first = np.flatnonzero(words)
            columns = np.stack([padded[first + i] for i in range(gram)], axis=1) if len(first) else np.empty((0, gram), np.int32)
            first = first[np.isin(_gram_keys(columns), grams)]
            if not len(first):
                continue
            suffixes = _as_keys(padded[first[:, None] + np.arange(size)], self.width)
            order = np.argsort(suffixes, kind="stable")
            array, suffixes = first[order], suffixes[order]
            low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            count = high - low
            hit = np.flatnonzero(count)
            if len(hit):
                lengths = count[hit]
                places = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                yield np.repeat(numbers[hit], lengths), np.repeat(starts[hit], lengths), array[places], size


def _gram_keys(columns: np.ndarray) -> np.ndarray:
    key = np.zeros(len(columns), np.uint64)
    for i in range(columns.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + columns[:, i].astype(np.uint64)
    return key


def _as_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows; shorter rows are padded with 0."""
    whole = np.zeros((len(words), width), ">i4")
    whole[:, :words.shape[1]] = words
    return whole.view(f"S{4 * width}").ravel()


def _joined(number: np.ndarray, start: np.ndarray, place: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """Longest matches (item number, item start, place, words) from the windows of one size that occur in a document."""
    order = np.lexsort((start, place - start, number))
    number, start, place = number[order], start[order], place[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(number)))
    return list(zip(number[heads].tolist(), start[heads].tolist(), place[heads].tolist(), (runs + size - 1).tolist(), strict=True))


MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
_FOUND = "n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, contaminated boolean, " \
         "matches array<struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>>"


def _document_matches(tests: TestWindows, texts: list[str | None]) -> tuple[list[int], list[list[tuple]]]:
    """Word counts and longest matches of the documents of one shard; each is followed by a 0 in the shard."""
    known = tests.vocabulary.get
    parts, sizes = [], []
    for text in texts:
        words = words_of(text)
        parts += [np.fromiter(map(known, words, repeat(0)), np.int32, len(words)), np.zeros(1, np.int32)]
        sizes.append(len(words))
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    found: list[list] = [[] for _ in sizes]
    for number, start, place, size in tests.matches(np.concatenate(parts)):
        doc = np.searchsorted(ends, place, "right")
        order = np.argsort(doc, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            d = int(doc[group[0]])
            base = int(ends[d]) - sizes[d] - 1
            found[d] += _joined(number[group], start[group], place[group] - base, size)
    return sizes, found


def _summary(matches: list[dict]) -> tuple[int, list[str]]:
    covered = reach = 0
    for m in sorted(matches, key=lambda m: m["doc_start"]):
        end = m["doc_start"] + m["n_words"]
        covered += max(0, end - max(reach, m["doc_start"]))
        reach = max(reach, end)
    return covered, sorted({m["item_id"] for m in matches})


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about SHARD_WORDS words (judged by 6 characters a word); a document stays whole."""
    begun = size = 0
    for i, text in enumerate(texts):
        if size >= 6 * SHARD_WORDS:
            yield begun, i
            begun, size = i, 0
        size += len(text or "")
    if begun < len(texts):
        yield begun, len(texts)


def _matcher(shared, width: int, last: bool):
    """Batches end with the text and the matches of earlier blocks; the last block's result replaces both by the findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        tests = TestWindows(items, width)
        names = [str(name) for name, _ in items]
        for batch in batches:
            texts, earlier = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for begun, end in _shards(texts):
                sizes, found = _document_matches(tests, texts[begun:end])
                matches = [old + sorted(({"item_id": names[n], "item_start": s, "doc_start": p, "n_words": w} for n, s, p, w in new), key=lambda m: (m["doc_start"], m["item_id"], m["item_start"]))
                           for old, new in zip(earlier[begun:end], found, strict=True)]
                part = batch.slice(begun, end - begun)
                fields, columns = list(part.schema)[:-1], part.columns[:-1]
                if last:
                    fields, columns = fields[:-1], columns[:-1]
                    sums = [_summary(m) for m in matches]
                    for name, kind, values in (
                            ("n_words", pa.int64(), sizes), ("n_hit", pa.int64(), [h for h, _ in sums]), ("n_items", pa.int64(), [len(i) for _, i in sums]),
                            ("item_ids", pa.list_(pa.string()), [i for _, i in sums]),
                            ("items_sha256", pa.string(), [hashlib.sha256(",".join(i).encode()).hexdigest() for _, i in sums]),
                            ("contaminated", pa.bool_(), [h > 0 for h, _ in sums])):
                        fields.append(pa.field(name, kind))
                        columns.append(pa.array(values, kind))
                fields.append(pa.field("matches" if last else "_matches", pa.list_(MATCH)))
                columns.append(pa.array(matches, pa.list_(MATCH)))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return run


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """Benchmark items in blocks of at most BLOCK_CHARS characters (a longer item is a block of its own)."""
    block, size = [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, item_ids, items_sha256, contaminated, matches`` for each row.

    A window is ``width`` consecutive words of an item, or a shorter item whole. ``matches`` holds the longest verbatim matches:
    ``item_id`` (as text), ``item_start``, ``doc_start`` and ``n_words``, in words. ``n_hit`` counts the document's words inside any
    occurring window. Null and wordless texts have no words and no hit; null and wordless items have no window; items
    repeated under one id count once. Repeated rows stay repeated; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    found = StructType.fromDDL(_FOUND)
    kept = [c for c in docs.columns if c not in found.names]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"), F.array().cast("array<struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>>").alias("_matches"))
    blocks = _blocks(benchmark, item, text)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        last = following is None
        schema = StructType([*rows.schema.fields[:-2], *found.fields]) if last else rows.schema
        rows = rows.mapInArrow(releasing(_matcher(spark.sparkContext.broadcast(block), width, last)), schema)
        block = following
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *found.names)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark; columns as before."""
    found = find_contamination(docs.select(F.struct(*docs.columns).alias("row"), "text"), benchmark)
    return found.where(~F.col("contaminated")).select("row.*")


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, p, size FROM places JOIN windows USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op10_benchmark_decontamination", SQL)
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
