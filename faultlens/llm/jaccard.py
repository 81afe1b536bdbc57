"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets fall into bands of size; two sets similar enough lie in one band or in neighbouring ones and differ in at most k elements,
k known for the band. The feature domain is dealt out by hash into parts of which at least one differs in a single element at most,
each part into three pieces; leaving out one piece after the other gives signatures, and two such sets share one. Documents
with the same set are one node. Sets that share a signature form groups. A parity bitmap gives every pair of a group a
bound that never overstates its distance; first a forest of the closest pairs within the bound is verified on the whole sets and
joined, then every pair within the bound that is still apart. So no link is lost, but where a group's members are alike only about as many
pairs as members are looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultlens.llm.components import contract
from faultlens.llm.registry import query, table
from faultlens.llm.shared import releasing, written

WORDS = 3
PERCENT = 90
PIECES = 3
FLUSH_SIGNATURES = 600_000
FLUSH_DOCS = 10_000
CACHED_WORDS = 100_000
CHUNK = 1024  # members of a group taken together; larger groups are taken chunk by chunk, each with each
LEAST_BITS = 2048  # of a bitmap; one of a larger set has as many as the set has elements, rounded up to a power of 2
BROADCAST_NODES = 1_000_000  # 8 MB of numbers, twice


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of fewer words the whole sequence is one; empty without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    row = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(row))
    out = mixed(row[:len(row) - width + 1], width)
    for i in range(1, width):
        out = mixed(out ^ row[i:len(row) - width + 1 + i])
    return np.unique(out)


def most_apart(total, percent: int = PERCENT):
    """Elements by which two sets of ``total`` elements together may differ: percent * union <= 100 * intersection."""
    return (100 - percent) * total // (100 + percent)


class Bands:
    """Bands of set sizes and the hash functions of each."""

    def __init__(self, percent: int):
        self.percent = percent
        first, limits = 1, []
        while first < 1 << 40:
            limits.append(first * 100 // percent)
            first = limits[-1] + 1
        self.limits = np.array(limits, np.int64)
        self.seeds: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.limits, size))

    def parts(self, band: int) -> int:
        """Parts of the domain: of k differing elements some part holds one at most."""
        k = int(most_apart(2 * int(self.limits[band]), self.percent))
        return (k + 2) // 2

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of a set: in its own band and, to meet smaller sets' bands, as a member of the next."""
        own = self.of(len(elements))
        places, values = mixed(elements, 1), mixed(elements, 2)
        out = []
        for band in (own, own + 1):
            n = self.parts(band)
            if band not in self.seeds:
                self.seeds[band] = mixed((np.uint64(band) << np.uint64(40)) + np.arange(n * PIECES, dtype=np.uint64), 3)
            sums = np.zeros(n * PIECES, np.uint64)
            piece = (places % np.uint64(n)) * np.uint64(PIECES) + (places >> np.uint64(40)) % np.uint64(PIECES)
            np.add.at(sums, piece.astype(np.int64), values)
            sums = sums.reshape(n, PIECES)
            out.append(mixed((sums.sum(axis=1, dtype=np.uint64)[:, None] - sums).ravel() ^ self.seeds[band]))
        return np.concatenate(out)


def planes(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: small numbers then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def _signer(percent: int, size: int, bits: int):
    """Per text its set size, node and bitmap; per task and bucket the signatures of the task's distinct nodes.

    Both go through one shuffle: texts have buckets below 0, dealt out in turn, so that copies don't meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands(percent)
        schema = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bitmap", pa.binary()), ("signatures", pa.binary()), ("places", pa.binary()), ("nodes", pa.binary())])
        nodes: dict[int, int] = {}
        held: list[np.ndarray] = []
        total = 0

        def flush():
            number = np.array(list(nodes), np.uint64)
            signatures = np.concatenate(held)
            owners = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(signatures)
            signatures, owners = signatures[order], owners[order]
            bounds = np.searchsorted(signatures >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = []
            for bucket in np.flatnonzero(np.diff(bounds)):
                own = slice(bounds[bucket], bounds[bucket + 1])
                some, places = np.unique(owners[own], return_inverse=True)
                rows.append((int(bucket), planes(np.diff(signatures[own], prepend=np.uint64(0))), planes(places.astype("<u4")), number[some].tobytes()))
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.binary()),
                 *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], schema=schema)

        for batch in batches:
            sizes, ids, bitmaps = [], [], []
            for text in batch.column(1).to_pylist():
                elements = shingle_set(text, hashes, size)
                node = int(mixed(elements, 4).sum(dtype=np.uint64))
                sizes.append(len(elements))
                ids.append(node)
                bitmaps.append(_bitmap(elements))
                if len(elements) and node not in nodes:
                    nodes[node] = len(nodes)
                    held.append(bands.signatures(elements))
                    total += len(held[-1])
                    if total > FLUSH_SIGNATURES or len(nodes) >= FLUSH_DOCS:
                        yield from flush()
                        nodes, held, total = {}, [], 0
            number = np.array(ids, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(-1 - np.arange(len(ids), dtype=np.int32) % (1 << bits)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(number.view(np.int64)),
                 pa.array(bitmaps, pa.binary()), *[pa.nulls(len(ids), pa.binary())] * 3], schema=schema)
        if held:
            yield from flush()

    return run


_SIGNED = "bucket int, row long, n long, node long, bitmap binary, signatures binary, places binary, nodes binary"
_GROUPED = "row long, n long, node long, bitmap binary, key long, check long, members array<long>"


def _bitmap(elements: np.ndarray) -> bytes:
    """Parities of the numbers of elements in classes of hashes: two sets differ in at least as many elements as bits."""
    bits = max(LEAST_BITS, 1 << max(0, len(elements) - 1).bit_length())
    parity = np.bincount((mixed(elements, 7) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _aligned(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of equal length: the longer ones are folded, which keeps the parities of the coarser classes."""
    least = min(map(len, bitmaps)) // 8
    rows = []
    for bitmap in bitmaps:
        row = np.frombuffer(bitmap, np.uint64)
        while len(row) > least:
            row = row[:len(row) // 2] ^ row[len(row) // 2:]
        rows.append(row)
    return np.stack(rows)


def _grouper(bucket: pa.Table) -> pa.Table:
    """Groups of nodes that share a signature of the bucket; equal groups once, large ones as pairs of chunks.

    Rows of texts pass through.
    """
    if bucket.column("bucket")[0].as_py() < 0:
        n = bucket.num_rows
        return pa.table([*[bucket.column(c) for c in ("row", "n", "node", "bitmap")], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                        names=["row", "n", "node", "bitmap", "key", "check", "members"])
    signatures, nodes = [], []
    for s, p, n in zip(*(bucket.column(c).to_pylist() for c in ("signatures", "places", "nodes")), strict=True):
        signatures.append(np.cumsum(from_planes(s, "<u8"), dtype=np.uint64))
        nodes.append(np.frombuffer(n, "<u8")[from_planes(p, "<u4")])
    signatures, nodes = np.concatenate(signatures), np.concatenate(nodes)
    order = np.lexsort((nodes, signatures))
    signatures, nodes = signatures[order], nodes[order]
    fresh = np.append(True, (signatures[1:] != signatures[:-1]) | (nodes[1:] != nodes[:-1]))
    signatures, nodes = signatures[fresh], nodes[fresh]
    heads = np.flatnonzero(np.append(True, signatures[1:] != signatures[:-1]))
    sizes = np.diff(np.append(heads, len(signatures)))
    key, check = np.add.reduceat(mixed(nodes, 5), heads), np.add.reduceat(mixed(nodes, 6), heads)
    several = np.flatnonzero(sizes > 1)
    _, first = np.unique(np.stack([key[several], check[several]], axis=1), axis=0, return_index=True)
    out, keys, checks = [], [], []
    for g in several[first]:
        members = nodes[heads[g]:heads[g] + sizes[g]].view(np.int64)
        if len(members) <= 2 * CHUNK:
            out.append(members)
            keys.append(int(key[g]))
            checks.append(int(check[g]))
            continue
        chunks = [members[i:i + CHUNK] for i in range(0, len(members), CHUNK)]
        for i in range(len(chunks)):
            for j in range(i + 1, len(chunks)):
                both = np.concatenate([chunks[i], chunks[j]])
                out.append(both)
                keys.append(int(mixed(both.view(np.uint64), 5).sum(dtype=np.uint64)))
                checks.append(int(mixed(both.view(np.uint64), 6).sum(dtype=np.uint64)))
    blank = {name: pa.nulls(len(out), kind) for name, kind in (("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bitmap", pa.binary()))}
    return pa.table(blank | {
        "key": pa.array(np.array(keys, np.uint64).view(np.int64)), "check": pa.array(np.array(checks, np.uint64).view(np.int64)),
        "members": pa.array(out, pa.list_(pa.int64()))})


def _elements(size: int):
    """Node and sorted elements of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, hashes, size) for text in batch.column(0).to_pylist()]
            nodes = np.array([int(mixed(x, 4).sum(dtype=np.uint64)) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "elements"])

    return run


def _elements_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Node and elements of these nodes, each from the text of one of its documents."""
    wanted = written(classes.join(nodes, "node", "left_semi").select("node", "row"), "wanted")
    few = wanted.count() <= BROADCAST_NODES  # else the texts are shuffled
    numbers, kept = wanted.select("row").distinct(), wanted.select("node")
    texts = rows.join(F.broadcast(numbers) if few else numbers, "row", "left_semi")
    found = texts.select("text").mapInArrow(releasing(_elements(size)), "node long, elements binary")
    return written(found.join(F.broadcast(kept) if few else kept, "node", "left_semi").groupBy("node").agg(F.first("elements").alias("elements")), "elements")


def _forest(nodes: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Closest pairs by bound that join all nodes which pairs within the bound can join."""
    far = 1 << 40
    best, source = np.full(len(nodes), far, np.int64), np.zeros(len(nodes), np.int64)
    waiting = np.ones(len(nodes), bool)
    current = 0
    for _ in range(len(nodes) - 1):
        waiting[current] = False
        apart = np.bitwise_count(bitmaps ^ bitmaps[current]).sum(axis=1, dtype=np.int64)
        apart[apart > most_apart(sizes + sizes[current], percent)] = far
        closer = waiting & (apart < best)
        best[closer], source[closer] = apart[closer], current
        current = int(np.where(waiting, best, far + 1).argmin())
        if best[current] < far:
            yield source[current], current


def _remaining(sizes: np.ndarray, bitmaps: np.ndarray, comps: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """All pairs within the bound whose components differ."""
    for i in range(len(sizes) - 1):
        after = slice(i + 1, None)
        apart = np.bitwise_count(bitmaps[after] ^ bitmaps[i]).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero((comps[after] != comps[i]) & (apart <= most_apart(sizes[after] + sizes[i], percent))):
            yield i, i + 1 + j


def _proposer(percent: int, first: bool):
    """Pairs of each group that the bound allows: a forest of the closest ones at first, then all that are still apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in range(batch.num_rows):
                members = batch.column(0).slice(row, 1).flatten()
                nodes, sizes, comps = (members.field(name).to_numpy() for name in ("node", "n", "comp"))
                order = np.argsort(nodes)
                bitmaps = _aligned(members.field("bitmap").to_pylist())[order]
                nodes, sizes, comps = nodes[order], sizes[order], comps[order]
                pairs = _forest(nodes, sizes, bitmaps, percent) if first else _remaining(sizes, bitmaps, comps, percent)
                found.update((int(nodes[min(i, j)]), int(nodes[max(i, j)])) for i, j in pairs)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def link_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = WORDS, nodes: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``; with ``nodes`` also ``node``, the hash of the row's set, and ``component``, a
    node that its component alone has (two components may have the same number); both null for an empty set.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is the smallest number
    reachable over links. Null and wordless texts have an empty set and link with nothing: their component is their own number. Rows
    repeated under one number are documents of their own with that number; a null number is smaller than none and leaves its
    component's id to the others (null if it is alone). Texts of any length are read whole; further columns of any name are left out; an empty
    table gives no rows. Sets are told apart by 64-bit sums of hashed shingles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("row"), F.col(text).alias("text"))
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    signed = rows.mapInArrow(releasing(_signer(percent, size, bits)), _SIGNED)
    dealt = written(signed.groupBy("bucket").applyInArrow(_grouper, _GROUPED), "dealt")
    sized = dealt.where("members IS NULL").select("row", "n", "node", "bitmap")
    groups = written(dealt.where("members IS NOT NULL").groupBy("key", "check").agg(F.first("members").alias("members")).select(
        F.monotonically_increasing_id().alias("group"), "members"), "groups")
    classes = written(sized.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "classes")
    members = groups.select("group", F.explode("members").alias("node"))
    labels = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("node").alias("comp"))
    failed = None
    for first in (True, False):
        known = classes.select("node", "n", "bitmap").join(labels, "node")
        open_ = members if first else members.join(
            members.join(labels, "node").groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("group"), "group", "left_semi")
        grouped = open_.join(known, "node").groupBy("group").agg(F.collect_list(F.struct("node", "n", "bitmap", "comp")).alias("members"))
        pairs = grouped.select("members").mapInArrow(releasing(_proposer(percent, first)), "a long, b long").distinct()
        pairs = written(pairs if first else pairs.join(failed, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        elements = _elements_of(rows, classes, ends, size)
        checked = written(
            pairs.join(elements.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a").join(elements.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(releasing(_verifier(percent)), "a long, b long, linked boolean"), "checked")
        labels = contract(labels, checked.where("linked").select("a", "b"))
        failed = checked.where("NOT linked").select("a", "b")

    least = labels.join(classes, "node").groupBy("comp").agg(F.min("row").alias("component_id"))
    own = ["comp"] if nodes else []
    named = written(labels.join(least, "comp").select("node", "component_id", *own).unionByName(
        classes.join(labels, "node", "left_anti").select("node", F.col("row").alias("component_id"), *[F.col("node").alias(c) for c in own])), "named")
    more = [F.when(F.col("n") > 0, F.col(c)).alias(name) for c, name in (("node", "node"), ("comp", "component"))] if nodes else []
    return sized.join(named, "node", "left").select(
        F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row")).alias("component_id"), *more)


def _noder(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, hashes, size) for text in batch.column(1).to_pylist()]
            nodes = np.array([int(mixed(x, 4).sum(dtype=np.uint64)) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, mask=np.array([not len(x) for x in sets], bool))], schema=pa.schema([batch.schema.field(0), pa.field("node", pa.int64())]))

    return run


def with_nodes(docs: DataFrame, text: str = "text", size: int = WORDS) -> DataFrame:
    """``docs`` with ``node``, the hash of the text's set as ``link_components`` has it; null for an empty set."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    schema = StructType([rows.schema.fields[0], StructField("node", LongType())])
    return rows.select("row", "text").mapInArrow(releasing(_noder(size)), schema).select("row.*", "node")


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[p:p + 2], ' ') FOR p IN generate_series(1, len(w) - 2)]) END AS s FROM words),
sets AS (SELECT list_sort(s) AS s, CAST(len(s) AS BIGINT) AS n, min(doc_id) AS rep FROM shingled WHERE len(s) > 0 GROUP BY ALL),
elements AS (SELECT rep, n, unnest(s) AS e FROM sets),
frequent AS (SELECT e, count(*) AS f FROM elements GROUP BY e),
-- Prefix filter: two sets with this similarity share an element among the rarest tenth (and one) of each.
ranked AS (SELECT rep, n, e, row_number() OVER (PARTITION BY rep ORDER BY f, e) AS place FROM elements JOIN frequent USING (e)),
prefixes AS (SELECT rep, n, e FROM ranked WHERE place <= n - (90 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT a.rep AS x, b.rep AS y FROM prefixes a JOIN prefixes b ON a.e = b.e AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS (
  SELECT x, y FROM candidates JOIN sets p ON p.rep = x JOIN sets q ON q.rep = y
  WHERE 100 * len(list_intersect(p.s, q.s)) >= 90 * (p.n + q.n - len(list_intersect(p.s, q.s)))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  WITH RECURSIVE r(rep, to_) AS (
    SELECT rep, rep FROM sets UNION SELECT r.rep, both_ways.y FROM r JOIN both_ways ON both_ways.x = r.to_)
  SELECT rep, min(to_) AS component_id FROM r GROUP BY rep)
SELECT shingled.doc_id, CAST(len(shingled.s) AS BIGINT) AS n_shingles, coalesce(reach.component_id, shingled.doc_id) AS component_id
FROM shingled LEFT JOIN sets ON list_sort(shingled.s) = sets.s LEFT JOIN reach ON reach.rep = sets.rep
"""


@query("op8_ngram_jaccard_join", SQL)
def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return link_components(table(spark, folder, "documents").select("doc_id", "text"))
