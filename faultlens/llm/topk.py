"""Exact top-k inner products with vectors grouped by length.

Vectors are sorted by length and packed into buckets, queries into blocks. A first pass over the bucket of longest vectors
gives every query a lower bound of its k-th score. From it follows a cosine that a vector of a bucket needs at least. Blocks
meet only the buckets whose length can reach the bound of one of their queries; there a query whose needed cosine exceeds 1 is done, one with a high
cosine looks at the vectors whose strongest coordinates lie in the feasible range, another at the vectors long enough; the
products of what is left are computed in full. Buckets and blocks have bounded sizes, so each pair is a bounded piece of work.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.llm.registry import query, table
from faultlens.llm.shared import written

K = 20
BUCKET_ROWS = 4096
BLOCK_ROWS = 1024
COORDINATE_COSINE = 0.7  # above it coordinates prune better than lengths
FOCUS = 4  # coordinates looked at
EXACT = float(1 << 53)

_PACKED = "dim int, longest double, shortest double, ids binary, vectors binary"


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _packer(rows: int):
    """Packs rows sorted by dimension and falling length into batches of bounded size, one output row each."""

    def pack(dim: int, ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        matrix = np.array(vectors, np.int64).reshape(len(ids), dim)
        lengths = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "longest": pa.array([lengths.max()]), "shortest": pa.array([lengths.min()]),
            "ids": [np.array(ids, "<i8").tobytes()], "vectors": [matrix.astype("<i8").tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, ids, vectors = 0, [], []
        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (len(vector) != dim or len(ids) >= rows):
                    yield pack(dim, ids, vectors)
                    ids, vectors = [], []
                dim = len(vector)
                ids.append(vec_id)
                vectors.append(vector)
        if ids:
            yield pack(dim, ids, vectors)

    return run


def _packed(vectors: DataFrame, rows: int, label: str, number: str) -> DataFrame:
    """Table of packs of at most ``rows`` vectors of one dimension and similar length, numbered."""
    order = ["dim", F.desc("length"), "vec_id"]
    parts = max(1, -(-vectors.count() // rows))
    packs = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "vector").mapInArrow(_packer(rows), _PACKED)
    return written(packs.select(F.monotonically_increasing_id().alias(number), "*"), label)


def _unpack(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; floating point only where it is exact."""
    bound = np.abs(left).max(initial=0).astype(float) * np.abs(right).max(initial=0).astype(float) * left.shape[1]
    if bound < EXACT:
        return np.rint(left.astype(float) @ right.astype(float).T).astype(np.int64)
    if bound < 2.0 ** 63:
        return left @ right.T
    exact = left.astype(object) @ right.astype(object).T
    if exact.size and max(abs(x) for x in exact.ravel()) >= 2 ** 63:
        raise OverflowError("an inner product exceeds 64 bits")
    return exact.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
        return places[np.lexsort((ids[places], -scores[places]))[:k]]
    return np.lexsort((ids, -scores))


def search_pair(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``query place, vector places, scores`` of each query's k best of a bucket that reach its bound ``least`` (-inf: none)."""
    query_length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    longest = length.max()
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least > 0, least * (1 - 1e-12) / (query_length * longest), -np.inf)
    alive = ~(cosine > 1 + 1e-9)
    by_coordinate = alive & (cosine >= COORDINATE_COSINE)
    by_length = np.flatnonzero(alive & ~by_coordinate)
    direction = None
    for q in np.flatnonzero(by_coordinate):
        if direction is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                direction = np.where(length[:, None] > 0, vectors / length[:, None], 0.0)
        own = queries[q] / query_length[q]
        angle = np.arccos(min(1.0, cosine[q]))
        keep = np.ones(len(vectors), bool)
        for f in np.argsort(-np.abs(own))[:FOCUS]:
            # A vector within the angle of the query has its own angle to the axis within it of the query's.
            middle = np.arccos(np.clip(own[f], -1, 1))
            low, high = np.cos(min(np.pi, middle + angle)), np.cos(max(0.0, middle - angle))
            keep &= (direction[:, f] >= low - 1e-9) & (direction[:, f] <= high + 1e-9)
        places = np.flatnonzero(keep)
        yield from _verified(q, queries, query_ids, least, vectors, ids, places, k)
    # Lengths fall within a bucket: the vectors that are long enough come first.
    for begun in range(0, len(by_length), 256):
        some = by_length[begun:begun + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(least[some] > 0, least[some] * (1 - 1e-12) / query_length[some], 0.0)
        reach = np.searchsorted(-length, -needed + 1e-9, "right")
        scores = _products(queries[some], vectors[:reach.max(initial=0)])
        for i, q in enumerate(some):
            row = scores[i, :reach[i]]
            places = np.flatnonzero((row >= least[q]) & (ids[:reach[i]] != query_ids[q]))
            if len(places):
                best = places[_best(row[places], ids[places], k)]
                yield int(q), best, row[best]


def _verified(q, queries, query_ids, least, vectors, ids, places, k):
    scores = _products(queries[q:q + 1], vectors[places])[0]
    kept = np.flatnonzero((scores >= least[q]) & (ids[places] != query_ids[q]))
    if len(kept):
        best = kept[_best(scores[kept], ids[places[kept]], k)]
        yield int(q), places[best], scores[best]


_FOUND = "query_id long, vec_id long, score long"


def _searcher(k: int):
    """Rows ``q_ids, q_vectors, least, dim, ids, vectors``: a block of queries against a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_vectors, least, dim, ids, vectors = (column[row].as_py() for column in batch.columns)
                query_ids, queries = _unpack(dim, q_ids, q_vectors)
                vector_ids, matrix = _unpack(dim, ids, vectors)
                bounds = np.frombuffer(least, "<f8") if least is not None else np.full(len(query_ids), -np.inf)
                out = list(search_pair(queries, query_ids, bounds, matrix, vector_ids, k))
                if out:
                    counts = [len(places) for _, places, _ in out]
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.repeat(query_ids[[q for q, _, _ in out]], counts).astype(np.int64),
                        "vec_id": vector_ids[np.concatenate([places for _, places, _ in out])].astype(np.int64),
                        "score": np.concatenate([scores for _, _, scores in out]).astype(np.int64)})

    return run


def _bounds(k: int):
    """Rows of blocks with the bucket of longest vectors: the k-th best score of each query in it, or -inf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, longest, dim, q_ids, q_vectors, ids, vectors = (column[row].as_py() for column in batch.columns)
                query_ids, queries = _unpack(dim, q_ids, q_vectors)
                vector_ids, matrix = _unpack(dim, ids, vectors)
                least = np.full(len(query_ids), -np.inf)
                for q, _, scores in search_pair(queries, query_ids, least.copy(), matrix, vector_ids, k):
                    if len(scores) == k:
                        least[q] = scores[-1]
                length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(least > 0, least / length, 0.0).min()  # no vector shorter than this matters to the block
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "dim": pa.array([dim], pa.int32()), "reach": pa.array([float(reach) * (1 - 1e-9)]),
                    "q_ids": pa.array([q_ids], pa.binary()), "q_vectors": pa.array([q_vectors], pa.binary()), "least": pa.array([least.astype("<f8").tobytes()], pa.binary())})

    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k highest inner products of each query: ``query_id, rank, vec_id, score``, ties to the smaller ``vec_id``.

    Both tables have ``vec_id`` and ``vector`` (array of long). Null ids and vectors and vectors with a null component take no part, nor do empty ones; a
    query meets only vectors of its own dimension and not those under its own number, also where that number repeats. Rows repeated in ``vectors``
    count once each; of queries repeated under one number the smallest vector is asked. Products beyond 64 bits raise OverflowError.
    Further columns of any name are left out; an empty table of queries or of vectors gives no rows.
    """
    def usable(df: DataFrame) -> DataFrame:
        squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        return df.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)").select(
            F.col("vec_id").cast("long").alias("vec_id"), "vector", F.size("vector").alias("dim"), F.sqrt(squares).alias("length"))

    buckets = _packed(usable(vectors), BUCKET_ROWS, "buckets", "bucket")
    asked = usable(queries).groupBy("vec_id", "dim").agg(F.min(F.struct("vector", "length")).alias("q")).select("vec_id", "dim", "q.*")
    blocks = _packed(asked, BLOCK_ROWS, "blocks", "block").select(
        "block", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("longest").alias("q_longest"))
    # The bucket of longest vectors of each dimension: one bounded row a dimension.
    first = buckets.groupBy("dim").agg(F.max_by("bucket", F.struct("longest", -F.col("bucket"))).alias("bucket"))
    seeds = buckets.join(first.select("bucket"), "bucket").select("dim", "ids", "vectors")
    bounded = written(
        blocks.join(seeds, "dim").select("block", "q_longest", "dim", "q_ids", "q_vectors", "ids", "vectors")
        .mapInArrow(_bounds(k), "block long, dim int, reach double, q_ids binary, q_vectors binary, least binary"), "bounds")
    # Which block meets which bucket is decided on their numbers alone, then the packs are fetched.
    shape = buckets.select("bucket", "dim", "longest")
    pairs = bounded.select("block", "dim", "reach").join(shape, "dim").where("longest >= reach").select("block", "bucket")
    parts = max(1, pairs.count())
    work = (
        pairs.join(bounded, "block").join(buckets.select("bucket", "ids", "vectors"), "bucket")
        .repartition(min(parts, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block", "bucket")
        .select("q_ids", "q_vectors", "least", "dim", "ids", "vectors"))
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return work.mapInArrow(_searcher(k), _FOUND).select("query_id", ranked.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""


@query("op3_exact_topk", SQL)
def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    finite = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    vectors = rows.where(finite).select("vec_id", whole_numbers(F.col("embedding"), 64).alias("vector"))
    return top_products(vectors, vectors.where("vec_id % 20 = 0"))
