"""Mixing documents to target token shares of domains that a classifier only knows softly.

The domains are the classes of a table of labelled documents. A softmax classifier over the presence of telling words and marks,
chosen by their association with the labels, gives every document a posterior over domains. Nonnegative rates are then fitted
by projected gradient: a document's rate moves against the inner product of its posterior with the gap between expected
domain totals and targets and is cut at 0. Only the totals, one number a domain, come to the driver in a round.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultlens.llm.registry import query, table
from faultlens.llm.shared import releasing, written

MAX_TRAIN = 20_000  # labelled documents the classifier is fitted on, at most
MAX_FEATURES = 512
LEAST_DOCUMENTS = 5  # that hold a feature
STEPS = 300  # of the classifier's descent
RIDGE = 1e-4
ROUNDS = 60  # of the rates' projected gradient, at most
CLOSE = 1e-4  # gap of the totals at which it ends, of all tokens
GROUP_BYTES = 4_000_000

_PART = re.compile(r"[^\W\d_]+|[^\w\s]+")


def parts_of(word: str) -> list[str]:
    """Runs of letters and of marks in a lower-cased word."""
    return _PART.findall(word)


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    begun = 0
    while begun < len(texts):
        before = ends[begun - 1] if begun else 0
        size = max(begun + 1, int(np.searchsorted(ends, before + GROUP_BYTES))) - begun
        yield begun, size
        begun += size


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document of each word, its place among the distinct words, and these; words are lower-cased and cut at white space."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    codes = split.flatten().dictionary_encode()
    docs = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return docs, codes.indices.to_numpy().astype(np.int64), codes.dictionary.to_pylist()


def presence(texts: pa.Array, features: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and whether it holds each feature."""
    docs, codes, distinct = _words(texts)
    lists = [[features[p] for p in parts_of(word) if p in features] for word in distinct]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([f for x in lists for f in x], np.int64)
    filled = np.array([word != "" for word in distinct], bool)
    held = np.zeros((len(texts), max(1, len(features))), bool)
    some = np.flatnonzero(sizes[codes]) if len(codes) else np.empty(0, np.int64)
    counts = sizes[codes[some]] if len(some) else np.empty(0, np.int64)
    starts = (np.cumsum(sizes) - sizes)[codes[some]] if len(some) else counts
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    held[np.repeat(docs[some], counts), flat[at] if len(at) else at] = True
    n = np.bincount(docs[filled[codes]] if len(codes) else docs, minlength=len(texts))
    return n, held


@dataclass
class Classifier:
    domains: list[str]
    features: dict[str, int]
    weights: np.ndarray  # features and a constant, by domain

    def posteriors(self, held: np.ndarray) -> np.ndarray:
        scores = held[:, :len(self.features)].astype(float) @ self.weights[:-1] + self.weights[-1]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        return scores / scores.sum(axis=1, keepdims=True)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct parts of each labelled text with its domain, counted in the task."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for domain, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in {p for word in set((text or "").lower().split()) for p in parts_of(word)}:
                counts[domain, part] = counts.get((domain, part), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["domain", "part", "n"])


def _bits(features: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, held = presence(batch.column(1), features)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(held, axis=1)], pa.binary())], names=["domain", "bits"])

    return run


def fit_classifier(labelled: DataFrame) -> Classifier:
    """Classifier from ``domain`` and ``text`` rows; rows with a null domain are left out.

    At most MAX_TRAIN rows are used, picked by a hash, if there are more. Without any row there is one domain, ``any``. Null texts have no
    parts, very long ones are read whole; of parts of equal association the smaller text comes first; further columns are left out.
    """
    rows = labelled.where("domain IS NOT NULL").select("domain", "text")
    share = max(1, -(-rows.count() // MAX_TRAIN))
    train = written(rows.where(F.pmod(F.xxhash64("text", F.lit("train")), F.lit(share)) == 0).orderBy(F.xxhash64("text"), "domain").limit(MAX_TRAIN) if share > 1 else rows, "train")
    sizes = {r.domain: r["count"] for r in train.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    if not domains:
        return Classifier(["any"], {}, np.zeros((1, 1)))
    # Association of a part with the domains: chi-squared of its presence against what the domain sizes expect.
    total = sum(sizes.values())
    counts = train.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(releasing(_part_rows), "domain string, part string, n long")
    by_part = counts.groupBy("part").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)])
    held = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    chi = F.lit(0.0)
    for i, domain in enumerate(domains):
        share_of = sizes[domain] / total
        yes, no = F.col("held") * share_of, (total - F.col("held")) * share_of
        gap = F.col(f"n{i}") - yes
        chi = chi + gap * gap / yes + F.when(no > 0, gap * gap / no).otherwise(0.0)
    chosen = by_part.withColumn("held", held).where(F.col("held") >= LEAST_DOCUMENTS).orderBy(chi.desc(), "part").limit(MAX_FEATURES).select("part").collect()
    features = {row.part: i for i, row in enumerate(chosen)}
    bits = train.mapInArrow(releasing(_bits(features)), "domain string, bits binary").collect()
    x = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in bits]), axis=1)[:, :len(features)].astype(np.float32)
    y = np.array([domains.index(r.domain) for r in bits])
    return Classifier(domains, features, _softmax(x, y, len(domains)))


def _softmax(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Ridge softmax regression by accelerated descent from the class shares, over features of equal variance."""
    spread = np.sqrt(np.maximum(x.mean(axis=0) * (1 - x.mean(axis=0)), 1e-4)).astype(np.float32)
    x = np.concatenate([x / spread, np.ones((len(x), 1), np.float32)], axis=1)
    aim = np.eye(classes, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], classes), np.float32)
    w[-1] = np.log(aim.mean(axis=0) + 1e-9)
    # The largest curvature, by power iteration, gives the step.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v) / len(x)
        size = float(np.linalg.norm(v))
        v /= size
    step = 2.0 / size
    ahead, before = w.copy(), w
    for k in range(STEPS):
        scores = x @ ahead
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        grad = x.T @ (p - aim) / len(x)
        grad[:-1] += RIDGE * ahead[:-1]
        new = ahead - step * grad
        ahead, before = new + k / (k + 3) * (new - before), new
    before[:-1] /= spread[:, None]
    return before.astype(float)


def _judge(classifier: Classifier, moves: list[np.ndarray] | None):
    """Batches end with the text; it is replaced by the number of words and the posterior, and the rate if there are moves.

    One function does it all: two in a row would keep two Python processes busy for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begun, size in _groups(batch.column(batch.num_columns - 1)):
                part = batch.slice(begun, size)
                n, held = presence(part.column(part.num_columns - 1), classifier.features)
                posteriors = classifier.posteriors(held)
                fields = [*list(part.schema)[:-1], pa.field("n_tokens", pa.int64()), pa.field("posterior", pa.list_(pa.float64()))]
                columns = [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(list(posteriors), pa.list_(pa.float64()))]
                if moves is not None:
                    fields.append(pa.field("rate", pa.float64()))
                    columns.append(pa.array(rates_of(posteriors, moves)[0]))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return run


def with_posteriors(docs: DataFrame, classifier: Classifier, text: str = "text", moves: list[np.ndarray] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` (words), ``posterior`` (by domain) and, with fitted ``moves``, ``rate``.

    Null texts are empty. Columns of these names are replaced.
    """
    made = StructType.fromDDL("n_tokens long, posterior array<double>" + ("" if moves is None else ", rate double"))
    kept = [c for c in docs.columns if c not in made.names]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *made.fields])
    return rows.mapInArrow(releasing(_judge(classifier, moves)), schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *made.names)


def rates_of(posteriors: np.ndarray, moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after all moves, and the point ahead of them where the next totals are taken.

    Rates start at 1; each move takes the point ahead against the posterior's product with it, cut at 0.
    """
    rates = ahead = np.ones(len(posteriors))
    for k, move in enumerate(moves):
        new = np.maximum(0.0, ahead - posteriors @ move)
        rates, ahead = new, new + k / (k + 3) * (new - rates)
    return rates, ahead


def _totals(moves: list[np.ndarray], domains: int):
    """Expected tokens by domain at the rates so far and, in the first round, the sums of products of posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(domains), np.zeros((domains, domains))
        for batch in batches:
            p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, domains)
            tokens = batch.column(0).to_numpy()[:, None] * p
            sums += rates_of(p, moves)[1] @ tokens
            if not moves:
                products += tokens.T @ p
        yield pa.RecordBatch.from_arrays([pa.array([[*sums, *products.ravel()]], pa.list_(pa.float64()))], names=["sums"])

    return run


def fit_rates(judged: DataFrame, shares: list[float]) -> list[np.ndarray]:
    """Moves of the rates that bring the expected domain totals of ``judged`` to ``shares`` of all its tokens.

    Accelerated projected gradient of the squared gap between totals and targets, in the metric of the documents' tokens, so that equal posteriors
    get equal rates; the step is the inverse of the largest curvature. It ends when the totals are close or after ROUNDS; targets out
    of reach (a domain without any mass) stay as near as they come. Documents without tokens move nothing and follow their posterior; an
    empty table has no totals to move and gives no move, so all rates stay 1.
    """
    domains = len(shares)
    moves: list[np.ndarray] = []
    step = target = None
    for _ in range(ROUNDS):
        rows = judged.select("n_tokens", "posterior").mapInArrow(_totals(moves, domains), "sums array<double>").collect()
        sums = np.sum([r.sums for r in rows], axis=0) if rows else np.zeros(domains + domains * domains)
        totals = sums[:domains]
        if step is None:
            everything = totals.sum()
            target = np.array(shares, float) / sum(shares) * everything
            step = 1.0 / max(1e-9, float(np.linalg.eigvalsh(sums[domains:].reshape(domains, domains)).max()))
        if np.abs(totals - target).max() <= CLOSE * max(1.0, everything):
            break
        moves.append(step * (totals - target))
    return moves


def _rated(moves: list[np.ndarray], domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, domains)
            fields = [*batch.schema, pa.field("rate", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_of(p, moves)[0])], schema=pa.schema(fields))

    return run


def with_rates(judged: DataFrame, moves: list[np.ndarray]) -> DataFrame:
    """``judged`` (posterior last) with ``rate``."""
    domains = len(moves[0]) if moves else 1
    schema = StructType([*judged.schema.fields, *StructType.fromDDL("rate double").fields])
    return judged.mapInArrow(_rated(moves, domains), schema) if moves else judged.withColumn("rate", F.lit(1.0))


def copies(rate, *identity: str):
    """How often a document goes in: the whole part of its rate, and once more as often as the rest says, by a hash of the columns."""
    chance = F.pmod(F.xxhash64(*identity, F.lit("copies")), F.lit(1 << 32)) / float(1 << 32)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def label_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``domain, text`` of labelled documents: ``toxic``, else ``good`` or ``poor`` by quality; of repeated labels the worse counts."""
    judged = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return docs.select("doc_id", "text").join(judged.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL"), "doc_id").select("domain", "text")


# Shares of all tokens; domains without one get 0.
TARGETS = {"good": 0.896, "poor": 0.1, "toxic": 0.004}


def _shares(classifier: Classifier) -> list[float]:
    shares = [TARGETS.get(domain, 0.0) for domain in classifier.domains]
    return shares if sum(shares) else [1.0] * len(shares)


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as their rates say, columns as before.

    The classifier learns from the labelled documents among ``docs``. Null and empty texts have no token and go in by the rate of a text
    without features. Repeated rows have the same rate and the same number of copies each.
    """
    classifier = fit_classifier(label_domains(docs, labels))
    numbers = written(with_posteriors(docs.select("text"), classifier).select("n_tokens", "posterior"), "judged")
    moves = fit_rates(numbers, _shares(classifier))
    rated = with_posteriors(docs.select(F.struct(*docs.columns).alias("row"), "text"), classifier, moves=moves).select("row", "rate")
    times = copies(F.col("rate"), "row.doc_id", "row.text")
    return rated.withColumn("copies", times).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


@query("op9_mixing_sources")
def op9_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    classifier = fit_classifier(label_domains(docs, table(spark, folder, "labels")))
    judged = written(with_posteriors(docs, classifier).select("doc_id", "n_tokens", "posterior"), "judged")
    rated = with_rates(judged, fit_rates(judged, _shares(classifier)))
    names = [F.col("posterior")[i].alias(f"p_{domain}") for i, domain in enumerate(classifier.domains)]
    return rated.select("doc_id", "n_tokens", *names, "rate", copies(F.col("rate"), "doc_id").alias("copies"))
