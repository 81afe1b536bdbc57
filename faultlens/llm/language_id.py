"""Language identification: words first, character n-grams for words never seen.

Training counts words and, over the distinct words, character n-grams by language in Spark. All counts stay: they lie in files
of the shared folder, sorted by 64-bit hashes and dealt out by their first bits, and are memory-mapped for scoring, so neither
the driver nor a task holds the model. A known word scores the logarithm of its frequency in each language; an unseen word
the mean of its longest known n-grams, falling back from four characters to one.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.registry import query, table
from faultlens.llm.shared import map_array, new_folder, put_file, releasing, written

MAX_WORDS = 1_000_000  # (language, word or n-gram) rows of a model file, on average; more rows make more files
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
FLUSH_WORDS = 300_000  # distinct words a task holds before it passes its counts on
CACHED_WORDS = 150_000  # words a worker keeps the scores of
GROUP = 50  # documents scored together
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) of the lower-cased text."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    # Number signs such as fractions, exponents and Roman numerals pass for word characters.
    return [part for word in words for part in ([word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split())]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between two marks; a single character has none of its own."""
    if n == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "item", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_lang: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = by_lang.setdefault(lang, Counter())
            counts.update(words_of(text))
            if len(counts) > FLUSH_WORDS:
                yield _rows(Counter({(lang, w): n for w, n in by_lang.pop(lang).items()}))
    for lang, counts in by_lang.items():
        yield _rows(Counter({(lang, w): n for w, n in counts.items()}))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], int] = {}
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for order in ORDERS:
                for gram in grams_of(word, order):
                    key = lang, gram
                    counts[key] = counts.get(key, 0) + n
        if len(counts) > FLUSH_WORDS:
            yield _rows(Counter(counts))
            counts = {}
    yield _rows(Counter(counts))


@dataclass
class Counts:
    """Counts by language of words or n-grams: sizes of their files and sums, by length of the n-gram (0: words)."""

    folder: str
    bits: int  # 2**bits files
    sizes: list[int]
    distinct: list[int]
    totals: list[dict[str, int]]


@dataclass
class Model:
    """What the driver knows of a model; the counts are in files."""

    langs: list[str]
    prior: np.ndarray
    words: Counts | None = None
    grams: Counts | None = None
    log_sizes: list[np.ndarray] = field(default_factory=list)  # by length of the n-gram (0: words)


class Lookup:
    """Counts of words or n-grams in the mapped files."""

    def __init__(self, counts: Counts, langs: int):
        self.counts, self.langs = counts, langs
        self.files: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _file(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if shard not in self.files:
            uri, size = f"{self.counts.folder}/{shard:06d}.bin", self.counts.sizes[shard]
            self.files[shard] = map_array(uri, np.uint64, 0, size), map_array(uri, np.uint64, 8 * size, size), map_array(uri, np.uint32, 16 * size, size)
        return self.files[shard]

    def __call__(self, items: list[str]) -> np.ndarray:
        """A row of counts by language for each item; zeros where it is unknown."""
        out = np.zeros((len(items), self.langs))
        hashes = np.array([hash_of(item) for item in items], np.uint64)
        order = np.argsort(hashes)
        bounds = np.searchsorted(hashes[order] >> np.uint64(64 - self.counts.bits), np.arange((1 << self.counts.bits) + 1, dtype=np.uint64))
        for shard in np.flatnonzero(np.diff(bounds)):
            if not self.counts.sizes[shard]:
                continue
            own, numbers, langs = self._file(int(shard))
            places = order[bounds[shard]:bounds[shard + 1]]
            low = np.searchsorted(own, hashes[places], "left")
            rows = np.searchsorted(own, hashes[places], "right") - low
            at = np.repeat(low - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
            out[np.repeat(places, rows), langs[at]] = numbers[at]
        return out


class Scorer:
    """Sums word scores of texts; holds the scores of words it has met, up to a number."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.grams = Lookup(model.words, len(model.langs)), Lookup(model.grams, len(model.langs))
        self.rows = np.zeros((CACHED_WORDS, len(model.langs)), np.float32)
        self.known: dict[str, int] = {}

    def _scores(self, words: list[str]) -> np.ndarray:
        counts = self.words(words)
        scores = np.log(counts + SMOOTHING) - self.model.log_sizes[0]
        left = np.flatnonzero(~counts.any(axis=1))
        scores[left] = 0
        for order in ORDERS:
            if not len(left):
                break
            found = [grams_of(words[i], order) for i in left]
            items = {gram: i for i, gram in enumerate(dict.fromkeys(gram for grams in found for gram in grams))}
            if not items:
                continue
            counts = self.grams(list(items))
            known = counts.any(axis=1)
            own = np.log(counts + SMOOTHING) - self.model.log_sizes[order]
            still = []
            for i, grams in zip(left, found, strict=True):
                at = np.fromiter((items[gram] for gram in grams), np.int64, len(grams))
                at = at[known[at]]
                if len(at):
                    scores[i] = own[at].mean(axis=0)
                else:
                    still.append(i)
            left = still
        return scores

    def totals(self, texts: list[list[str]]) -> list[np.ndarray]:
        known = self.known
        new = list({word for words in texts for word in words if word not in known})
        if len(known) + len(new) > len(self.rows):
            known = self.known = {}
            new = list({word for words in texts for word in words})
        if len(new) > len(self.rows):  # one group alone has more words than are kept
            self.rows = np.zeros((len(new), self.rows.shape[1]), np.float32)
        if new:
            self.rows[len(known):len(known) + len(new)] = self._scores(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        get = known.__getitem__
        return [self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=float) for words in texts]


def hash_of(item: str) -> int:
    """Spark's ``xxhash64`` of the text."""
    return xxhash.xxh64_intdigest(item.encode("utf-8", "replace"), 42)


def _writer(folder: str, bits: int, langs: list[str]):
    """Writes each file's counts, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs, pa.string())
        parts = [(b.column(0).to_numpy().view(np.uint64), pc.index_in(b.column(1), names).to_numpy().astype(np.uint32), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches]
        if not parts:
            return
        hashes, numbers, counts, orders = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes)
        hashes, numbers, counts, orders = hashes[order], numbers[order], counts[order], orders[order]
        shards = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for shard in np.unique(shards):
            low, high = np.searchsorted(shards, [shard, shard + 1])
            own = hashes[low:high]
            put_file(f"{folder}/{shard:06d}.bin", [own, counts[low:high].astype(np.uint64), numbers[low:high]])
            first = np.concatenate([[True], own[1:] != own[:-1]])
            distinct = np.bincount(orders[low:high][first], minlength=max(ORDERS) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard)], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([distinct.tolist()], pa.list_(pa.int64()))], names=["shard", "size", "distinct"])

    return run


def _stored(counts: DataFrame, label: str, order, langs: list[str] | None = None) -> Counts:
    """Files of all (lang, item, n) rows; ``order`` is the length of the n-gram, 0 for words."""
    totals: list[dict[str, int]] = [{} for _ in range(max(ORDERS) + 1)]
    rows = 0
    for r in counts.groupBy(order.alias("k"), "lang").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():
        totals[r.k][r.lang] = r.n
        rows += r.rows
    langs = sorted(totals[0]) if langs is None else langs
    bits = max(1, (rows // MAX_WORDS).bit_length())
    folder = new_folder(counts.sparkSession, label)
    hashed = counts.select(F.xxhash64("item").alias("hash"), "lang", "n", order.alias("k"))
    dealt = hashed.repartition(1 << bits, F.shiftrightunsigned("hash", 64 - bits))
    sizes, distinct = [0] * (1 << bits), np.zeros(max(ORDERS) + 1, np.int64)
    for r in dealt.mapInArrow(releasing(_writer(folder, bits, langs)), "shard long, size long, distinct array<long>").collect():
        sizes[r.shard] = r.size
        distinct += np.array(r.distinct)
    return Counts(folder, bits, sizes, distinct.tolist(), totals)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model from all rows with a language; null texts count nothing. No count is left out."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    schema = "lang string, item string, n long"
    words = written(labelled.mapInArrow(releasing(_count_words), schema).groupBy("lang", "item").agg(F.sum("n").alias("n")), "words")
    word_counts = _stored(words, "word-counts", F.lit(0))
    langs = sorted(word_counts.totals[0])
    if not langs:
        return Model([], np.zeros(0))
    # The distinct words lie in few, small files: dealt out before the work on their characters.
    spread = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grams = written(spread.mapInArrow(releasing(_count_grams), schema).groupBy("lang", "item").agg(F.sum("n").alias("n")), "grams")
    gram_counts = _stored(grams, "gram-counts", F.length("item"), langs)
    log_sizes = []
    for order in range(max(ORDERS) + 1):
        counts = gram_counts if order else word_counts
        log_sizes.append(np.log(np.array([counts.totals[order].get(x, 0) for x in langs]) + SMOOTHING * (counts.distinct[order] + 1)))
    prior = np.array([word_counts.totals[0][x] for x in langs], float)
    return Model(langs, prior / prior.sum(), word_counts, gram_counts, log_sizes)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scorer = Scorer(model) if model.langs else None
        for batch in batches:
            preds, scores = [], []
            for begun in range(0, batch.num_rows, GROUP):
                texts = [words_of(text) if model.langs else [] for text in batch.column(batch.num_columns - 1).slice(begun, GROUP).to_pylist()]
                totals = scorer.totals(texts) if scorer else [None] * len(texts)
                for words, total in zip(texts, totals, strict=True):
                    if not words:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    weight = np.exp(total - total.max()) if total.any() else model.prior
                    best = int(weight.argmax())
                    preds.append(model.langs[best])
                    scores.append(float(weight[best] / weight.sum()))
            fields = [*list(batch.schema)[:-1], pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema(fields))

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the language's share) from the text alone.

    A null text and one without a letter, or any text where the model knows no language, gets ``und`` and 0. Equal shares go to the smaller language name; a text of
    characters never seen in training gets the most frequent language with its share. Repeated rows stay repeated;
    columns named like the new ones are replaced.
    """
    from pyspark.sql.types import StructType

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("lang_pred string, score double").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(releasing(_predictor(shared)), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score")


def held_out(doc: str = "doc_id"):
    """Documents kept from training: crc32 of the number as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % 4 == 2, F.lit(False))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
