"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays and memory-mapped for scoring.

Words are counted and become numbers: the places of their hashes in the sorted hash array. Tasks turn texts into word numbers
and count pairs before the shuffle; pairs are dealt out by their context, those of very frequent contexts also by the
second word. Each share becomes a file with the sorted hashes of its pairs and their counts; sums by context and
by second word become dense arrays over the word numbers. No task and no driver holds the model: scoring maps the files and
reads what its texts need. What grows with the corpus is in files; the driver keeps one row a file.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.registry import query, table
from faultlens.llm.shared import map_array, new_folder, put_file, written

FLUSH_WORDS = 400_000  # distinct words a task holds before it passes their counts on
FLUSH_PAIRS = 3_000_000  # pairs a task holds before it counts them and passes them on
CACHED_WORDS = 400_000  # words a scoring task keeps what it knows of
GROUP_CHARS = 600_000  # texts scored together
TOP_WORDS = 64  # of each file of words, looked at for very frequent contexts
END = b"\n"  # no word is white space
END_SLOT, BEGIN_SLOT = 0, 1


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def planes(values: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: small numbers then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


@dataclass
class Model:
    """What the driver knows of a model: sizes and places of its files and the discounts."""

    folder: str
    bits: int  # 2**bits files of each kind
    word_sizes: list[int]
    n_words: int = 0  # distinct training tokens, the end included
    n_tokens: int = 0
    hot: list[int] = field(default_factory=list)  # contexts whose pairs are dealt out by both words
    pair_sizes: list[int] = field(default_factory=list)
    n_pairs: int = 0
    pair_discounts: tuple = (0.5, 1.0, 1.5)
    word_discounts: tuple = (0.5, 1.0, 1.5)
    word_backoff: float = 1.0  # mass that single words leave to the uniform distribution

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.word_sizes)]).astype(np.int64)

    @property
    def part_size(self) -> int:
        """Word numbers of a file of dense arrays; two more than the words: unknown and begin."""
        return -(-(self.n_words + 2) // (1 << self.bits))

    def pair_shard(self, context: np.ndarray, keys: np.ndarray) -> np.ndarray:
        by_context = mixed(context.astype(np.uint64) + np.uint64(1))
        hot = np.isin(context, np.array(self.hot, np.int64))
        return (np.where(hot, mixed(keys ^ np.uint64(0x5851F42D4C957F2D)), by_context) >> np.uint64(64 - self.bits)).astype(np.int64)


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries with counts 1 to 4; fixed ones where those are 0."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def discount_of(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows():
        hashes = np.array([hash_of(word) for word in counts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["hash", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
            counts[END] += 1
            if len(counts) > FLUSH_WORDS:
                yield rows()
                counts = Counter()
    if counts:
        yield rows()


def _word_writer(folder: str, bits: int):
    """Writes each file's words, sorted by hash, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        shards = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for shard in np.unique(shards):
            low, high = np.searchsorted(shards, [shard, shard + 1])
            own, n = hashes[low:high], counts[low:high]
            put_file(f"{folder}/words-{shard:06d}.bin", [own, n.astype(np.uint64)])
            top = np.argsort(-n, kind="stable")[:TOP_WORDS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(shard)], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                 pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([n[top].tolist()], pa.list_(pa.int64()))], names=["shard", "size", "total", "top", "top_counts"])

    return run


class Words:
    """Numbers and counts of words, looked up in the mapped hash arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.offsets = model.offsets
        self.files: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _file(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self.files:
            uri, size = f"{self.model.folder}/words-{shard:06d}.bin", self.model.word_sizes[shard]
            self.files[shard] = map_array(uri, np.uint64, 0, size), map_array(uri, np.uint64, 8 * size, size)
        return self.files[shard]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (n_words: unknown) and counts."""
        hashes = np.array([hash_of(word) for word in words], np.uint64)
        numbers, counts = np.full(len(words), self.model.n_words, np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(hashes)
        ordered = hashes[order]
        bounds = np.searchsorted(ordered >> np.uint64(64 - self.model.bits), np.arange((1 << self.model.bits) + 1, dtype=np.uint64))
        for shard in np.flatnonzero(np.diff(bounds)):
            if not self.model.word_sizes[shard]:
                continue
            own, n = self._file(int(shard))
            places = order[bounds[shard]:bounds[shard + 1]]
            at = np.minimum(np.searchsorted(own, hashes[places]), len(own) - 1)
            found = own[at] == hashes[places]
            numbers[places[found]] = self.offsets[shard] + at[found]
            counts[places[found]] = n[at[found]]
        return numbers, counts


class Numbers:
    """Word numbers of texts, with a table of bounded size."""

    def __init__(self, model: Model):
        self.words, self.table = Words(model), {}

    def __call__(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.table) > CACHED_WORDS:
            self.table = {}
        known = self.table
        new = list({word for words in texts for word in words if word not in known})
        known.update(zip(new, self.words.look_up(new)[0].tolist(), strict=True))
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begun = size = 0
    for i, text in enumerate(texts):
        if size >= GROUP_CHARS:
            yield begun, i
            begun, size = i, 0
        size += len(text or "") + 20
    if begun < len(texts):
        yield begun, len(texts)


_SHARES = "shard long, contexts binary, words binary, counts binary"


def _count_pairs(model: Model):
    """Pairs (context, word) of the training texts, counted in each task, one row for each share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(model)
        begin = model.n_words + 1
        end = int(numbers([[END]])[0][0])
        held: list[np.ndarray] = []
        size = 0

        def shares():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            contexts = (keys >> np.uint64(32)).astype(np.int64)
            shard = model.pair_shard(contexts, keys)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange((1 << model.bits) + 1))
            for s in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[s]:bounds[s + 1]]
                steps = np.diff(contexts[own], prepend=0).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(s)], pa.int64()), pa.array([planes(steps)], pa.binary()),
                     pa.array([planes((keys[own] & np.uint64(0xFFFFFFFF)).astype("<u4"))], pa.binary()), pa.array([planes(counts[own].astype("<u4"))], pa.binary())],
                    names=["shard", "contexts", "words", "counts"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in _groups(texts):
                for row in numbers([words_of(text) for text in texts[low:high]]):
                    whole = np.empty(len(row) + 2, np.uint64)
                    whole[0], whole[1:-1], whole[-1] = begin, row, end
                    held.append((whole[:-1] << np.uint64(32)) | whole[1:])
                    size += len(whole)
                if size > FLUSH_PAIRS:
                    yield from shares()
                    held, size = [], 0
        if held:
            yield from shares()

    return run


_SUMS = "part long, contexts binary, context_sums binary, words binary, word_sums binary, shard long, size long, ones array<long>"


def _pair_writer(model: Model):
    """Writes one share's pairs, sorted by hash, and passes on its sums by context and by word."""

    def run(share: pa.Table) -> pa.Table:
        shard = int(share.column("shard")[0].as_py())
        keys, counts = [], []
        for contexts, words, n in zip(*(share.column(c).to_pylist() for c in ("contexts", "words", "counts")), strict=True):
            context = np.cumsum(from_planes(contexts, "<u4").astype(np.uint64))
            keys.append((context << np.uint64(32)) | from_planes(words, "<u4"))
            counts.append(from_planes(n, "<u4").astype(np.uint64))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[heads], np.add.reduceat(counts, heads)
        hashes = mixed(keys)
        order = np.argsort(hashes)
        put_file(f"{model.folder}/pairs-{shard:06d}.bin", [hashes[order], counts[order]])
        contexts, words = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
        sums = np.stack([np.add.reduceat(x, heads) for x in (counts, (counts == 1).astype(np.uint64), (counts == 2).astype(np.uint64), (counts > 2).astype(np.uint64))])
        contexts = contexts[heads]
        words, preceding = np.unique(words, return_counts=True)
        rows = []
        size = model.part_size
        for part in np.union1d(contexts // size, words // size):
            a, b = np.searchsorted(contexts, [part * size, (part + 1) * size])
            c, d = np.searchsorted(words, [part * size, (part + 1) * size])
            rows.append({
                "part": int(part), "contexts": planes(np.diff(contexts[a:b], prepend=0).astype("<u4")), "context_sums": b"".join(planes(x[a:b].astype("<u8")) for x in sums),
                "words": planes(np.diff(words[c:d], prepend=0).astype("<u4")), "word_sums": planes(preceding[c:d].astype("<u4")), "shard": -1, "size": 0, "ones": []})
        rows[0] |= {"shard": shard, "size": len(keys), "ones": [int((counts == k).sum()) for k in range(1, 5)]}
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("part", pa.int64()), ("contexts", pa.binary()), ("context_sums", pa.binary()), ("words", pa.binary()), ("word_sums", pa.binary()),
            ("shard", pa.int64()), ("size", pa.int64()), ("ones", pa.list_(pa.int64()))]))

    return run


def _dense_writer(model: Model):
    """Writes a range of word numbers as dense arrays: context total, contexts' pairs by count 1, 2, more, and contexts of the word."""

    def run(share: pa.Table) -> pa.Table:
        part = int(share.column("part")[0].as_py())
        size = model.part_size
        dense = np.zeros((5, size), np.uint64)
        for contexts, sums, words, preceding in zip(*(share.column(c).to_pylist() for c in ("contexts", "context_sums", "words", "word_sums")), strict=True):
            at = np.cumsum(from_planes(contexts, "<u4").astype(np.int64)) - part * size
            for i in range(4):
                np.add.at(dense[i], at, from_planes(sums[8 * i * len(at):8 * (i + 1) * len(at)], "<u8"))
            at = np.cumsum(from_planes(words, "<u4").astype(np.int64)) - part * size
            np.add.at(dense[4], at, from_planes(preceding, "<u4").astype(np.uint64))
        put_file(f"{model.folder}/dense-{part:06d}.bin", [dense])
        n = [int((dense[4] == k).sum()) for k in range(1, 5)]
        return pa.Table.from_pylist([{"part": part, "ones": n, "types": int((dense[4] > 0).sum()), "pairs": int(dense[4].sum())}], schema=pa.schema([
            ("part", pa.int64()), ("ones", pa.list_(pa.int64())), ("types", pa.int64()), ("pairs", pa.int64())]))

    return run


def train(docs: DataFrame, text: str = "text") -> Model:
    """Model of all texts of ``docs`` (null: empty, only an end). Without rows it knows no word and is uniform."""
    spark = docs.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shards = 1 << bits
    model = Model(new_folder(spark, "lm"), bits, [0] * shards)
    texts = docs.select(F.col(text).alias("text"))
    counted = texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    files = counted.repartition(shards, F.shiftrightunsigned("hash", 64 - bits)).mapInArrow(
        _word_writer(model.folder, bits), "shard long, size long, total long, top array<long>, top_counts array<long>").collect()
    for row in files:
        model.word_sizes[row.shard] = row.size
    model.n_words, model.n_tokens = sum(model.word_sizes), sum(row.total for row in files)
    if model.n_words + 2 > 1 << 32:
        raise ValueError("more distinct words than 32-bit numbers")
    offsets = model.offsets
    model.hot = [model.n_words + 1] + sorted(
        int(offsets[row.shard]) + place for row in files for place, n in zip(row.top, row.top_counts, strict=True) if n > model.n_tokens / (4 * shards))
    model.pair_sizes = [0] * shards
    if not files:
        return model
    sums = written(texts.mapInArrow(_count_pairs(model), _SHARES).groupBy("shard").applyInArrow(_pair_writer(model), _SUMS), "lm-sums")
    ones = np.zeros(4, np.int64)
    for row in sums.where("shard >= 0").select("shard", "size", "ones").collect():
        model.pair_sizes[row.shard] = row.size
        ones += row.ones
    model.pair_discounts = discounts(ones.tolist())
    dense = sums.select("part", "contexts", "context_sums", "words", "word_sums").groupBy("part").applyInArrow(
        _dense_writer(model), "part long, ones array<long>, types long, pairs long").collect()
    ones = np.sum([row.ones for row in dense], axis=0)
    types, model.n_pairs = sum(row.types for row in dense), sum(row.pairs for row in dense)
    model.word_discounts = d1, d2, d3 = discounts(ones.tolist())
    model.word_backoff = float((d1 * ones[0] + d2 * ones[1] + d3 * (types - ones[0] - ones[1])) / model.n_pairs)
    return model


class Scorer:
    """Log probabilities of texts from the mapped files."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.dense: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.size = 0
        # Of each word met: its number, count, probability alone, total as context, mass left to single words.
        self.known = np.zeros((5, CACHED_WORDS))
        self._learn([END])
        number = np.array([self.model.n_words + 1])
        self._add(number, np.zeros(1, np.int64))

    def _dense_rows(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros((5, len(numbers)))
        part = numbers // self.model.part_size
        if not self.model.n_pairs:
            return out
        for p in np.unique(part):
            p = int(p)
            if p not in self.dense:
                size = self.model.part_size
                try:
                    self.dense[p] = map_array(f"{self.model.folder}/dense-{p:06d}.bin", np.uint64, 0, 5 * size).reshape(5, size)
                except FileNotFoundError:  # no pair touches this range: it holds only the mark for unknown words
                    self.dense[p] = np.zeros((5, size), np.uint64)
            own = part == p
            out[:, own] = self.dense[p][:, numbers[own] - p * self.model.part_size]
        return out

    def _add(self, numbers: np.ndarray, counts: np.ndarray) -> None:
        model = self.model
        total, one, two, more, contexts = self._dense_rows(numbers)
        alone = np.full(len(numbers), model.word_backoff / (model.n_words + 1))
        if model.n_pairs:
            alone = alone + (contexts - discount_of(contexts, model.word_discounts)) / model.n_pairs
        d1, d2, d3 = model.pair_discounts
        left = np.where(total > 0, (d1 * one + d2 * two + d3 * more) / np.maximum(total, 1), 1.0)
        if self.size + len(numbers) > self.known.shape[1]:
            self.known = np.concatenate([self.known, np.zeros((5, len(numbers)))], axis=1)
        self.known[:, self.size:self.size + len(numbers)] = numbers, counts, alone, total, left
        self.size += len(numbers)

    def _learn(self, words: list[bytes]) -> None:
        self.table.update(zip(words, range(self.size, self.size + len(words)), strict=True))
        self._add(*self.words.look_up(words))

    def pair_counts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        keys, back = np.unique((contexts.astype(np.uint64) << np.uint64(32)) | words.astype(np.uint64), return_inverse=True)
        shard = self.model.pair_shard((keys >> np.uint64(32)).astype(np.int64), keys)
        hashes = mixed(keys)
        order = np.lexsort((hashes, shard))
        bounds = np.searchsorted(shard[order], np.arange((1 << self.model.bits) + 1))
        counts = np.zeros(len(keys), np.int64)
        for s in np.flatnonzero(np.diff(bounds)):
            s, size = int(s), self.model.pair_sizes[s]
            if not size:
                continue
            if s not in self.pairs:
                uri = f"{self.model.folder}/pairs-{s:06d}.bin"
                self.pairs[s] = map_array(uri, np.uint64, 0, size), map_array(uri, np.uint64, 8 * size, size)
            own, n = self.pairs[s]
            places = order[bounds[s]:bounds[s + 1]]
            at = np.minimum(np.searchsorted(own, hashes[places]), size - 1)
            found = own[at] == hashes[places]
            counts[places[found]] = n[at[found]]
        return counts[back]

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base and model log10 probability."""
        model = self.model
        table = self.table
        new = list({word for words in texts for word in words if word not in table})
        if self.size + len(new) > CACHED_WORDS:
            self._clear()
            table = self.table
            new = list({word for words in texts for word in words if word not in table})
        self._learn(new)
        sizes = np.array([len(words) + 1 for words in texts])
        heads = np.cumsum(sizes) - sizes
        slots = np.empty(sizes.sum(), np.int64)
        for head, words in zip(heads.tolist(), texts, strict=True):
            slots[head:head + len(words)] = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
        slots[heads + sizes - 1] = END_SLOT
        before = np.empty_like(slots)
        before[1:] = slots[:-1]
        before[heads] = BEGIN_SLOT
        number, count, alone = self.known[0, slots], self.known[1, slots], self.known[2, slots]
        context, total, left = self.known[0, before], self.known[3, before], self.known[4, before]
        chance = left * alone
        seen = np.flatnonzero((total > 0) & (number < model.n_words))
        pairs = self.pair_counts(context[seen].astype(np.int64), number[seen].astype(np.int64))
        chance[seen] += (pairs - discount_of(pairs, model.pair_discounts)) / total[seen]
        base = np.log10((count + 1) / (model.n_tokens + model.n_words + 1))
        return sizes, np.add.reduceat((count > 0).astype(np.int64), heads), np.add.reduceat(base, heads), np.add.reduceat(np.log10(chance), heads)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for low, high in _groups(texts):
                sizes, known, base, score = scorer.score([words_of(text) for text in texts[low:high]])
                part = batch.slice(low, high - low)
                fields = [*list(part.schema)[:-1], pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()), pa.field("train_tokens", pa.int64()),
                          pa.field("base_score", pa.float64()), pa.field("score", pa.float64()), pa.field("perplexity", pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(sizes), model.n_tokens), pa.int64()),
                     pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300.0))], schema=pa.schema(fields))

    return run


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each row.

    Null texts are empty: one token, the end. Words never seen in training get the mass the model leaves to them, so every
    score is finite. Repeated rows stay repeated; columns named like the new ones are replaced.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    kept = [c for c in docs.columns if c not in made.names]
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *made.fields])
    return rows.mapInArrow(_score(model), schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *made.names)


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    scored = score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
