"""Token files: ids of each document, compressed on its own with a zstandard dictionary that all files share.

The dictionary is trained on the serialized ids of a bounded sample of documents. Documents are dealt out by ranges of their number and
each range becomes one file: frames of the documents in order, then an index row (number, frame offset, frame length,
ids) for each, then a trailer with the index offset, the number of documents, the dictionary's hash and a mark. A reader checks
the hash and takes any one document by its index row. Ids are little-endian unsigned 32-bit integers.
"""
from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.registry import query, table
from faultlens.llm.shared import locate, new_folder, put_file, releasing

READ_IDS = 2_000_000
SAMPLE_DOCS = 2000  # documents the dictionary is trained on, about
SAMPLE_CHARS = 10_000  # characters of each of them, at most
DICT_BYTES = 112 * 1024
LEVEL = 3
END_ID = 0
CACHED_WORDS = 1_000_000  # known to a worker unless said otherwise, about 60 bytes each
CACHED_MARKS = 50_000
FILE_DOCS = 50_000  # documents of a file, about
INDEX = np.dtype([("doc", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("ids", "<u8")])
TRAILER = "<QQ32s8s"  # index offset, documents, hash of the dictionary, mark
MARK = b"TOKFILE1"
# White space other than single spaces and line feeds inside the text.
_ODD = r"[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
_MARKS = ".,%&*$#!?;:|"
GROUP_BYTES = 8_000_000  # texts encoded together


_BYTE_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a column's words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    out = sizes.astype(np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
            place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            out[some] += np.add.reduceat(_BYTE_VALUES[data] * powers[place], offsets[some] - offsets[0])
    return out


class Encoder:
    """Serialized ids of texts, put together from those of their words.

    A byte-level tokenizer never joins a single white space with the character before it, so a text whose white space is
    single spaces and line feeds may be cut before each of them; another text is encoded in one go. Words repeat, so most are
    looked up: known words lie in a column, their ids in one array. A worker keeps them for all its tasks, those used last.
    """

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        self.cached = cached
        self.tokenizer = Tokenizer.from_file(path)
        self.marks: dict[str, bytes] = {}
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        # Ids that begin with a space, and that of a line feed alone.
        self.spaced, self.breaks = np.zeros((2, max(vocabulary.values()) + 1), bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.breaks[vocabulary["\u010a"]] = True

    @classmethod
    def of(cls, path: str, cached: int) -> Encoder:
        if path not in cls.kept:
            cls.kept = {path: cls(path)}
        cls.kept[path].cached = cached
        return cls.kept[path]

    def alone(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of the column (no nulls)."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = texts.filter(pc.invert(odd))
        marked = pc.replace_substring(pc.binary_join_element_wise("\r", plain, ""), "\n", " \n \r")
        split = pc.split_pattern(marked, " ")
        words = split.flatten().dictionary_encode()
        places = self._places(words.dictionary)
        # The ids of every word in order, gathered from those of the distinct ones.
        codes = places[words.indices.to_numpy()]
        counts = self.sizes[codes].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[codes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        coded = iter([ids[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        return [self.alone(text.as_py()) if alone else next(coded) for text, alone in zip(texts, odd.to_pylist(), strict=True)]

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Drop all known words, or all but these places."""
        if keep is None or not len(keep):
            self.words, self.ids = pa.array([], pa.string()), np.empty(0, "<u4")
            self.starts, self.sizes, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
            self.hashes, self.places, self.turn = np.empty(0, np.uint64), np.empty(0, np.int32), 0
            return
        sizes = self.sizes[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.words, self.starts, self.sizes, self.used = self.words.take(pa.array(keep)), ends - sizes, self.sizes[keep], self.used[keep]
        hashes = word_hashes(self.words)
        self.places = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.places]

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words that were not known, and their ids one after the other."""
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.turn, np.int32)])
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, (len(self.words) - len(words) + order).astype(np.int32))

    def _find(self, words: pa.Array) -> np.ndarray:
        """Places of words among the known ones, -1 for unknown ones: looked up by hash and compared."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.hashes):
            return out
        hashes = word_hashes(words)
        at = np.searchsorted(self.hashes, hashes)
        left = np.arange(len(words))
        while len(left):
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == hashes[left]]
            found = self.places[at[left]]
            same = pc.equal(words.take(pa.array(left)), self.words.take(pa.array(found))).to_numpy(zero_copy_only=False)
            out[left[same]] = found[same]
            left = left[~same]  # another word of the same hash: look at the next one
            at[left] += 1
        return out

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones; unknown ones are learned."""
        if len(self.words) >= self.cached:
            # Those used latest stay, half of them at most.
            least = np.sort(self.used)[-(self.cached // 2)] if self.cached > 1 else self.turn
            self._forget(np.flatnonzero(self.used > least))
        self.turn += 1
        places = self._find(words)
        unknown = places < 0
        if unknown.any():
            new = words.filter(pa.array(unknown))
            self._learn(new)
            places[unknown] = self._find(new)
        self.used[places] = self.turn
        return places

    def _learn(self, new: pa.Array) -> None:
        """Ids of words as they follow a space and, marked by a carriage return, as they begin a line; of line feeds.

        A letter and a mark after it are always cut, so words share what is known of their letters, which is learned too.
        """
        stems = pc.utf8_rtrim(new, characters=_MARKS)
        lettered = pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, start=-1))
        other = new.filter(pc.invert(lettered)).to_pylist()
        alone = [b"" if word == "\r" else self.alone(word[1:] if word[:1] == "\r" else word if word == "\n" else " " + word) for word in other]
        self._add(pa.array(other, pa.string()), np.frombuffer(b"".join(alone), "<u4"), np.array([len(ids) // 4 for ids in alone], np.int64))

        distinct = pc.unique(stems.filter(lettered))
        lacking = distinct.filter(pa.array(self._find(distinct) < 0))
        begins_line = pc.starts_with(lacking, "\r")
        for some, line in ((lacking.filter(pc.invert(begins_line)), False), (lacking.filter(begins_line), True)):
            learned = [self._encoded(some.slice(begun, 500).to_pylist(), line) for begun in range(0, len(some), 500)]
            if learned:
                self._add(some, *(np.concatenate(part) for part in zip(*learned, strict=True)))

        marks = pc.subtract(pc.binary_length(new), pc.binary_length(stems))
        marked = pc.and_(lettered, pc.greater(marks, 0))
        words = new.filter(marked)
        if len(words):
            heads = self._find(stems.filter(marked))
            tails = pa.array([word[-n:] for word, n in zip(words.to_pylist(), marks.filter(marked).to_pylist(), strict=True)], pa.string()).dictionary_encode()
            kinds = [self._mark(tail) for tail in tails.dictionary.to_pylist()]
            lengths = np.array([len(ids) // 4 for ids in kinds], np.int64)
            codes, firsts, flat = tails.indices.to_numpy(), np.cumsum(lengths) - lengths, np.frombuffer(b"".join(kinds), "<u4")
            # Each word's ids are those of its letters and then of its marks.
            parts = np.stack([self.sizes[heads].astype(np.int64), lengths[codes]], axis=1).ravel()
            begins = np.stack([self.starts[heads], len(self.ids) + firsts[codes]], axis=1).ravel()
            ends = np.cumsum(parts)
            both = np.concatenate([self.ids, flat])
            self._add(words, both[np.repeat(begins - (ends - parts), parts) + np.arange(ends[-1])], parts.reshape(-1, 2).sum(axis=1))

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= CACHED_MARKS:
                self.marks.clear()
            self.marks[marks] = self.alone(marks)
        return self.marks[marks]

    def _encoded(self, stems: list[str], begin_line: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: encoded in one text, cut at the ids of their spaces; of words that begin a line at those of line feeds."""
        text = "\n" + "\n".join([stem[1:] for stem in stems]) if begin_line else " " + " ".join(stems)
        ids = self._ids(text)
        begins = (self.breaks if begin_line else self.spaced)[ids]
        heads = np.flatnonzero(begins)
        if len(heads) != len(stems):
            alone = [self.alone(stem[1:] if begin_line else " " + stem) for stem in stems]
            return np.frombuffer(b"".join(alone), "<u4"), np.array([len(ids) // 4 for ids in alone], np.int64)
        sizes = np.diff(np.append(heads, len(ids)))
        return (ids[~begins], sizes - 1) if begin_line else (ids, sizes)


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges (begin, size) of about GROUP_BYTES."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    begun = 0
    while begun < len(texts):
        before = ends[begun - 1] if begun else 0
        end = max(begun + 1, int(np.searchsorted(ends, before + GROUP_BYTES)))
        yield begun, end - begun
        begun = end


def _train(rows: DataFrame, path: str, end: bytes, cached: int) -> bytes:
    """A dictionary from the ids of about SAMPLE_DOCS documents picked by a hash (twice as many at most), up to SAMPLE_CHARS characters of each.

    Raw ids serve as the dictionary if there are too few to train one.
    """
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path, cached)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ids + end for ids in encode(batch.column(0))], pa.binary())], names=["ids"])

    share = max(1, rows.count() // SAMPLE_DOCS)
    draw = rows.withColumn("draw", F.xxhash64("doc", "text", F.lit("sample"))).where(F.pmod("draw", F.lit(share)) == 0)
    # Many equal rows have one draw, so the smallest draws are taken: the same sample in every run.
    sample = draw.orderBy("draw", "doc", "text").limit(2 * SAMPLE_DOCS).select(F.substr("text", F.lit(1), F.lit(SAMPLE_CHARS)).alias("text"))
    samples = sorted(bytes(row.ids) for row in sample.mapInArrow(ids, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES].ljust(8, b"\0")


def _file_writer(folder: str, path: str, end: bytes, cached: int, keep: bool, dictionary):
    """Writes a partition, sorted by number, as one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder.of(path, cached)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary.value))
        index: list[np.ndarray] = []

        def chunks():
            offset = 0
            for batch in batches:
                for begun, size in _groups(batch.column(1)):
                    docs, texts = batch.slice(begun, size).columns
                    rows = [ids + end for ids in encode(texts)]
                    frames = press.multi_compress_to_buffer(rows, threads=1)  # a frame a document
                    entries = np.empty(size, INDEX)
                    entries["doc"] = docs.to_numpy()
                    entries["length"] = [len(frames[i]) for i in range(size)]
                    entries["ids"] = [len(ids) // 4 for ids in rows]
                    entries["offset"] = offset + np.cumsum(entries["length"]) - entries["length"]
                    index.append(entries)
                    offset += int(entries["length"].sum())
                    for i in range(size):
                        yield frames[i].tobytes()
            rows = np.concatenate(index) if index else np.empty(0, INDEX)
            yield rows
            yield struct.pack(TRAILER, offset, len(rows), hashlib.sha256(dictionary.value).digest(), MARK)

        name = f"{folder}/ids-{TaskContext.get().partitionId():06d}.bin"
        put_file(name, chunks())
        if not keep:
            Encoder.kept.clear()
        if index:
            yield pa.RecordBatch.from_pydict({
                "file": [name], "first_doc": [int(index[0]["doc"][0])], "docs": [sum(map(len, index))], "ids": [sum(int(entries["ids"].sum()) for entries in index)]})

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, doc: str = "doc_id", text: str = "text", end: int = END_ID,
                      cached: int = CACHED_WORDS, keep: bool = True) -> DataFrame:
    """Write the ids of all texts as files in ``folder``, in ascending order of the document number.

    Returns the manifest, one row a file: ``file, first_doc, docs, ids, start`` (ids in the files before it), also written
    to ``folder/manifest``; the dictionary goes to ``folder/dictionary``. Null texts are empty, an empty text has only the
    end id. Rows repeated under one number stay apart, ordered by text; rows with a null number come first, as number
    -2**63. One shuffle deals the texts out by ranges of the number; the driver sees the manifest and the sample.
    Further columns of any name are left out; an empty table writes a manifest without rows; very long texts are encoded whole.
    ``cached`` bounds the words whose ids a worker holds; without ``keep`` it drops them after each task, for jobs with other work.
    """
    spark = docs.sparkSession
    tail = np.array([end], "<u4").tobytes()
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("pick", F.xxhash64("text"))
    dictionary = _train(rows, path, tail, cached)
    put_file(f"{folder}/dictionary", [dictionary])
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // FILE_DOCS)
    ordered = rows.repartitionByRange(files, "doc", "pick").sortWithinPartitions("doc", "pick", "text").select("doc", "text")
    listed = ordered.mapInArrow(releasing(_file_writer(f"{folder}/files", path, tail, cached, keep, spark.sparkContext.broadcast(dictionary))), "file string, first_doc long, docs long, ids long")
    start, manifest = 0, []
    for row in sorted(listed.collect(), key=lambda row: int(row.file.rsplit("-", 1)[1].removesuffix(".bin"))):
        manifest.append((row.file, row.first_doc, row.docs, row.ids, start))
        start += row.ids
    out = spark.createDataFrame(manifest, "file string, first_doc long, docs long, ids long, start long")
    out.coalesce(1).write.parquet(f"{folder}/manifest")
    return out


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str, dictionary: bytes):
        system, path = locate(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        offset, count, digest, mark = struct.unpack(TRAILER, self.source.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        if mark != MARK:
            raise ValueError(f"{uri} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.source.read_at(INDEX.itemsize * count, offset), INDEX)
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, row: int) -> bytes:
        """Serialized ids of the row-th document, read and decompressed alone."""
        entry = self.index[row]
        return self.press.decompress(self.source.read_at(int(entry["length"]), int(entry["offset"])))

    def all_ids(self, begun: int, end: int) -> list[memoryview]:
        """Serialized ids of consecutive documents, read at once; each frame is decompressed alone."""
        some = self.index[begun:end]
        first = int(some["offset"][0])
        data = memoryview(self.source.read_at(int(some["offset"][-1] + some["length"][-1]) - first, first))
        cuts = (some["offset"] - np.uint64(first)).tolist()
        frames = [data[at:at + size] for at, size in zip(cuts, some["length"].tolist(), strict=True)]
        out = self.press.multi_decompress_to_buffer(frames, decompressed_sizes=(4 * some["ids"]).astype("<u8").tobytes(), threads=1)
        return [memoryview(out[i]) for i in range(len(some))]

    def find(self, doc: int) -> list[bytes]:
        """Ids of the documents with this number."""
        low, high = np.searchsorted(self.index["doc"], [doc, doc], "left")[0], np.searchsorted(self.index["doc"], doc, "right")
        return [self.ids(row) for row in range(low, high)]


def read_dictionary(folder: str) -> bytes:
    system, path = locate(f"{folder}/dictionary")
    with system.open_input_stream(path) as source:
        return source.read()


def _file_reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_dictionary(folder)
        for batch in batches:
            for uri, start in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                source = TokenFile(uri, dictionary)
                counts = source.index["ids"].astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                # Documents of about READ_IDS ids are read together.
                cuts = np.flatnonzero(np.diff((starts - start) // READ_IDS, prepend=-1))
                for begun, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(counts)], strict=True):
                    found = source.all_ids(begun, end)
                    if [len(ids) for ids in found] != (4 * counts[begun:end]).tolist():
                        raise ValueError(f"{uri}: index and frames differ")
                    sums = [zlib.crc32(ids) for ids in found]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": source.index["doc"][begun:end].astype(np.int64), "start": starts[begun:end], "n_tokens": counts[begun:end],
                        "ids_crc32": np.array(sums, np.int64)})

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; a task for each file."""
    files = manifest.select("file", "start")
    return files.repartitionByRange(max(1, files.count()), "file").mapInArrow(_file_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, path: str, cached: int = CACHED_WORDS, keep: bool = True) -> DataFrame:
    """Write the documents' token files into a new shared folder and describe each document from them."""
    folder = new_folder(docs.sparkSession, "ids")
    return read_token_files(write_token_files(docs, path, folder, cached=cached, keep=keep), folder)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenized(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
