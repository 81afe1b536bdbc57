"""Audit of how the sources of a language differ in their words.

Tasks cut lower-cased texts into words at the bytes that are no letters, count them and hand on partial counts as shards, each some words of a
language in columns, one row a shard; a shuffle brings a shard's parts together, which are merged, and words in too few documents go. A shard
computes what its words add to the divergence of each two sources that share them and the words by which each source stands out. What words add
that only one or neither of two sources has depends on counts alone, and so comes from the histogram of each source's counts. All
arithmetic is whole-number and exact.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.llm.ngram_lm import mixed
from faultlens.llm.registry import query, table
from faultlens.llm.shared import releasing, written
from faultlens.llm.token_files import word_hashes

LEAST_DOCUMENTS = 3
TERMS = 200
UNIT = 1_000_000_000
HELD_ROWS = 1_000_000  # partial counts of a task before they are handed on
TASK_ROWS = 400_000  # different counts of a task, about
SHARD_ROWS = 200_000  # counts of a shard, about
SHARDS = 16, 2048  # of a language: at least, at most, as each task writes a row for each
PAIR_ROWS = 1_000_000  # pairs of counts looked at together
BROADCAST_GROUPS = 20_000  # rows of groups of about 100 bytes; more are shuffled
SALTS = 32

_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
_SHARDS = "lang string, shard int, sources array<string>, counts binary"
_MERGED = "lang string, shard int, part string, source string, n long, terms long, sources array<string>, counts binary"
_PARTS = "lang string, source string, part string, item string, value long"
#: A shard's counts: a row for each term (null: the group itself), with the places of its sources among the shard's.
_COLUMNS = pa.schema([("term", pa.string()), ("source", pa.list_(pa.int32())), ("count", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


def _words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each word, and all words in order."""
    text = pc.fill_null(text, "").cast(pa.string())
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    letters = _LETTERS[data]
    real = letters != 0
    # A word begins after a byte that is none of its letters or with a text, and ends before one or with a text.
    edge = bounds[(bounds > 0) & (bounds < len(real))]
    begins, ends = real.copy(), real.copy()
    begins[1:] &= ~real[:-1]
    ends[:-1] &= ~real[1:]
    begins[edge], ends[edge - 1] = real[edge], real[edge - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    row = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(starts, bounds)))
    return row, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[real]))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each key of a sorted array stands first."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, firsts) if len(firsts) else np.empty(0, np.int64)


def _counted(lang: pa.Array, source: pa.Array, term: pa.Array, count: np.ndarray, docs: np.ndarray) -> pa.Table:
    return pa.table({"lang": lang, "source": source, "term": term, "count": pa.array(count, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _batch_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of each term in each group of the batch; a null term for the group itself."""
    lang, source = (pc.fill_null(column, "").cast(pa.string()).dictionary_encode() for column in (lang, source))
    width = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    row, words = _words(text)
    words = words.dictionary_encode()
    # Sorted by group, word and row at once.
    present, number = np.unique(group, return_inverse=True)
    keys = (number[row] * len(words.dictionary) + words.indices.to_numpy()) * len(group) + row
    keys.sort()
    by_row = _firsts(keys)
    by_word = _firsts(keys[by_row] // max(1, len(group)))
    first = by_row[by_word]
    number, word = np.divmod(keys[first] // max(1, len(group)), max(1, len(words.dictionary)))
    count, docs = np.diff(np.append(first, len(keys))), np.diff(np.append(by_word, len(by_row)))
    group, nothing = np.concatenate([present[number], present]), np.zeros(len(present), np.int64)
    of = lambda column, index: pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), column.dictionary)
    term = pa.DictionaryArray.from_arrays(pa.concat_arrays([pa.array(word.astype(np.int32)), pa.nulls(len(present), pa.int32())]), words.dictionary)
    return _counted(of(lang, group // width), of(source, group % width), term, np.concatenate([count, nothing]), np.concatenate([docs, nothing]))


def _places(column: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """Dictionary of a column, and the places of the values in it; -1 for null."""
    return column.dictionary, pc.fill_null(column.indices, -1).to_numpy().astype(np.int64)


def _merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    whole = pa.concat_tables(tables).unify_dictionaries().combine_chunks().to_batches()[0]
    (langs, lang), (sources, source), (terms, term) = (_places(whole[c]) for c in ("lang", "source", "term"))
    keys = (lang * len(sources) + source) * (len(terms) + 1) + term + 1
    order = np.argsort(keys)
    first = _firsts(keys[order])
    at = order[first]
    of = lambda values, index: pa.DictionaryArray.from_arrays(pa.array(index[at].astype(np.int32), mask=index[at] < 0), values)
    return _counted(of(langs, lang), of(sources, source), of(terms, term), *(_sums(whole[c].to_numpy()[order], first) for c in ("count", "docs")))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: merged as they come, handed on when merging leaves too many."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_batch_counts(*batch.columns))
        rows += held[-1].num_rows
        if rows > HELD_ROWS:
            held = [_merged(held)]
            rows = held[0].num_rows
            if rows > HELD_ROWS // 2:
                yield from held[0].combine_chunks().to_batches()
                held, rows = [], 0
    if held:
        yield from _merged(held).combine_chunks().to_batches()


def _packed(terms: pa.Array, term: np.ndarray, source: np.ndarray, count: np.ndarray, docs: np.ndarray, names: pa.Array, ends: np.ndarray) -> Iterator[tuple[pa.Array, bytes]]:
    """Names of the sources and counts in columns of each piece of rows that are sorted by term (-1: null) within pieces, which end at ``ends``."""
    firsts = _firsts(term)
    firsts = np.union1d(firsts, ends[:-1]) if len(term) else firsts
    source = source.copy()
    used, begin = [], 0
    for end in ends:
        present = np.zeros(len(names), bool)
        present[source[begin:end]] = True
        used.append(np.flatnonzero(present))
        source[begin:end] = (np.cumsum(present) - 1)[source[begin:end]]
        begin = end
    offsets = pa.array(np.append(firsts, len(term)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in ((source.astype(np.int32), pa.int32()), (count, pa.int64()), (docs, pa.int64()))]
    batch = pa.RecordBatch.from_arrays([terms.take(pa.array(term[firsts], mask=term[firsts] < 0)), *lists], schema=_COLUMNS)
    begin = 0
    for own, end in zip(used, np.searchsorted(firsts, ends).tolist(), strict=True):
        yield names.take(pa.array(own)), batch.slice(begin, end - begin).serialize().to_pybytes()
        begin = end


def _unpacked(sources: list[list[str]], counts: list[bytes]) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, terms, and a row for each count: places of term (-1: null) and source, count, documents."""
    names: dict[str, int] = {}
    parts = []
    for own, data in zip(sources, counts, strict=True):
        place = np.array([names.setdefault(name, len(names)) for name in own], np.int64)
        batch = pa.ipc.read_record_batch(pa.py_buffer(data), _COLUMNS)
        sizes = np.diff(batch.column("source").offsets.to_numpy())
        values = [batch.column(c).flatten().to_numpy() for c in ("source", "count", "docs")]
        parts.append((batch.column("term"), sizes, place[values[0]], *values[1:]))
    terms = pa.chunked_array([p[0] for p in parts], pa.string()).combine_chunks().dictionary_encode()
    terms = terms.chunk(0) if isinstance(terms, pa.ChunkedArray) else terms
    sizes, source, count, docs = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
    return list(names), terms.dictionary, np.repeat(pc.fill_null(terms.indices, -1).to_numpy().astype(np.int64), sizes), source, count, docs


def _sharder(shards: int):
    """Partial counts of a task as rows ``lang, shard, sources, counts``; a language's shards are numbered by a hash of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counter(batches):
            (langs, lang), (names, source), (terms, term) = (_places(batch.column(c)) for c in ("lang", "source", "term"))
            shard = np.append(mixed(word_hashes(terms)) % np.uint64(shards), np.uint64(0)).astype(np.int64)[term]  # a null term's is 0
            order = np.lexsort((term, shard, lang))
            keys = (lang * shards + shard)[order]
            first = _firsts(keys)
            count, docs = (batch.column(c).to_numpy()[order] for c in ("count", "docs"))
            packed = list(_packed(terms, term[order], source[order], count, docs, names, np.append(first[1:], len(keys))))
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(keys[first] // shards)), pa.array((keys[first] % shards).astype(np.int32)),
                pa.array([own.to_pylist() for own, _ in packed], pa.list_(pa.string())), pa.array([data for _, data in packed], pa.binary())],
                ["lang", "shard", "sources", "counts"])

    return run


def _merger(least: int):
    """A shard's counts of terms in at least ``least`` documents, and what adds up over shards.

    ``shard`` rows hold the counts, ``source`` rows a source's occurrences and terms, ``lang`` rows the language's, ``many`` rows how many terms a source has ``n`` times.
    """

    def run(parts: pa.Table) -> pa.Table:
        lang, shard = parts.column("lang")[0].as_py(), parts.column("shard")[0].as_py()
        names, terms, term, source, count, docs = _unpacked(parts.column("sources").to_pylist(), parts.column("counts").to_pylist())
        keys = (term + 1) * len(names) + source
        order = np.argsort(keys)
        first = _firsts(keys[order])
        term, source, count, docs = term[order][first], source[order][first], _sums(count[order], first), _sums(docs[order], first)
        first = _firsts(term)
        frequent = np.repeat((_sums(docs, first) >= least) & (term[first] >= 0), np.diff(np.append(first, len(term))))
        term, source, count, docs = term[frequent], source[frequent], count[frequent], docs[frequent]
        n = np.zeros(len(names), np.int64)
        np.add.at(n, source, count)
        rows = [("source", names, n, np.bincount(source, minlength=len(names)), None), ("lang", [""], [count.sum()], [len(_firsts(term))], None)]
        order = np.lexsort((count, source))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(source[order]) != 0) | (np.diff(count[order]) != 0)])) if len(order) else np.empty(0, np.int64)
        rows.append(("many", [names[i] for i in source[order][first].tolist()], count[order][first], np.diff(np.append(first, len(order))), None))
        if len(term):
            rows.append(("shard", [""], [0], [0], list(_packed(terms, term, source, count, docs, pa.array(names, pa.string()), np.array([len(term)])))))
        return pa.concat_tables([pa.table({
            "lang": pa.array([lang] * len(own), pa.string()), "shard": pa.array([shard] * len(own), pa.int32()), "part": pa.array([part] * len(own), pa.string()),
            "source": pa.array(own, pa.string()), "n": pa.array(n, pa.int64()), "terms": pa.array(many, pa.int64()),
            "sources": pa.array([x.to_pylist() for x, _ in packed] if packed else [None] * len(own), pa.list_(pa.string())),
            "counts": pa.array([x for _, x in packed] if packed else [None] * len(own), pa.binary())}) for part, own, n, many, packed in rows])

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact while total is below 2**53; three digits at a time."""
    rest, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def _share(count: Column, total: Column) -> Column:
    """The same in an expression; null where the total is 0."""
    whole = F.nullif(total, F.lit(0).cast("long"))
    rest, out = count + F.lit(1).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * F.lit(1000).cast("long")
        out = out * F.lit(1000).cast("long") + F.call_function("div", scaled, whole)
        rest = scaled % whole
    return out + F.lit(1).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // q


def _shard(terms: int):
    """Parts of divergences and standing-out terms of a shard, from its counts and rows ``source, total, all_total`` of its sources.

    ``pair`` rows hold, for two sources that share terms, what these add beyond what the histograms say; ``term`` rows the shard's best terms.
    """

    def run(shard: pa.Table, sizes: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
        lang = shard.column("lang")[0].as_py()
        names, items, term, source, count, _ = _unpacked(shard.column("sources").to_pylist(), shard.column("counts").to_pylist())
        place = pc.index_in(pa.array(names, pa.string()), sizes.column("source").combine_chunks()).to_numpy()
        total, all_total = (sizes.column(c).to_numpy()[place][source] for c in ("total", "all_total"))
        first = _firsts(term)
        all_count = np.repeat(_sums(count, first), np.diff(np.append(first, len(term))))
        p, none = shares(count, total), shares(np.zeros(len(count), np.int64), total)
        out = []

        # Terms more frequent in the group than in the language, the best of each source.
        q = shares(all_count, all_total)
        value, above = _gaps(p, q), p > q
        place = np.empty(len(items), np.int64)
        place[pc.array_sort_indices(items.cast(pa.binary())).to_numpy()] = np.arange(len(items))
        order = np.lexsort((place[term], -value, source))
        order = order[above[order]]
        first = np.searchsorted(source[order], source[order], "left")
        order = order[np.arange(len(order)) - first < terms]
        known = pa.array(names, pa.string())
        out.append(("term", source[order], items.take(pa.array(term[order])), value[order]))

        # Each two sources of each shared term, in pieces of bounded size.
        begins = np.searchsorted(term, term, "left")
        sizes = np.searchsorted(term, term, "right") - begins
        ends = np.cumsum(sizes)
        dense = len(names) ** 2 <= PAIR_ROWS
        sums = np.arange(len(names) ** 2 if dense else 0), np.zeros(len(names) ** 2 if dense else 0, np.int64)
        seen = np.zeros(len(sums[0]), bool)
        begun = 0
        while begun < len(term):
            before = ends[begun - 1] if begun else 0
            end = max(begun + 1, int(np.searchsorted(ends, before + PAIR_ROWS, "right")))
            own = slice(begun, end)
            left = np.repeat(np.arange(begun, end), sizes[own])
            right = np.repeat(begins[own] - (ends[own] - sizes[own]) + before, sizes[own]) + np.arange(len(left))
            left, right = left[left != right], right[left != right]
            more = _gaps(p[left], p[right]) - _gaps(p[left], none[right]) - _gaps(none[left], p[right]) + _gaps(none[left], none[right])
            keys = source[left] * len(names) + source[right]
            if dense:
                np.add.at(sums[1], keys, more)
                seen[keys] = True
            else:
                keys, more = np.concatenate([sums[0], keys]), np.concatenate([sums[1], more])
                order = np.argsort(keys)
                first = _firsts(keys[order])
                sums = keys[order][first], _sums(more[order], first)
            begun = end
        sums = (sums[0][seen], sums[1][seen]) if dense else sums
        out.append(("pair", sums[0] // max(1, len(names)), known.take(pa.array(sums[0] % max(1, len(names)))), sums[1]))
        tables = [pa.table({
            "lang": pa.array([lang] * len(value), pa.string()), "source": known.take(pa.array(group)), "part": pa.array([part] * len(value), pa.string()),
            "item": item.cast(pa.string()), "value": pa.array(value, pa.int64())}) for part, group, item, value in out]
        return pa.concat_tables(tables)

    return run


def _beside(left: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """``left`` (with ``lang, source``) beside every other group of its language."""
    if few:
        return left.join(F.broadcast(groups), "lang").where("source <> other")
    # Rows of a language are dealt out over salts, its groups are repeated for each.
    salted = left.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    return salted.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "salt"]).where("source <> other").drop("salt")


def source_divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the others and from the language.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language keeps those in at least ``least`` of its documents (rows:
    a repeated row counts again). Part ``pair``: the divergence from each other source, all ranks; part ``term``: the ``terms`` terms by which
    a group stands out of its language. Ties go to the smaller item in UTF-8. Null text, lang and source are empty strings; a group without
    kept terms has its pairs (value 0 where the language keeps none); a very long text is counted whole; further columns of any name are
    left out; an empty table gives no rows. A sum beyond 64 bits is an error.
    """
    rows = docs.select(*[F.col(c).cast("string").alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    shards = max(SHARDS[0], min(SHARDS[1], rows.rdd.getNumPartitions() * TASK_ROWS // SHARD_ROWS))
    partial = rows.mapInArrow(releasing(_sharder(shards)), _SHARDS)
    merged = written(partial.groupBy("lang", "shard").applyInArrow(_merger(least), _MERGED), "counts")

    sizes = merged.where("part = 'source'").groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("terms").alias("present"))
    terms_of = merged.where("part = 'lang'").groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("n").alias("all_n"))
    zero = F.lit(0).cast("long")
    groups = written(
        sizes.join(terms_of, "lang")
        .select("*", (F.col("n") + F.col("v")).alias("total"), (F.col("all_n") + F.col("v")).alias("all_total"), _share(zero, F.col("n") + F.col("v")).alias("none")), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    some = F.broadcast(groups) if few else groups
    kept = merged.where("part = 'shard'").select("lang", "shard", "sources", "counts")
    totals = kept.select("lang", F.col("shard").alias("of"), F.explode("sources").alias("source")).join(some.select("lang", "source", "total", "all_total"), ["lang", "source"])
    totals = totals.select(F.col("lang").alias("its"), "of", "source", "total", "all_total")
    found = written(kept.groupBy("lang", "shard").cogroup(totals.groupBy("its", "of")).applyInArrow(_shard(terms), _PARTS), "parts")

    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.col("present").alias("other_present"))
    base = _beside(groups.select("lang", "source", "v", "none", "present"), others, few).select(
        "lang", "source", F.col("other").alias("item"),
        F.coalesce((F.col("v") - F.col("present") - F.col("other_present")) * _gap(F.col("none"), F.col("other_none")), zero).alias("value"))
    histogram = (
        merged.where("part = 'many'").groupBy("lang", "source", F.col("n").alias("count")).agg(F.sum("terms").alias("terms"))
        .join(some.select("lang", "source", "total"), ["lang", "source"]).select("lang", "source", "terms", _share(F.col("count"), F.col("total")).alias("p")))
    alone = _beside(histogram, others.drop("other_present"), few).groupBy("lang", "source", "other").agg(
        F.sum(F.col("terms") * _gap(F.col("p"), F.col("other_none"))).alias("own"), F.sum(F.col("terms") * _gap(F.col("other_none"), F.col("p"))).alias("its"))
    pairs = (
        base.unionByName(alone.select("lang", "source", F.col("other").alias("item"), F.col("own").alias("value")))
        .unionByName(alone.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("its").alias("value")))
        .unionByName(found.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(order).cast("int").alias("rank")
    best = found.where("part = 'term'").select("lang", "source", "part", "item", "value", place).where(F.col("rank") <= terms)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place).unionByName(best)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_count FROM words GROUP BY ALL HAVING count(DISTINCT i) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(all_count) AS all_n FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL) s USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    CAST(1 + (1000000000 * CAST(coalesce(c, 0) + 1 AS HUGEINT)) // (n + v) AS HUGEINT) AS p,
    CAST(1 + (1000000000 * CAST(all_count + 1 AS HUGEINT)) // (all_n + v) AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN counted o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergences(table(spark, folder, "documents").select("lang", "source", "text"))
