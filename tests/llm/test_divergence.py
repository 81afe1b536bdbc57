import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from faultlens.llm import divergence
from faultlens.llm.divergence import _counter, shares, source_divergences

FIELDS = "doc_id long, text string, lang string, source string, term string, count long, value string, item string, other string, docs int"


def brute(rows, least=3, terms=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for _, _, words in own for w in set(words))
        kept = sorted((w for w, n in seen.items() if n >= least), key=lambda w: w.encode())
        groups = {source: Counter(w for _, s, words in own if s == source for w in words) for source in {d[1] for d in own}}
        whole = Counter(w for _, _, words in own for w in words)

        def share(counts):
            total = sum(counts[w] for w in kept) + len(kept)
            return {w: 1 + 1_000_000_000 * (counts[w] + 1) // total for w in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for source in groups:
            parts = {"pair": [(s, sum((p[source][w] - p[s][w]) ** 2 // p[s][w] for w in kept)) for s in groups if s != source],
                     "term": [(w, (p[source][w] - q[w]) ** 2 // q[w]) for w in kept if groups[source][w] and p[source][w] > q[w]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items, 1) if part == "pair" or rank <= terms]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, source, "x", 1, "v", "i", "o", 2) for i, (lang, source, text) in enumerate(rows)], FIELDS)


def result(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def sample():
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["ÄÖ", "é", "日本語", "Straße", "İx", "\u0085nel"]
    rows = []
    for _ in range(160):
        # One source holds a third of all rows; some words are in every text.
        source = rng.choice(["hot", "hot", "a", "b", None, ""])
        rows.append((rng.choice(["en", "en", "de"]), source, " ".join(["the"] + [rng.choice(words[:rng.randint(5, len(words))]) for _ in range(rng.randint(0, 30))]).title()))
    rows += [rows[0]] * 4  # repeated rows
    rows += [("en", "silent", None), ("en", "quiet", ""), ("en", "signs", "123 ,.;[]{}~\x00\x7f"), (None, "n", "one two"), (None, "m", "three\x00four"), ("xx", "alone", "solo")]
    rows.append(("de", "a", "Wort,ähnlich;" * 20_000))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "SHARD_ROWS", 40)
        monkeypatch.setattr(divergence, "PAIR_ROWS", 7)
        monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = sample()
    assert result(source_divergences(frame(spark, rows).repartition(5), terms=9)) == brute(rows, terms=9)


def test_no_kept_terms_and_empty_table(spark):
    rows = [("en", "a", "one two"), ("en", "b", "two three"), ("fr", "c", None)]
    got = result(source_divergences(frame(spark, rows)))
    assert got == brute(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_divergences(frame(spark, rows).limit(0)).collect() == []


def test_partial_counts_are_handed_on(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    rows = sample()
    batches = [pa.RecordBatch.from_pydict({name: pa.array([row[i] for row in rows[at:at + 20]], pa.string()) for i, name in enumerate(("lang", "source", "text"))}) for at in range(0, len(rows), 20)]
    out = list(_counter(iter(batches)))
    assert len(out) > 2
    total = Counter()
    for batch in out:
        for row in batch.to_pylist():
            total[row["lang"], row["term"]] += row["count"]
    assert total["de", "wort"] == 20_000 and total["", "four"] == 1


def test_shares_are_exact():
    rng = random.Random(1)
    count = [rng.randrange(1 << 50) for _ in range(200)]
    total = [c + 1 + rng.randrange(1 << 52) for c in count]
    got = shares(np.array(count, np.int64), np.array(total, np.int64))
    assert got.tolist() == [1 + 1_000_000_000 * (c + 1) // t for c, t in zip(count, total, strict=True)]


def test_words_are_cut_at_bytes_that_are_no_letters():
    texts = ["", None, "Ab", "c-D", " e ", "É日本x9y", "\x00", "Ünï", "zz", "", "A" * 5000 + "1b"]
    for piece in (texts, texts[2:4], ["", None], []):
        row, words = divergence._words(pa.array(texts + piece, pa.string()).slice(len(texts)))  # a slice of a longer column
        want = [(i, w) for i, t in enumerate(piece) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        assert list(zip(row.tolist(), words.to_pylist())) == want


def test_a_task_hands_on_a_row_for_each_shard_not_for_each_term():
    rows = [("en" if i % 3 else "de", f"s{i % 4}", " ".join(f"w{chr(97 + j % 26)}{'xyz'[j % 3] * (j % 40)}" for j in range(i, i + 300))) for i in range(200)] + [("fr", "none", None)]
    batches = [pa.RecordBatch.from_pydict({name: pa.array([row[i] for row in rows[at:at + 20]], pa.string()) for i, name in enumerate(("lang", "source", "text"))}) for at in range(0, len(rows), 20)]
    out = [row for batch in divergence._sharder(8)(iter(batches)) for row in batch.to_pylist()]
    assert len(out) == len({(row["lang"], row["shard"]) for row in out}) <= 3 * 8
    want, got = Counter(), Counter()
    for lang, source, text in rows:
        want.update((lang, source, word) for word in re.findall("[a-z]+", text or ""))
    for row in out:
        names, terms, term, source, count, docs = divergence._unpacked([row["sources"]], [row["counts"]])
        for t, s, c, d in zip(term.tolist(), source.tolist(), count.tolist(), docs.tolist(), strict=True):
            assert d <= c and (t >= 0 or c == 0)
            if t >= 0:
                got[row["lang"], names[s], terms[t].as_py()] += c
    assert got == want
    assert ("fr", 0, ["none"]) in [(row["lang"], row["shard"], row["sources"]) for row in out]
