import random
import re

import pytest

from faultlens.llm import jaccard
from faultlens.llm.components import contract
from faultlens.llm.jaccard import Bands, link_components, most_apart


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    width = min(size, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(docs, percent, size):
    sets = [shingles(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def sample(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(rng.choice([4, 11, 12, 30, 120, 400]))]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4, len(words) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = copy  # chains: links that no common original has
            docs.append(" ".join(copy))
    docs += ["", None, " \n", "one", "ONE", "one two", "one two", "one  two", "a b c", "a b c a b c", "a b c d", "long " + " ".join(rng.choice(vocab) for _ in range(6000))]
    docs.append(docs[-1] + " more")
    rng.shuffle(docs)
    return [(i * 7 % 1000, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed, percent, size, chunk", [(1, 90, 3, 1024), (2, 90, 3, 3), (3, 80, 5, 1024), (4, 55, 2, 4)])
def test_against_brute_force(spark, docs_of, monkeypatch, seed, percent, size, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    docs = sample(seed)
    got = sorted(tuple(r) for r in link_components(docs_of(docs), percent=percent, size=size).collect())
    assert got == brute(docs, percent, size)


def test_bands_cover_every_pair():
    for percent in (55, 80, 90, 95):
        bands = Bands(percent)
        for small in range(1, 400):
            for large in range(small, small * 100 // percent + 1):
                a, b = bands.of(small), bands.of(large)
                assert b - a <= 1
                # A part of the shared band holds one differing element at most.
                assert most_apart(small + large, percent) < 2 * bands.parts(b)


def test_numbers_repeat_and_empty_tables(spark, docs_of):
    docs = docs_of([(5, "same text here now"), (5, "same text here now"), (3, "same text here now"), (3, "other"), (9, None), (9, "")])
    assert sorted(tuple(r) for r in link_components(docs).collect()) == [(3, 1, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9), (9, 0, 9)]
    assert link_components(docs.limit(0)).collect() == []


def test_long_chain_of_links(spark):
    labels = spark.range(200).selectExpr("id AS node", "id AS comp")
    order = random.Random(1).sample(range(200), 200)
    links = spark.createDataFrame([(a, b) for a, b in zip(order[:150], order[1:151])], "a long, b long")
    got = {r.node: r.comp for r in contract(labels, links).collect()}
    assert {got[n] for n in order[:151]} == {min(order[:151])} and all(got[n] == n for n in order[151:])
