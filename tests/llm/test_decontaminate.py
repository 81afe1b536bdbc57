import hashlib
import random
import re

from faultlens.llm import decontaminate
from faultlens.llm.decontaminate import decontaminated, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        size = min(10, len(x))
        windows = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)} if x else set()
        for p in range(len(w) - size + 1 if x else 0):
            if tuple(w[p:p + size]) in windows:
                hit.update(range(p, p + size))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def sample():
    rng = random.Random(5)
    vocab = ["a", "b", "C", "é", "x1", "Word", "the"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14]))) for i in range(12)] + [(40, None), (41, "!!"), (41, "zz top"), (None, "zz")]
    items = [x for x in items if len(words(x[1])) != 1 or x[0] is None] + [(99, text(30))]
    docs = [(i, text(rng.choice([0, 3, 12, 40]))) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 300 + items[-1][1] + " " + items[-1][1][:40]), (102, "zz;top"), (103, text(4000))]
    return items, docs


def test_against_brute_force(spark, docs_of, monkeypatch):
    items, docs = sample()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for chars in (16_000_000, 60):  # one block and many
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in find_contamination(docs_of(docs), benchmark).collect())
        assert got == sorted((i, *brute(t, items)) for i, t in docs)


def test_longest_match_and_empty_tables(spark, docs_of):
    benchmark = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(25)))], "item_id long, text string")
    docs = docs_of([(1, "q " + " ".join(f"W{i}" for i in range(3, 20)) + " q"), (2, "nothing")])
    [m] = find_contamination(docs, benchmark).where("doc_id = 1").collect()[0].matches
    assert (m.item_id, m.item_start, m.doc_start, m.n_words) == ("7", 3, 1, 17)
    kept = decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert find_contamination(docs.limit(0), benchmark).collect() == []
    assert {r.n_hit for r in find_contamination(docs, benchmark.limit(0)).collect()} == {0}
