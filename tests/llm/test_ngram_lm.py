import math
from collections import Counter, defaultdict

import pytest

from faultlens.llm import ngram_lm
from faultlens.llm.ngram_lm import END, discounts, score_texts, train, words_of

TRAIN = ["the cat sat on the mat", "the dog sat on the mat the end", "A b c\td", "", None, "the the the the", "x", "x", "On THE mat we sat " * 40, "é é ü", "rare words here only once"] + [f"the w{i % 7} sat w{i % 11} on w{i % 3}" for i in range(60)]
TEST = ["the cat sat", "unseen words", None, "", "x the unseen mat", "The MAT", "w1 w2 w3 w4 on on on", "the " * 3000, "the cat sat"]


def brute(texts):
    single, pairs = Counter(), Counter()
    for text in texts:
        row = [b"<"] + words_of(text) + [END]
        single.update(row[1:])
        pairs.update(zip(row, row[1:]))
    ones = lambda counts: [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
    after = Counter(w for _, w in pairs)
    d2, d1 = discounts(ones(pairs)), discounts(ones(after))
    total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), n in pairs.items():
        total[v] += n
        kinds[v][min(n, 3) - 1] += 1
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0
    rest = sum(cut(n, d1) for n in after.values()) / len(pairs)
    alone = lambda w: (after[w] - cut(after[w], d1)) / len(pairs) + rest / (len(single) + 1)

    def chance(v, w):
        if not total[v]:
            return alone(w)
        n = pairs[v, w]
        return (n - cut(n, d2)) / total[v] + sum(map(lambda a, b: a * b, d2, kinds[v])) / total[v] * alone(w)

    return single, chance


@pytest.mark.parametrize("limit", [400_000, 3])
def test_against_brute_force(spark, docs_of, monkeypatch, limit):
    for name in ("FLUSH_WORDS", "FLUSH_PAIRS", "CACHED_WORDS"):
        monkeypatch.setattr(ngram_lm, name, limit)
    model = train(docs_of(list(enumerate(TRAIN))))
    single, chance = brute(TRAIN)
    n, v = sum(single.values()), len(single)
    assert (model.n_tokens, model.n_words) == (n, v)
    assert math.isclose(sum(chance(b"the", w) for w in single) + chance(b"the", b"never seen"), 1)
    got = score_texts(docs_of(list(enumerate(TEST))), model).orderBy("doc_id").collect()
    for row, text in zip(got, TEST, strict=True):
        words = words_of(text) + [END]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(words), sum(w in single for w in words), n)
        assert math.isclose(row.base_score, sum(math.log10((single[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(row.score, sum(math.log10(chance(a, b)) for a, b in zip([b"<", *words], words)), rel_tol=1e-9)
        assert math.isclose(row.perplexity, 10 ** (-row.score / len(words)), rel_tol=1e-9)


def test_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    none = train(docs.limit(0))
    assert [r.score for r in score_texts(docs, none).collect()] == [0.0, 0.0]  # one unknown token is all there is
    assert score_texts(docs.limit(0), train(docs)).collect() == []
