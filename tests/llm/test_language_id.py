import random

import pytest

from faultlens.llm import language_id
from faultlens.llm.language_id import held_out, predict, train, words_of
from faultlens.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("words, cached", [(300_000, 500_000), (3, 2)])
def test_odd_texts(spark, monkeypatch, words, cached):
    monkeypatch.setattr(language_id, "MAX_WORDS", words)
    monkeypatch.setattr(language_id, "CACHED_WORDS", cached)
    schema = "doc_id long, text string, lang string, lang_pred int"
    learn = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "der Hund und die Katze", "de", 1), (3, None, "fr", 1), (4, "", "es", 1), (5, "x y z", None, 1)], schema)
    model = train(learn)
    assert model.langs == ["de", "en"]
    texts = [None, "", "123 %%% --", "the dog", "DER HUND", "thedog", "日本語", "the " * 50_000, "the", "the"]
    got = predict(spark.createDataFrame([(i, t, None, 9) for i, t in enumerate(texts)], schema), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][:6] == ["und", "und", "und", "en", "de", "en"]
    assert got[6].lang_pred in ("de", "en") and got[7].lang_pred == "en" and got[8] == got[8] and got[8].score == got[9].score
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0
    empty = train(learn.limit(0))
    assert {r.lang_pred for r in predict(learn, empty).collect()} == {"und"}
    assert predict(learn.limit(0), model).collect() == []


def test_counts_have_no_cap(spark):
    """Words met once stay, however many more frequent ones there are."""
    letters = "abcdefghijklmnopqrst"
    common = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:13]]
    schema = "doc_id long, text string, lang string"
    rows = [(i, " ".join(common[i::25] * 3), lang) for i in range(25) for lang in ("en", "xx")] + [(98, "abca " * 50, "en"), (99, "abct", "xx")]
    model = train(spark.createDataFrame(rows, schema))
    got = predict(spark.createDataFrame([(1, "abct", None), (2, "abca", None)], schema), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["xx", "en"]


def test_fold(spark):
    assert [r.h for r in spark.createDataFrame([(0,), (None,)], "doc_id long").select(held_out().alias("h")).collect()] == [False, False]


def test_number_signs_are_no_letters(spark):
    assert [words_of(t) for t in ("½", "² Ⅷ ①", "x²y A½", "٠١", "_1_", "日本")] == [[], [], ["x", "y", "a"], [], [], ["日本"]]
    schema = "doc_id long, text string, lang string"
    model = train(spark.createDataFrame([(1, "hello there you", "en"), (2, "guten tag dir", "de")], schema))
    got = predict(spark.createDataFrame([(1, "½", None), (2, "Ⅷ ²", None), (3, "guten²", None)], schema), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "de"]


def brute(rows, texts):
    """Word-first backoff, word by word in plain dictionaries."""
    import math
    from collections import Counter

    langs = sorted({lang for _, lang in rows if lang is not None and any(words_of(t) for t, x in rows if x == lang)})
    tables = [{lang: Counter() for lang in langs} for _ in range(5)]
    for text, lang in rows:
        for word in words_of(text) if lang in langs else ():
            tables[0][lang][word] += 1
            for n in (1, 2, 3, 4):
                marked = f"\x02{word}\x03"
                tables[n][lang].update(word if n == 1 else [marked[i:i + n] for i in range(len(marked) - n + 1)])
    distinct = [len(set().union(*table.values())) for table in tables]
    size = lambda n, lang: math.log(sum(tables[n][lang].values()) + language_id.SMOOTHING * (distinct[n] + 1))
    part = lambda n, lang, item: math.log(tables[n][lang][item] + language_id.SMOOTHING) - size(n, lang)

    def of_word(word):
        if any(tables[0][lang][word] for lang in langs):
            return [part(0, lang, word) for lang in langs]
        for n in (4, 3, 2, 1):
            marked = f"\x02{word}\x03"
            grams = [g for g in (list(word) if n == 1 else [marked[i:i + n] for i in range(len(marked) - n + 1)]) if any(tables[n][lang][g] for lang in langs)]
            if grams:
                return [sum(part(n, lang, g) for g in grams) / len(grams) for lang in langs]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        words = words_of(text)
        if not words:
            out.append(("und", 0.0))
            continue
        total = [sum(x) for x in zip(*map(of_word, words))]
        if not any(total):
            prior = [sum(tables[0][lang].values()) for lang in langs]
            out.append((langs[prior.index(max(prior))], max(prior) / sum(prior)))
            continue
        weight = [math.exp(t - max(total)) for t in total]
        out.append((langs[weight.index(1.0)], 1.0 / sum(weight)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(12)
    sounds = {"aa": "abcdé", "bb": "cdefg", "cc": "ghiñ"}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 6)))
    known = {lang: [word(lang) for _ in range(30)] for lang in sounds}
    text = lambda lang: " ".join(rng.choice(known[lang]) if rng.random() < 0.6 else word(lang) for _ in range(rng.randint(0, 9)))
    # One language holds most rows; two texts repeat.
    rows = [(text(lang), lang) for lang in ["aa"] * 60 + ["bb"] * 15 + ["cc"] * 5] + [(None, "aa"), ("", "bb"), ("x1y ½", None), ("12", "dd")]
    rows += rows[:2]
    texts = [text(lang) for lang in sounds for _ in range(25)] + ["zzz", "a", "é ñ", None, "½", " ".join(known["bb"] * 300), "Abc ABC abc"]
    schema = "doc_id long, text string, lang string"
    model = train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], schema).repartition(4))
    got = predict(spark.createDataFrame([(i, t, "bb") for i, t in enumerate(texts)], schema).repartition(3), model).orderBy("doc_id").collect()
    want = brute(rows, texts)
    assert [r.lang_pred for r in got] == [lang for lang, _ in want]
    assert all(abs(r.score - score) < 1e-4 for r, (_, score) in zip(got, want, strict=True))
