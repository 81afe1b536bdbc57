import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultlens.llm import token_files
from faultlens.llm.shared import new_folder
from faultlens.llm.token_files import Encoder, TokenFile, read_dictionary, read_token_files, tokenizer_path, write_token_files

TEXTS = ["a  b", "  x y", "a \n b  c", "x<|endoftext|> y", "don't  it's  ok", " a b", " ", "a b ", " \u3000 a", "a word%%% Word, x. y.z é. é... don't. 's. it's", "a\u0120 \u0120b", "\n..\na\nb\nc %", "x .. . ,",
         "line\nNext Line\n12\n%%\n— dash\ttab", "日本語 テキスト, 漢字", "", "\x1c a", "a\r b"]


def test_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    encode = Encoder(tokenizer_path())
    for _ in range(2):
        got = encode(pa.array(TEXTS))
        for text, ids in zip(TEXTS, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("cached", [1, 60, 5000])
def test_hostile_texts_and_forgotten_words(cached, monkeypatch):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    encode = Encoder(tokenizer_path(), cached)
    rng = random.Random(cached)
    parts = ["a", "Bc", "é", "日本", "\u0301", "'s", "don", "1", "23", ".", "%%", ",", "|", "-", "\n", " ", "  ", "\t", "\r", "\u00a0", "\u3000", "\u0120", "½", "ⅷ", "x" * 300, "\x00", "😀", "ß", "İ", "\u200b"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(30)]
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encode.words) <= cached + 4000


def test_words_of_equal_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(token_files, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    encode = Encoder(tokenizer_path())
    for text in ("one two three, four. two", "five one, six\nseven two."):
        assert np.frombuffer(encode(pa.array([text]))[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark, docs_of):
    rows = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)] + [(100, None), (100, "tie"), (100, "tie"), (None, "no number"), (-5, "word " * 30_000)]
    folder = new_folder(spark, "test")
    manifest = write_token_files(docs_of(rows), tokenizer_path(), folder)
    got = read_token_files(manifest, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    numbered = [(-(1 << 63) if i is None else i, t or "") for i, t in rows]
    want = sorted((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids) + (0,)) for i, t in numbered)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, len(ids), crc(ids)) for i, ids in want)
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    dictionary = read_dictionary(folder)
    found = [TokenFile(r.file, dictionary).find(-5) for r in manifest.collect()]
    assert [len(x) for x in found if x] == [1]
    with pytest.raises(ValueError):
        TokenFile(manifest.collect()[0].file, dictionary + b"x")


def test_empty_table(spark, docs_of):
    folder = new_folder(spark, "test")
    assert read_token_files(write_token_files(docs_of([(1, "x")]).limit(0), tokenizer_path(), folder), folder).collect() == []
