import numpy as np
import pytest

from faultlens.llm import topk
from faultlens.llm.topk import top_products


def brute(vectors, asked, k):
    out = []
    for q, x in sorted(dict(asked).items()):
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in vectors if i != q and len(v) == len(x))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("cosine", [0.0, 0.7, 2.0])  # coordinates where possible, mixed, lengths only
def test_against_brute_force(spark, monkeypatch, cosine):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "COORDINATE_COSINE", cosine)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    rows = [(i, [int(x) for x in np.floor((centre[i % 6] + rng.normal(size=8) * 0.1) * 20 * (1 + i % 5))]) for i in range(300)]
    rows += [(300 + i, [0] * 8) for i in range(5)] + [(400 + i, [3, -4, 5, 1, 0, 0, 0, 0]) for i in range(60)] + [(500 + i, [i, 1]) for i in range(4)] + [(600, [7] * 3), (7, rows[7][1])]
    odd = [(None, [1] * 8), (901, None), (902, [1, None] + [0] * 6), (903, [])]
    schema = "vec_id long, vector array<long>, rank string"
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], schema)
    got = top_products(vectors, vectors.where("vec_id % 20 = 0 OR vec_id >= 500"), 9)
    asked = [(i, v) for i, v in rows if i % 20 == 0 or i >= 500]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(brute(rows, asked, 9))


def test_large_numbers_and_empty_tables(spark):
    big = [(1, [1 << 30, 5]), (2, [(1 << 30) + 1, -3]), (3, [-(1 << 30), 2])]
    vectors = spark.createDataFrame(big, "vec_id long, vector array<long>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(vectors, vectors).collect()) == sorted(brute(big, big, 20))
    assert top_products(vectors.limit(0), vectors).collect() == []
    assert top_products(vectors, vectors.limit(0)).collect() == []
