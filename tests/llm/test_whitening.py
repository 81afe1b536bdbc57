import math

import numpy as np
import pytest

from faultlens.llm.whitening import Spectrum, Whitening, positive_eigenvalues, products, whiten

FIELDS = "vec_id long, embedding array<double>, n string, component string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], FIELDS)


def matrix_of(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("size", [1, 2, 5, 30, 64])
def test_inertia_counts_eigenvalues(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        a = rng.normal(size=(size, size))
        a = a + a.T
        shift = rng.normal() * size ** 0.5
        assert positive_eigenvalues(a - shift * np.eye(size)) == (np.linalg.eigvalsh(a) > shift).sum()
    assert positive_eigenvalues(np.zeros((size, size))) == 0
    # No pivot on the diagonal: blocks of two.
    swap = np.kron(np.eye(size), np.array([[0.0, 1.0], [1.0, 0.0]]))
    assert positive_eigenvalues(swap) == size


@pytest.mark.parametrize("values", [
    [9.0, 4.0, 1.0, 0.5, 0.1], [5.0, 5.0, 5.0, 1.0, 1.0, 0.2], [1.0] * 12, [1e6, 1e3, 1.0, 1e-2], [3.0, 3.0 - 1e-9, 3.0 - 2e-9, 1.0], list(np.linspace(1, 2, 64)), [2.0, 0.0, 0.0]])
def test_leading_components(values):
    matrix = matrix_of(values)
    matrix = (matrix + matrix.T) / 2
    spectrum = Spectrum(matrix)
    found, vectors = spectrum.leading(8, 1e-11 * matrix.trace())
    expected = np.sort(np.array(values))[::-1]
    expected = expected[expected > 1e-11 * matrix.trace()][:8]
    assert len(found) == len(expected) and np.abs(found - expected).max() <= 1e-12 * max(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-9
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-11 * max(values)


def brute(rows, most=8):
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in keep], float)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:most]
    whole, sums = x.astype(np.int64).tolist(), x.astype(np.int64).sum(axis=0).tolist()
    deviation = [sum((len(x) * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in whole]
    return [i for i, _ in keep], deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    spread = np.linspace(3, 0.2, 12)
    rows = [(i, (rng.normal(size=12) * spread + 0.3).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(200)] + [(3, rows[5][1]), (None, rows[6][1])]  # a third of all rows are one vector
    odd = [(900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12), (904, [float("-inf")] * 12), (905, [1e30] * 12), (906, [1.0, 2.0])]
    got = whiten(frame(spark, rows + odd).repartition(6)).collect()
    ids, deviation, whitened, explained = brute(rows)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    signs = {}
    for k in range(8):
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened, r.explained) for r in got if r.component == k + 1))
        theirs = sorted((i is None, i or 0, d, w) for i, d, w in zip(ids, deviation, whitened[:, k], strict=True))
        assert [m[:3] for m in mine] == [t[:3] for t in theirs]
        a, b = np.array([m[3] for m in mine]), np.array([t[3] for t in theirs])
        # Rows repeated under one number may be ordered otherwise where the sign differs.
        signs[k] = min(np.abs(np.sort(a) - np.sort(s * b)).max() for s in (1, -1))
        assert signs[k] < 1e-8 and abs(mine[0][4] / explained[k] - 1) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9


def test_degenerate_tables(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    line = whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9


def test_large_numbers_are_exact():
    rng = np.random.default_rng(0)
    for most in (10, 1 << 27, 1 << 40):
        y = rng.integers(-most, most, size=(50, 3))
        assert (products(y) == y.astype(object).T @ y.astype(object)).all()
    big = Whitening(10 ** 9, np.zeros(2, np.int64), np.array([3, 5]), np.ones(1), np.ones((2, 1)), np.ones(1))
    assert big.deviations(np.array([[1, 2], [1000, -1000]])) == [(10 ** 9 - 3) ** 2 + (2 * 10 ** 9 - 5) ** 2, None]
    small = Whitening(10, np.zeros(2, np.int64), np.array([3, 5]), np.ones(1), np.ones((2, 1)), np.ones(1))
    assert small.deviations(np.array([[1, 2]])) == [7 ** 2 + 15 ** 2]
