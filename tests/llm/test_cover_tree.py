import numpy as np
import pytest

from faultlens.llm import cover_tree as module
from faultlens.llm.cover_tree import Links, chords, cover_tree, near_duplicate_vectors, threshold_pairs, units

FIELDS = "vec_id long, embedding array<float>, label int, n_links string, node int, v string, cell string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "y", "z", "k") for i, v, lab in rows], FIELDS)


def usable(row):
    return row[1] and row[2] is not None and all(c is not None and np.isfinite(c) for c in row[1]) and any(row[1])


def brute(rows, cosine):
    """Links of each row, and its component, over all pairs."""
    n = len(rows)
    v = [np.float32(r[1]).astype(float) if usable(r) else None for r in rows]
    linked = [[j for j in range(n) if j != i and v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and rows[i][2] == rows[j][2]
               and v[i] @ v[j] / (np.sqrt(v[i] @ v[i]) * np.sqrt(v[j] @ v[j])) >= cosine] for i in range(n)]
    out, comp = [], [-1] * n
    for i in range(n):
        if comp[i] < 0:
            comp[i], waiting = i, [i]
            while waiting:
                for j in linked[waiting.pop()]:
                    if comp[j] < 0:
                        comp[j] = i
                        waiting.append(j)
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(linked[i]), least, None if rows[i][0] is None or least is None else rows[i][0] == least))
    return sorted(out, key=str), linked


def sample(seed, size=8):
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(12):
        centre = rng.normal(size=size)
        # One label holds most rows; families are tight, loose (chains) or alone.
        for _ in range([1, 4, 30][base % 3]):
            rows.append((len(rows), (centre + rng.normal(size=size) * [0.02, 0.25, 0.6][base // 4]).tolist(), 0 if base < 9 else base))
    rows += [(1000 + i, (rng.normal(size=size) * 3).tolist(), i % 2) for i in range(60)]
    rows += [(2000 + i, rows[40][1], rows[40][2]) for i in range(25)]  # equal ones
    rows += [(2100 + i, [c * (i + 1) for c in rows[41][1]], rows[41][2]) for i in range(40)]  # one direction
    rows += [(rows[3][0], rows[3][1], rows[3][2]), (rows[3][0], rows[50][1], rows[3][2]), (None, rows[41][1], rows[41][2]), (None, [5.0] * size, 77)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * size, 0), (3003, [None] + [1.0] * (size - 1), 0), (3004, [float("nan")] * size, 0), (3005, rows[40][1], None),
             (3006, [1.0, 2.0], 0), (3007, [1.0, 2.0], 0), (3008, [float("inf")] * size, 0), (3009, [1e-40] * size, 5), (3010, [1e38] * size, 5), (3011, [1.0] * size, 5)]
    return rows


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL_ROWS", 20), ("AIMED_ROWS", 8), ("FAN", 4), ("CHUNK_ROWS", 7), ("LEAF", 3), ("BLOCK", 5)):
            monkeypatch.setattr(module, name, value)
    rows = sample(1)
    expected, linked = brute(rows, 0.93)
    df = frame(spark, rows).repartition(3)
    assert result(near_duplicate_vectors(df)) == expected
    if small:
        got = sorted((r.vec_a, r.vec_b, round(r.cosine, 9)) for r in threshold_pairs(df).where("vec_a IS NOT NULL AND vec_b IS NOT NULL").collect())
        first = {}
        for i, row in enumerate(rows):
            if usable(row) and row[0] is not None:
                key = (row[2], np.float32(row[1]).tobytes())
                first[key] = min(first.get(key, row[0]), row[0])
        pairs = set()
        for i, others in enumerate(linked):
            for j in others:
                a, b = ((rows[k][2], np.float32(rows[k][1]).tobytes()) for k in (i, j))
                if a != b and first.get(a) is not None and first.get(b) is not None:
                    pairs.add((min(first[a], first[b]), max(first[a], first[b])))
        assert sorted({(a, b) for a, b, _ in got}) == sorted(pairs) and len(got) == len(pairs)


def test_whole_cells_link_at_once(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL_ROWS", 16)
    monkeypatch.setattr(module, "AIMED_ROWS", 8)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(150)] + [(200 + i, rng.normal(size=8).tolist(), 1) for i in range(50)]
    assert result(near_duplicate_vectors(frame(spark, rows))) == brute(rows, 0.93)[0]


def test_empty_tables(spark):
    assert near_duplicate_vectors(frame(spark, [])).collect() == [] and threshold_pairs(frame(spark, [])).collect() == []
    alone = [(1, None, 1), (2, [1.0], None)]
    assert result(near_duplicate_vectors(frame(spark, alone))) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("seed", range(4))
def test_tree_levels(seed):
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.normal(size=(1, 6)) + rng.normal(size=(60, 6)) * s for s in (0.01, 0.1, 1.0)])
    tree = cover_tree(vectors, np.arange(180), np.ones(180, np.int64))
    assert sorted(tree.ids.tolist()) == list(range(180))
    unit = units(vectors)[tree.ids]
    for node in range(len(tree.begin)):
        own = tree.below(node)
        assert tree.centre[node] == own.start  # nesting: the centre is its first child's centre too
        assert chords(unit[own] @ unit[own.start]).max() <= tree.radius[node] + 1e-7  # rounding of a distance near 0
        if tree.children[node]:
            parts = tree.parts(node)
            assert tree.begin[parts[0]] == own.start and tree.end[parts[-1]] == own.stop and (tree.begin[parts[1:]] == tree.end[parts[:-1]]).all()
            level = 2.0
            while level >= tree.radius[node]:
                level /= 2
            apart = chords(unit[tree.begin[parts]] @ unit[tree.begin[parts]].T) + 9 * np.eye(len(parts))
            assert apart.min() > level and tree.radius[parts].max() <= level  # separation and covering
    links = Links(tree, tree, 0.93)
    assert links.counts[0].tolist() == ((unit @ unit.T >= 0.93).sum(axis=1) - 1).tolist()


def test_pairs_at_the_threshold():
    # cos = 0.6 * 1 exactly, and just below it.
    vectors = np.array([[1.0, 0.0], [0.6, 0.8], [0.6 - 1e-12, 0.8]])
    tree = cover_tree(vectors, np.arange(3), np.ones(3, np.int64))
    counts = dict(zip(tree.ids.tolist(), Links(tree, tree, 0.6).counts[0].tolist(), strict=True))
    assert counts == {0: 1, 1: 2, 2: 1}
