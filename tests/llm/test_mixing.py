import numpy as np

from faultlens.llm.mixing import copies, fit_classifier, fit_rates, label_domains, mixed_documents, rates_of, with_posteriors
from pyspark.sql import functions as F


def corpus():
    docs, labels = [], []
    for i in range(120):
        kind = ("good", "poor", "toxic")[i % 3]
        mark = {"good": "fine", "poor": "%%% |", "toxic": "vile scum"}[kind]
        docs.append((i, f"text w{i % 7} {mark} w{i % 5} end {'long ' * (i % 4)}"))
        if i < 90:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return docs, labels + [(0, 0, 0), (1, None, None), (None, 1, 0), (999, 1, 1)]


def test_posteriors_and_rates(spark, docs_of):
    rows, labels = corpus()
    docs = docs_of(rows + [(500, None), (501, ""), (502, "fine"), (502, "fine")])
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    classifier = fit_classifier(label_domains(docs, labelled))
    assert classifier.domains == ["good", "poor", "toxic"]
    judged = with_posteriors(docs, classifier).cache()
    out = {r.doc_id: r for r in judged.collect()}
    for i in range(3, 120):
        assert int(np.argmax(out[i].posterior)) == i % 3 and abs(sum(out[i].posterior) - 1) < 1e-9
    assert out[500].n_tokens == out[501].n_tokens == 0 and out[502].n_tokens == 1
    moves = fit_rates(judged, [0.5, 0.3, 0.2])
    p, n = np.array([r.posterior for r in judged.collect()]), np.array([r.n_tokens for r in judged.collect()])
    rates = rates_of(p, moves)[0]
    totals = (rates * n) @ p
    assert rates.min() >= 0 and np.allclose(totals / n.sum(), [0.5, 0.3, 0.2], atol=1e-3)


def test_documents_go_in_by_rate(spark, docs_of):
    rows, labels = corpus()
    docs = docs_of(rows)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = mixed_documents(docs, labelled)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum(i % 3 == 2 for i in ids) <= 4 and all(i in ids for i in range(3, 120) if i % 3 == 0)
    assert mixed_documents(docs.limit(0), labelled).collect() == []
    assert sorted(r.doc_id for r in mixed_documents(docs, labelled.limit(0)).collect()) == list(range(120))


def test_copies(spark):
    rows = spark.range(10_000).select(F.lit(1.25).alias("rate"), "id").select(copies(F.col("rate"), "id").alias("n"))
    assert abs(rows.agg(F.avg("n")).first()[0] - 1.25) < 0.02 and {r.n for r in rows.distinct().collect()} == {1, 2}


def test_against_brute_force(spark):
    """Rates of many small problems against plain projected gradient on dense arrays, run to the end."""
    rng = np.random.default_rng(3)
    for shares, peaked in (([0.5, 0.3, 0.2], 3.0), ([0.9, 0.1, 0.0], 8.0), ([1 / 3, 1 / 3, 1 / 3], 0.1)):
        p = rng.dirichlet([1 / peaked] * 3, size=90)
        p[30:60] = p[0]  # a third of all rows have one posterior
        n = rng.integers(0, 2000, 90)
        n[5] = 400_000  # one very long text
        judged = spark.createDataFrame([(int(t), row.tolist()) for t, row in zip(n, p)], "n_tokens long, posterior array<double>").repartition(4)
        rates = rates_of(p, fit_rates(judged, shares))[0]
        assert (rates >= 0).all() and np.ptp(rates[30:60]) < 1e-12  # equal posteriors, equal rates
        target = np.array(shares) * n.sum()
        plain = np.ones(90)
        curvature = np.linalg.eigvalsh((p * n[:, None]).T @ p).max()
        for _ in range(20_000):
            plain = np.maximum(0.0, plain - p @ ((plain * n) @ p - target) / curvature)
        gap = lambda r: np.abs((r * n) @ p - target).max() / n.sum()
        assert gap(rates) <= gap(plain) + 5e-3  # it ends after a bounded number of rounds


def test_ties_and_a_very_long_text(spark, docs_of):
    """Parts of equal association, and a text of a million words."""
    rows = [(i, ("alpha beta" if i % 2 else "gamma delta") + " same") for i in range(20)] + [(50, "alpha " * 1_000_000)]
    labelled = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    classifier = fit_classifier(label_domains(docs, labelled))
    out = {r.doc_id: r for r in with_posteriors(docs, classifier).collect()}
    assert classifier.domains == ["good", "poor"] and out[50].n_tokens == 1_000_000 and out[50].posterior[0] > 0.5
    assert len({tuple(out[i].posterior) for i in range(1, 20, 2)}) == 1
