import random

from pyspark.sql import functions as F

from faultlens.plans.joins import mentions


def test_against_every_pair(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aab_é日😀\\n.") for _ in range(rng.randint(0, 9)))
    texts = [(i, [word() * rng.randint(1, 3) for _ in range(rng.randint(0, 4))]) for i in range(120)] + [(500, None), (501, [None, "a"]), (502, ["x" * 5000 + "needle"]), (7, ["ab"])]
    needles = sorted({word() for _ in range(150)} | {"needle", "zzz", "x", "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"}) + [None, "a"]
    got = mentions(spark.createDataFrame(texts, "k int, pieces array<string>").repartition(3), "k", F.col("pieces"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {(k, n) for k, pieces in texts for n in needles if n is not None and any(p is not None and n in p for p in pieces or [])}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_no_needles_and_no_texts(spark):
    texts, needles = spark.createDataFrame([(1, ["abc"])], "k int, pieces array<string>"), spark.createDataFrame([("b",)], "needle string")
    assert mentions(texts, "k", F.col("pieces"), needles.limit(0)).collect() == [] and mentions(texts.limit(0), "k", F.col("pieces"), needles).collect() == []
