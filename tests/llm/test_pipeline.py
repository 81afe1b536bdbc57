import corpus_pipeline
import faultlens.llm
from faultlens.llm.registry import QUERIES, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    extra = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, "123", "en", "s", 3), (None, "the and of the with", "en", "s", 9)], docs.schema)
    docs = docs.unionByName(extra)
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
        numbers = {r.doc_id for r in docs.select("doc_id").collect()}
        assert not numbers & {900_001, 900_002, 900_003} and None in numbers, name
    assert sizes[1] == sizes[0] - 3 and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == sizes[-1] and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(last.columns)


def test_rows_repeated_under_a_number(spark):
    """Only rows whose own group has a smaller number, or an equal or linked row under the same one, go."""
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(60))

    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (2, text(3)), (2, text(3)), (2, text(3) + " end"), (3, text(2)), (4, text(1)), (4, text(3)), (5, ""), (5, None), (5, ""), (5, text(5)), (6, text(6)), (None, text(1))]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_duplicates(spark, docs, DATA)
    want = [(1, text(1)), (2, text(2)), (2, text(3)), (5, ""), (5, None), (5, text(5)), (6, text(6)), (None, text(1))]
    assert got.columns == docs.columns and sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_empty_documents(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).collect() == []


def test_every_operator_has_a_query():
    faultlens.llm.load_all()
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
