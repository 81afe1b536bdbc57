"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read as the next one's input.

Every stage works on all that its predecessor kept. Texts of any length are read whole, repeated rows are rows of their own unless a stage says
otherwise, ties are decided by number and then by text, further columns of ``documents`` pass through whatever their names, and an empty table
stays empty. ``run`` returns the description of the token files that the last
stage wrote.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.decontaminate import decontaminated
from faultlens.llm.jaccard import link_components, with_nodes
from faultlens.llm.language_id import UNKNOWN, predict, train
from faultlens.llm.mixing import mixed_documents
from faultlens.llm.registry import table, with_package
from faultlens.llm.shared import new_folder, written
from faultlens.llm.token_files import tokenized, tokenizer_path

NEAR_PERCENT, NEAR_WORDS = 80, 5
BATCH_BYTES = "2m"  # of texts that go to a Python worker at once: all stages share the workers
TOKEN_WORDS = 120_000  # words whose ids a worker keeps, beside what earlier stages left in it
BROADCAST_NUMBERS = 1_000_000  # 17 MB of rows; more are shuffled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language; those that the operator can't give one (``und``: null or without a letter) go. A null language or number stays."""
    with_package(spark, BATCH_BYTES)
    columns = docs.columns
    judged = predict(docs.select(F.struct(*columns).alias("row"), "text"), train(docs))
    return judged.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest number; of linked or equal rows repeated under it the smallest text.

    Rows are judged one by one: unlinked texts repeated under one number stay, each where its own group has no smaller number. Documents link over five-word shingles and a similarity of 0.8 or more. Documents without a word link with nothing, and
    documents without a number can't be told apart: both stay.
    """
    with_package(spark, BATCH_BYTES)
    numbered = docs.where("doc_id IS NOT NULL")
    groups = written(link_components(numbered.select("doc_id", "text"), percent=NEAR_PERCENT, size=NEAR_WORDS, nodes=True).drop("n_shingles"), "links")
    # Numbers that go, and numbers that repeat: only their rows have to meet.
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int")) == 1
    odd = written(groups.groupBy("doc_id").agg(stays.alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1"), "odd")
    some = odd if odd.count() > BROADCAST_NUMBERS else F.broadcast(odd)
    others = [c for c in docs.columns if c != "doc_id"]
    first = F.min(F.struct("text", *[c for c in others if c != "text"])).alias("rest")
    # Rows of repeated numbers meet their own group by the hash of their set; wordless ones have none.
    own = groups.where("doc_id = component_id AND node IS NOT NULL").join(some.where("stays"), "doc_id", "left_semi").select("doc_id", "node", "component").distinct()
    rows = with_nodes(numbered.join(some.where("stays"), "doc_id", "left_semi"), size=NEAR_WORDS)
    lowest = rows.join(own, ["doc_id", "node"], "left").where("node IS NULL OR component IS NOT NULL")
    wordless = F.when(F.col("node").isNull(), F.col("text")).alias("wordless")
    repeated = lowest.groupBy("doc_id", "component", wordless).agg(first).select("doc_id", *[F.col(f"rest.{c}").alias(c) for c in others])
    # An anti join keeps rows without a number.
    return docs.join(some, "doc_id", "left_anti").unionByName(repeated).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item (nor a shorter item whole). Null and empty texts hold none and stay."""
    with_package(spark, BATCH_BYTES)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target shares of the labelled domains ask for."""
    with_package(spark, BATCH_BYTES)
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus; one row a document, read back from them."""
    with_package(spark, BATCH_BYTES)
    return tokenized(docs.select("doc_id", "text"), tokenizer_path(), TOKEN_WORDS, keep=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

# Learned classifiers and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
