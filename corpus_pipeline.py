"""From documents to tokens: five stages, each written as Parquet and read again by the next.

Every stage is a function of (spark, docs, sf_dir). All but the last keep the columns of documents,
whatever else the table holds; null texts are treated as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentrace.llm import bpe, lines, mixing, similarity, toxicity
from agentrace.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the learned filter and the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the open folds, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return toxicity.accepted(docs, toxicity.train(docs, labels))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without three-line windows that stand earlier; every document stays."""
    found = lines.deduped(docs.select(*COLUMNS))
    text = F.col("text")
    return found.select("row.*", text, F.char_length(text).cast("long").alias("_n")).select(
        *(F.col("_n").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS)
    )


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near copies; texts without words all stay.

    Shingles are of five words and the similarity is 0.8, as for any near-duplicate stage.
    """
    return similarity.one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per emitted document its tokens' number and digest, and that of the decoded text."""
    return bpe.round_trip_digests(docs.select(*COLUMNS), bpe.default_tokenizer(), keep_words=False)


STAGES = [
    ("toxicity", clean),
    ("line_dedup", without_repeats),
    ("jaccard", one_of_each),
    ("mixing", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
