"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from codeloom.llm.queries import table, vocabulary
from codeloom.llm.scratch import Scratch


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: words in fives, similarity 0.8 or more."""
    return near_dedup.drop_near_copies(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, with no document taken twice."""
    return mixing.select_mixture(docs, mixing.PIPELINE)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in small batches: the executors still hold what earlier stages took."""
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), batch_chars=1_000_000)


STAGES = [("quality", classify), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", tokenize)]

#: SQL can express neither the trained classifier nor the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Null and empty texts, repeated rows and further columns go through as each operator's docstring says; an empty table gives no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
