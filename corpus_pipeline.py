"""A cleaning pipeline over documents in five stages, each on what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.bpe import token_digests
from tallyward.llm.common import saved, table
from tallyward.llm.decontaminate import without_leaks
from tallyward.llm.oddsketch import one_of_each_group
from tallyward.llm.privacy import sanitised
from tallyward.llm.queries import vocabulary_path
from tallyward.llm.toxicity import clean_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more, smallest doc_id.

    Repeated rows are one; see ``one_of_each_group`` for rows without doc_id.
    """
    return one_of_each_group(docs, 5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of token numbers and decoded text."""
    return token_digests(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("personal_data", personal_data), ("tokens", tokens),
]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again.

    The tables lie with the other intermediate ones of the application, which go when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
