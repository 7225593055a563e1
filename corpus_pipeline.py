"""Corpus preparation: five stages over `documents`, each written and read again before the next.

Every stage but the last returns the columns of documents. The last one places what is left into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from areapanel.llm.decontamination import drop_contaminated
from areapanel.llm.jaccard import keep_one
from areapanel.llm.language_id import keep_identified
from areapanel.llm.mixing import keep_mix
from areapanel.llm.sharding import shard_documents
from areapanel.llm.tables import stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the conditional random field can tell."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares."""
    return keep_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return shard_documents(docs, keep=tuple(c for c in ("lang", "source", "n_chars") if c in docs.columns))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mixture", mixture), ("shards", shards)]

#: Language identification and sharding have no SQL; tests hold the stages' operators against brute force, none runs all five together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
