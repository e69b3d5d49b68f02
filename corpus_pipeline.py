"""Documents to training sequences, stage by stage.

Each stage takes what the one before kept and decides over all of it: quality, language,
one document of every group of near duplicates, no benchmark passages, then sequences of
token ids. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.common import prepare, table
from rostrum.llm.decontamination import decontaminate
from rostrum.llm.jaccard_join import drop_near_duplicates
from rostrum.llm.language_id import keep_identified
from rostrum.llm.packing import pack
from rostrum.llm.quality import keep_good
from rostrum.llm.tokens import vocabulary_path
from rostrum.session import materialize

# Near duplicates share at least this many hundredths of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good."""
    return keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    prepare(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near duplicates."""
    prepare(spark)
    return drop_near_duplicates(docs, size=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, table(prepare(spark), sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of the kept documents."""
    prepare(spark)
    return pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

# Classifiers and tokenizers are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
