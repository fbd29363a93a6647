"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, and each works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weir.llm import line_dedup, near_dups, packing, secrets, shared, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model is learnt from the labelled documents among ``docs``."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, shared.table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; every document stays."""
    return line_dedup.without_copied_lines(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return near_dups.without_near_duplicates(docs, words=5, similarity=(80, 100), bands=32)


def masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.without_secrets(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("secrets", masks), ("packing", packs)]

#: SQL can't express the learnt scores, minima or packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage reads the table that the one before wrote.

    When a stage's table is written, that of the stage before it and all that was
    kept on the way are dropped. What the last stage reads stays until ``shared.clear``
    or the driver's end.
    """
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        table = shared.settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
