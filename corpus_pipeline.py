"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Every stage but the last passes on all columns of its rows. Defined results for odd rows: a null text
is judged as an empty one and stays null while it is kept; rows with a null doc_id go through every
stage, and match no other row in the second and third; rows that share a doc_id are documents of their
own; of equal rows the third stage keeps one; further columns, whatever their names, are carried to the
last stage, which gives pieces; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemill.llm import decontaminate, lines, neardup, packing, quality
from casemill.llm.common import ready, stash, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker accepts; equal texts are judged alike."""
    ready(spark)
    ranker = quality.fit(quality.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality.score(docs, ranker, keep=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier one; a document that loses all its lines has an
    empty text. Of equal lines the first by doc_id, row and place stays."""
    ready(spark)
    return lines.remove_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least doc_id; texts without words are copies of each other."""
    ready(spark)
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts hold none."""
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences; an empty or null text is a piece of its closing id."""
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Linear models, similarity joins and packing have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
