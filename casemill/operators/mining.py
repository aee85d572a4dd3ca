"""Discriminative words of classes, by lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import lift
from ..functions.text import STOP_WORDS, content_words
from .pairs import top


def document_words(rows: DataFrame, label: str) -> DataFrame:
    """label, case_id, word: each word once a case and label."""
    words = rows.select(F.col(label).alias("label"), "case_id", F.array_distinct(content_words(F.col("fact"), STOP_WORDS)).alias("ws"))
    return words.select("label", "case_id", F.explode("ws").alias("word"))


def mine(rows: DataFrame, label: str, k: int, least_docs: int, least_df: int = 2) -> DataFrame:
    """label, word, lift, df_class, df_all, rank for the classes with least_docs cases or more.

    Counts of both kinds come from one aggregate by (label, word), the corpus count being its
    sum by word; cases with several labels count once for each.
    """
    sizes = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_class"))
    total = sizes.agg(F.sum("n_class").alias("n_all"))
    by_class = document_words(rows, label).groupBy("label", "word").agg(F.count("*").alias("df_class"))
    by_word = by_class.groupBy("word").agg(F.sum("df_class").alias("df_all"))
    joined = by_class.filter(F.col("df_class") >= least_df).join(by_word, "word").join(sizes.filter(F.col("n_class") >= least_docs), "label").join(F.broadcast(total))
    scored = joined.withColumn("lift", F.round(lift(F.col("df_class"), F.col("n_class"), F.col("df_all"), F.col("n_all")), 6))
    return top(scored, "label", k, F.desc("lift"), F.desc("df_class"), F.col("word")).select("label", "word", "lift", "df_class", "df_all", "rank")
