"""The case model: one row a case, keyed by case_id, whatever the source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("fact", T.StringType()),
    T.StructField("meta", T.StructType([
        T.StructField("accusation", T.ArrayType(T.StringType())),
        T.StructField("relevant_articles", T.ArrayType(T.StringType())),
        T.StructField("term_of_imprisonment", T.StructType([
            T.StructField("death_penalty", T.BooleanType()),
            T.StructField("life_imprisonment", T.BooleanType()),
            T.StructField("imprisonment", T.IntegerType()),
        ])),
        T.StructField("punish_of_money", T.DoubleType()),
        T.StructField("criminals", T.ArrayType(T.StringType())),
    ])),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(a: Column) -> Column:
    """Distinct labels in order, without nulls; a missing list is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull())))


def normalize_cases(raw: DataFrame) -> DataFrame:
    """Flatten CASE_SCHEMA rows; missing lists are empty, missing terms (false, false, 0), missing money 0."""
    term = "meta.term_of_imprisonment."
    return raw.select(
        "case_id",
        "fact",
        _labels(F.col("meta.accusation")).alias("accusation"),
        _labels(F.col("meta.relevant_articles")).alias("articles"),
        F.coalesce(F.col(term + "death_penalty"), F.lit(False)).alias("death"),
        F.coalesce(F.col(term + "life_imprisonment"), F.lit(False)).alias("life"),
        F.coalesce(F.col(term + "imprisonment"), F.lit(0)).cast("long").alias("months"),
        F.coalesce(F.col("meta.punish_of_money"), F.lit(0.0)).alias("money"),
        F.coalesce(F.col("meta.criminals"), F.array().cast("array<string>")).alias("criminals"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases derived from `documents`: deterministic labels and terms for every row."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    none = F.array().cast("array<string>")
    second = F.when(i % 3 == 0, F.array(F.concat(F.lit("src"), ((i * 7 + 3) % 20).cast("string")))).otherwise(none)
    article = F.when(i % 2 == 0, F.array(F.concat(F.lit("art"), (i % 3).cast("string")))).otherwise(none)
    return d.select(
        i.alias("case_id"),
        F.col("text").alias("fact"),
        F.when(i % 43 == 0, none).otherwise(_labels(F.concat(F.array("source"), second))).alias("accusation"),
        F.when(i % 41 == 0, none).otherwise(_labels(F.concat(F.array("lang"), article))).alias("articles"),
        (i % 97 == 0).alias("death"),
        (i % 53 == 0).alias("life"),
        (F.col("n_chars") % 61).alias("months"),
        "lang",
    )
