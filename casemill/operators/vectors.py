"""Dense vectors: exact top-k, centroids, nearest centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    n = norm(a) * norm(b)
    return F.when(n > 0, dot / n).otherwise(F.lit(0.0))


def as_double(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return rows.select(F.col(key).alias("case_id"), F.col(vector).cast("array<double>").alias("v"))


def exact_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, case_id, score, rank: exact cosine over (case_id, v), self excluded, in blocks."""
    return blocks.exact_top_k(corpus, queries, k)


def centroids(rows: DataFrame) -> DataFrame:
    """label, dim, mean, std (population) of (label, v); partial sums only are shuffled."""
    each = rows.select("label", F.posexplode("v").alias("dim", "x"))
    return each.groupBy("label", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def centroid_vectors(rows: DataFrame) -> DataFrame:
    made = centroids(rows).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"), F.avg("std").alias("avg_std"))
    return made.select("label", F.col("m.mean").alias("centroid"), "avg_std")


def spread(rows: DataFrame) -> DataFrame:
    """label, n, avg_std and the least, greatest and mean distance to the centroid."""
    c = centroid_vectors(rows).withColumnRenamed("label", "c_label")
    gap = F.zip_with("v", "centroid", lambda x, y: x - y)
    d = rows.join(c, F.col("label") == F.col("c_label")).withColumn("d", norm(gap))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.first("avg_std").alias("avg_std"), F.min("d").alias("min_dist"), F.max("d").alias("max_dist"), F.avg("d").alias("mean_dist"))


def nearest_centroids(rows: DataFrame) -> DataFrame:
    """case_id, label, predicted, score, rank of every class for every row; there is one
    centroid a class, which Spark broadcasts if it is small enough."""
    c = centroid_vectors(rows).select(F.col("label").alias("predicted"), "centroid")
    scored = rows.crossJoin(c).select("case_id", "label", "predicted", F.round(cosine(F.col("v"), F.col("centroid")), 6).alias("score"))
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "predicted")
    return scored.withColumn("rank", F.row_number().over(w))
