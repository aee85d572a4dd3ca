"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, ks: list[int]) -> DataFrame:
    """k, n_queries, precision, recall, f1, hit_rate: means over queries of
    hits(query_id, rank, hit, n_positive). A query counts at k only if it has k results."""
    spark = hits.sparkSession
    k = F.broadcast(spark.createDataFrame([(x,) for x in ks], "k int"))
    per = hits.join(k, F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count("*").alias("n"), F.sum("hit").alias("h"), F.max("n_positive").alias("p"))
    per = per.filter("n = k").withColumns({"precision": F.col("h") / F.col("k"), "recall": F.when(F.col("p") > 0, F.col("h") / F.col("p")).otherwise(0.0)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    mean = lambda c: F.round(F.avg(c), 6)
    return per.withColumn("f1", f1).groupBy("k").agg(
        F.count("*").alias("n_queries"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1"), mean(F.when(F.col("h") > 0, 1.0).otherwise(0.0)).alias("hit_rate")
    )


def label_scores(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn, f1 from (truth, predicted), over the labels of either."""
    t = rows.select(F.col("truth").alias("label"), (F.col("truth") == F.col("predicted")).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("truth") != F.col("predicted")).cast("long").alias("fn"))
    p = rows.filter("truth <> predicted").select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(1).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    s = t.unionByName(p).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def accuracy_and_macro_f1(rows: DataFrame) -> DataFrame:
    """accuracy, macro_f1 (all labels), macro_f1_true (labels that occur in truth)."""
    s = label_scores(rows)
    one = s.agg(
        F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fn")), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))), 6).alias("macro_f1_true"), F.count("*").alias("n_labels"),
    )
    return one
