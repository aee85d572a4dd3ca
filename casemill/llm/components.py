"""Connected components of an edge table, by minimum labels with shortcuts.

Each round takes, for every node, the least label among its neighbours' and its own, then
that label's own label; rounds end when nothing changes. A node's neighbours are only ever
aggregated, never gathered, so a hub costs no more than its edges. Each round's labels are
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, stash: Scratch) -> DataFrame:
    """node, component (the least node that can be reached) for the nodes of edges(a, b).
    It is one of the tables of stash."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stash(both, "edges")
    labels = stash(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        after = least.join(up, F.col("next") == F.col("up"), "left").select("node", F.col("label").alias("old"), F.least("next", "up_label").alias("label"))
        after = stash(after, "labels")
        changed = after.filter("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
