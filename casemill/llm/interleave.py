"""Sharding (operator 3) by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within each source, get the fractional rank
(rank + 0.5) / rows of the source, and the order by fractional rank is cut into shards of
equal row counts, so each shard holds each source in its share of the whole.

No window spans a source: each source is cut into hash cells of about CELL_ROWS rows, rows
are numbered inside a cell, and a running sum over the cells gives the rest; the same again
for the order by fractional rank. A source with a third of all rows is many small windows.

Defined results: a null text has no bytes; a null source is a source of its own; a null
doc_id takes part like any other; repeated rows get slots of their own (which of them gets
which isn't fixed); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stash

CELL_ROWS = 50_000


def _before(counts: DataFrame, parts: list[str], order: str) -> DataFrame:
    """Rows in earlier cells; counts has one row a cell."""
    w = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(docs: DataFrame, n_shards: int, seed: int = 7, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard, slot."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    base = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("stratum"),
        F.xxhash64(F.lit(seed), "doc_id").alias("h"),
    )
    base = stash(base, "shard-rows")
    totals = stash(base.groupBy("stratum").agg(F.count("*").alias("total")), "shard-totals")
    n_strata, n = totals.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    cells = F.ceil(F.col("total") / cell_rows)
    unit = F.shiftright("h", 32) + F.lit(1 << 31)
    placed = base.join(small(totals, n_strata), "stratum").withColumn("cell", F.shiftright(unit * cells, 32))
    counts = placed.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum", "cell").orderBy("h", "doc_id")
    n_cells = n_strata + n // cell_rows
    ranked = (
        placed.withColumn("rn", F.row_number().over(w))
        .join(small(_before(counts, ["stratum"], "cell").drop("n"), n_cells), ["stratum", "cell"])
        .withColumn("fraction", (F.col("before") + F.col("rn") - 0.5) / F.col("total"))
        .select("doc_id", "source", "size", "text_crc32", "stratum", "fraction")
    )
    slices = max(1, -(-n // cell_rows))
    ranked = stash(ranked.withColumn("slice", F.floor(F.col("fraction") * slices)), "shard-ranks")
    starts = _before(ranked.groupBy("slice").agg(F.count("*").alias("n")), [], "slice").drop("n")
    w = Window.partitionBy("slice").orderBy("fraction", "stratum", "doc_id")
    position = F.col("before") + F.col("rn") - 1
    exact = F.expr(f"(before + rn - 1) * {n_shards} div {max(n, 1)}L")
    return (
        ranked.withColumn("rn", F.row_number().over(w).cast("long"))
        .join(small(starts, slices), "slice")
        .withColumn("shard", exact.cast("int"))
        .withColumn("slot", position - F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}L"))
        .select("doc_id", "source", "size", "text_crc32", "fraction", "shard", F.col("slot").cast("long").alias("slot"))
    )
