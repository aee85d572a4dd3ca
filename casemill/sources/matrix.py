"""Sparse matrices as tables of blocks: rows in order of case_id, end to end, with where each begins.

A block holds up to 1,024 consecutive rows as CSR arrays (row ids, offsets, columns, values) and the least
and greatest of its ids, so a read of a range of ids skips the blocks outside it by the files' statistics.
Columns are numbered by a hash of their name; a table beside the blocks has the names.

Defined results: a row without cells isn't stored; rows of one id are rows of their own; an empty
matrix is read back as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1_024
BLOCKS = "first long, last long, ids array<long>, offsets array<int>, cols array<long>, vals array<double>"


def blocks(rows: DataFrame) -> DataFrame:
    """BLOCKS of rows(case_id, cells array<struct<dim, weight>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, ends = part["case_id"], np.r_[0, np.cumsum(part["cols"].value_lengths().to_numpy())]
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
                yield pa.record_batch({"first": ids.slice(0, 1), "last": ids.slice(len(ids) - 1, 1), "ids": one(ids, None), "offsets": one(ends, pa.int32()), "cols": one(part["cols"].flatten(), None), "vals": one(part["vals"].flatten(), None)})

    flat = rows.select("case_id", F.transform("cells", lambda x: F.xxhash64(x["dim"])).alias("cols"), F.col("cells.weight").alias("vals"))
    return flat.repartitionByRange("case_id").sortWithinPartitions("case_id").mapInArrow(run, BLOCKS)


def write_matrix(rows: DataFrame, path: str) -> None:
    """Blocks and column names; the names go last, so a matrix without them isn't whole."""
    blocks(rows).write.parquet(f"{path}/blocks")
    names = rows.select(F.explode("cells.dim").alias("dim")).distinct()
    names.select(F.xxhash64("dim").alias("col"), "dim").write.parquet(f"{path}/columns")


def read_matrix(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """case_id, dim, weight of the rows from `low` to `high`, ends included."""
    b = spark.read.parquet(f"{path}/blocks")
    within = F.lit(True)
    if low is not None:
        b, within = b.filter(F.col("last") >= low), within & (F.col("case_id") >= low)
    if high is not None:
        b, within = b.filter(F.col("first") <= high), within & (F.col("case_id") <= high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in range(x.num_rows):
                n = np.diff(x["offsets"][r].values.to_numpy())
                yield pa.record_batch({"case_id": np.repeat(x["ids"][r].values.to_numpy(), n), "col": x["cols"][r].values, "weight": x["vals"][r].values})

    cells = b.select("ids", "offsets", "cols", "vals").mapInArrow(run, "case_id long, col long, weight double").filter(within)
    return cells.join(spark.read.parquet(f"{path}/columns"), "col").select("case_id", "dim", "weight")
