"""A clustered vector index with 8-bit codes that is built once, saved, loaded and searched.

K-means cells, about the square root of the rows, are fitted on a bounded sample; every row is placed
in its nearest cell and coded with 8 bits a dimension, between the least and the greatest value of
all rows. An index is three tables: the cells with their centre, radius and rows; the codes, in chunks
of rows of one cell end to end; and the rows with their vectors. A cell of many rows has several
parts, so that no cell meets whole in one task.

`search` scores the codes of each query's nearest cells, as matrices in tasks, and scores the best of
them anew on their vectors. How many cells it takes to find RECALL of the true neighbours is measured
when the index is built, on a sample of its own rows against exact search, and kept with the cells.
`search_exactly` needs no such guess: no row of a cell is nearer to a query than the cell's centre less
its radius, so after a first pass over the nearest cells only those are searched that can still beat
the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash
from . import blocks
from .vectors import cosine, unit

#: Cells at most, and rows of the sample for each; all rows are placed.
MOST_CELLS, SAMPLE_A_CELL = 4_096, 64
#: Rows of a part of a cell.
PART_ROWS = 65_536
#: Rows whose distances to all centres are held at once.
AT_ONCE = 1_024
#: The share of true neighbours that the measured number of cells finds on the sample of queries.
RECALL, RECALL_QUERIES, RECALL_K = 0.95, 100, 10
#: Rows that are scored on their vectors, for each that is asked for.
SHORTLIST = 4
#: Cells of the first pass of an exact search, and what rounding may add to a score.
FIRST, SLACK = 2, 1e-6
CELLS = "cell int, centre array<double>, radius double, n long, parts int, probes int, low array<double>, step array<double>"
CODED = "cell int, part int, ids array<long>, codes binary"


@dataclass(frozen=True)
class Index:
    """cells: cell, centre, radius, n, parts, probes, low, step, one row a cell. codes: CODED. rows: case_id, cell, part, v."""

    cells: DataFrame
    codes: DataFrame
    rows: DataFrame


def nearest(spark: SparkSession, centres: np.ndarray, n: int):
    """A function of unit vectors: the n nearest cells, the nearest first, ties by number."""
    shared = spark.sparkContext.broadcast((centres, (centres**2).sum(axis=1) / 2))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        c, half = shared.value
        out = []
        for at in range(0, len(v), AT_ONCE):
            near = half - np.stack(v.iloc[at : at + AT_ONCE].to_numpy()) @ c.T
            out += list(np.argsort(near, axis=1, kind="stable")[:, :n].astype(np.int32))
        return pd.Series(out)

    return cells


def matrix(b: pa.RecordBatch, name: str = "v") -> np.ndarray:
    return b[name].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def ranges(placed: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows and radius of each cell, least and greatest value of each dimension) of placed(cell, v)."""
    n, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius, low, high = np.zeros(n), np.zeros(n), np.full(d, np.inf), np.full(d, -np.inf)
        for b in batches:
            v, cell = matrix(b), b["cell"].to_numpy()
            count += np.bincount(cell, minlength=n)
            np.maximum.at(radius, cell, np.linalg.norm(v - centres[cell], axis=1))
            low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        kind, at = np.repeat([0, 1, 2, 3], [n, n, d, d]), np.r_[np.arange(n), np.arange(n), np.arange(d), np.arange(d)]
        yield pa.record_batch({"kind": kind, "at": at, "x": np.r_[count, radius, -low, high]})

    told = placed.select("cell", "v").mapInArrow(run, "kind long, at long, x double").groupBy("kind", "at").agg(F.sum("x").alias("total"), F.max("x").alias("most"))
    out = {k: np.zeros(d if k > 1 else n) for k in range(4)}
    for r in told.collect():  # two numbers a cell and two a dimension
        out[r["kind"]][r["at"]] = r["total"] if r["kind"] == 0 else r["most"]
    return out[0].astype(np.int64), out[1], -out[2], out[3]


def build(corpus: DataFrame, cells: int | None = None, seed: int = 5) -> Index:
    """The index of (case_id, v); v is an array of doubles. Rows without a vector aren't in it."""
    spark = corpus.sparkSession
    rows = stash(corpus.filter("v is not null").select("case_id", "v", unit(F.col("v")).alias("u")), "vectors")
    total = rows.count()
    n = min(cells or round(total**0.5), MOST_CELLS, total)
    if not n:
        none = spark.createDataFrame([], CELLS)
        return Index(none, spark.createDataFrame([], CODED), spark.createDataFrame([], "case_id long, cell int, part int, v array<double>"))
    sample = rows.orderBy(F.xxhash64("case_id"), "case_id").limit(SAMPLE_A_CELL * n).select(array_to_vector("u").alias("features"))
    centres = np.array(KMeans(k=n, seed=seed, maxIter=8, initMode="random").fit(sample.coalesce(max(1, SAMPLE_A_CELL * n // 4096))).clusterCenters())
    n = len(centres)
    placed = stash(rows.withColumn("cell", F.get(nearest(spark, centres, 1)(F.col("u")), F.lit(0))), "placed")
    count, radius, low, high = ranges(placed.select("cell", F.col("u").alias("v")), centres)
    step = np.maximum(high - low, 1e-12) / 255
    parts = np.maximum(1, -(-count // PART_ROWS))
    probes = measured_probes(placed, centres)
    told = [(i, c.tolist(), float(r), int(k), int(p), probes, low.tolist(), step.tolist()) for i, (c, r, k, p) in enumerate(zip(centres, radius, count, parts, strict=True))]
    known = spark.createDataFrame(told, CELLS)
    dealt = placed.join(F.broadcast(known.select("cell", "parts")), "cell")  # at most MOST_CELLS rows
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("case_id"), F.col("parts")).cast("int"))
    return Index(known, coded(dealt, low, step), dealt.select("case_id", "cell", "part", "v"))


def measured_probes(placed: DataFrame, centres: np.ndarray) -> int:
    """Cells that a search must probe to find RECALL of the true neighbours of RECALL_QUERIES of the rows."""
    asked = placed.orderBy(F.xxhash64("case_id", F.lit("asked")), "case_id").limit(RECALL_QUERIES).select("case_id", "v", "u")
    asked = stash(asked, "asked")
    true = blocks.exact_top_k(placed.select("case_id", "v"), asked.select("case_id", "v"), RECALL_K).select("query_id", F.col("case_id").alias("found"))
    near = nearest(placed.sparkSession, centres, len(centres))
    true = true.join(placed.select("case_id", "cell"), F.col("found") == F.col("case_id")).drop("case_id")
    order = asked.select("case_id", near(F.col("u")).alias("order"))
    at = true.join(order, F.col("query_id") == F.col("case_id")).select(F.array_position("order", F.col("cell")).alias("at"))
    places = sorted(r["at"] for r in at.collect())  # RECALL_QUERIES * RECALL_K numbers
    return int(places[min(len(places) - 1, int(RECALL * len(places)))]) if places else 1


def coded(dealt: DataFrame, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """CODED chunks of dealt(case_id, u, cell, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.clip(np.rint((matrix(b, "u") - low) / step), 0, 255).astype(np.uint8)
            for at, to in blocks.cuts(b, ["cell", "part"], blocks.CHUNK):
                yield pa.record_batch({"cell": b["cell"].slice(at, 1), "part": b["part"].slice(at, 1), "ids": blocks.list_of(b["case_id"].slice(at, to - at), blocks.ends([to - at])), "codes": pa.array([code[at:to].tobytes()], pa.binary())})

    together = dealt.select("case_id", "u", "cell", "part").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return together.mapInArrow(run, CODED)


def save(index: Index, path: str) -> None:
    """The cells go last: an index without them isn't whole."""
    index.codes.write.parquet(f"{path}/codes")
    index.rows.write.parquet(f"{path}/rows")
    index.cells.coalesce(1).write.parquet(f"{path}/cells")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("cells", "codes", "rows")))


def load_or_build(corpus: DataFrame, path: str, cells: int | None = None, seed: int = 5) -> Index:
    """The index at path, made there if there is none; the path carries the model's name and version."""
    spark = corpus.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cells/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        save(build(corpus, cells, seed), path)
    return load(spark, path)


def asked_cells(index: Index, queries: DataFrame, cells: DataFrame) -> DataFrame:
    """Blocks of queries(case_id, v) for each (cell, part) of cells(q_id, cell)."""
    parts = index.cells.select("cell", "parts")
    asked = queries.join(cells, F.col("case_id") == F.col("q_id")).join(F.broadcast(parts), "cell")  # at most MOST_CELLS rows
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    wanted = by_cell(asked, blocks.BLOCK)
    return wanted.select("cell", "part", *(F.col(c).alias(f"q_{c}") for c in ("ids", "n", "v")))


def by_cell(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of at most `size` rows of one cell and part."""
    together = rows.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return blocks.chunked(together, {"v": "double"}, size, ["cell", "part"])


def nearest_cells(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """q_id, cell of each query's n nearest cells."""
    centres = np.array([r["centre"] for r in index.cells.orderBy("cell").collect()])  # at most MOST_CELLS rows
    near = nearest(queries.sparkSession, centres, n)
    return queries.select(F.col("case_id").alias("q_id"), F.explode(near(unit(F.col("v")))).alias("cell"))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, case_id, score, rank: the k best by cosine among the rows of each query's nearest cells, self
    excluded. Codes are scored first, and the SHORTLIST * k best of a query anew on their vectors."""
    told = index.cells.select("probes", "low", "step").first()
    if told is None:
        return index.rows.sparkSession.createDataFrame([], "query_id long, case_id long, score double, rank int")
    low, step = np.array(told["low"], np.float32), np.array(told["step"], np.float32)
    found = index.codes.join(asked_cells(index, queries, nearest_cells(index, queries, probes or told["probes"])), ["cell", "part"])

    def scores(b: pa.RecordBatch, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, q_ids = blocks.flat(b["ids"], i), blocks.flat(b["q_ids"], i)
        q = blocks.unit_rows(blocks.flat(b["q_v"], i), len(q_ids)).astype(np.float32)
        code = np.frombuffer(b["codes"][i].as_buffer(), np.uint8).reshape(len(ids), -1)
        for at in range(0, len(ids), blocks.SLICE):
            made = (q * step) @ code[at : at + blocks.SLICE].T.astype(np.float32) + (q @ low)[:, None]
            yield made.astype(np.float64), ids[at : at + blocks.SLICE]

    near = blocks.top_k(found, SHORTLIST * k, scores).select("query_id", "case_id")
    both = near.join(index.rows.select("case_id", "v"), "case_id")
    both = both.join(queries.select(F.col("case_id").alias("q_id"), F.col("v").alias("q_v")), F.col("query_id") == F.col("q_id"))
    scored = both.select("query_id", "case_id", (F.round(cosine(F.col("q_v"), F.col("v")), 6) + 0.0).alias("score"))
    w = blocks.Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def beating_cells(index: Index, queries: DataFrame, kth: DataFrame, n: int) -> DataFrame:
    """q_id, cell beyond each query's n nearest cells that may hold a row of a score above kth(q_id, least)."""
    rows = index.cells.orderBy("cell").select("centre", "radius").collect()  # at most MOST_CELLS rows
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows])))

    @F.pandas_udf("array<int>")
    def beating(v: pd.Series, least: pd.Series) -> pd.Series:
        c, radius = shared.value
        out = []
        for at in range(0, len(v), AT_ONCE):
            u, low = np.stack(v.iloc[at : at + AT_ONCE].to_numpy()), least.iloc[at : at + AT_ONCE].to_numpy()
            gap = np.linalg.norm(u, axis=1)[:, None] ** 2 + (c**2).sum(axis=1) - 2 * u @ c.T
            order = np.argsort((c**2).sum(axis=1) / 2 - u @ c.T, axis=1, kind="stable")[:, :n]
            away = np.maximum(np.sqrt(np.maximum(gap, 0)) - radius, 0)
            may = 1 - away**2 / 2 >= low[:, None] - SLACK  # the score of a row so far away
            np.put_along_axis(may, order, False, axis=1)
            out += [np.flatnonzero(x).astype(np.int32) for x in may]
        return pd.Series(out, dtype=object)

    asked = queries.join(kth, F.col("case_id") == F.col("q_id"), "left")
    return asked.select(F.col("case_id").alias("q_id"), F.explode(beating(unit(F.col("v")), F.coalesce("least", F.lit(-2.0)))).alias("cell"))


def search_exactly(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, case_id, score, rank as exact search gives them; q_id, cell: the cells that were searched).
    Both have been written."""
    if index.cells.first() is None:
        return search(index, queries, k), index.rows.sparkSession.createDataFrame([], "q_id long, cell int")
    chunks = stash(by_cell(index.rows, blocks.CHUNK), "by-cell")
    n = min(FIRST, index.cells.count())
    first = nearest_cells(index, queries, n)
    found = stash(blocks.top_k(chunks.join(asked_cells(index, queries, first), ["cell", "part"]), k, blocks.dense_scores), "first-pass")
    kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("q_id"), F.col("score").alias("least"))
    second = stash(beating_cells(index, queries, kth, n), "second-cells")
    more = blocks.top_k(chunks.join(asked_cells(index, queries, second), ["cell", "part"]), k, blocks.dense_scores)
    w = blocks.Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
    both = found.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return stash(both, "found"), first.unionByName(second)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int | None = None, seed: int = 5) -> DataFrame:
    """Build and search at once."""
    return search(build(corpus, cells, seed), queries, k, probes)
