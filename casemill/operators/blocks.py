"""Top-k search in blocks: chunks of the corpus meet blocks of the queries, as matrices in tasks.

Rows travel as chunks: one row for some thousand rows, with their numbers end to end. Chunks and
blocks are of bounded size. The corpus is dealt to parts of bounded size and the queries to groups;
each part meets each group by an equi-join on both, and blocks of queries are streamed past the part.
A block keeps its k best rows of the part, and a window merges those of all parts. Nothing goes
through the driver, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

#: Rows of a chunk of the corpus, and queries of a block.
CHUNK, BLOCK = 8_192, 512
#: Rows of a chunk that are multiplied with a block at once.
SLICE = 2_048
#: Numbers of the vectors of a part of the corpus, about; of one that is only made to occupy all cores; queries of a group.
PART, LEAST_PART, GROUP = 1 << 21, 1 << 18, 8_192
FOUND = "query_id long, case_id long, score double"


def ends(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


def list_of(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def cuts(b: pa.RecordBatch, keys: Sequence[str], size: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of at most `size` rows with equal keys."""
    starts = np.zeros(b.num_rows, bool)
    starts[:1] = True
    for c in keys:
        v = b[c].to_numpy()
        starts[1:] |= v[1:] != v[:-1]
    edges = [*np.flatnonzero(starts).tolist(), b.num_rows]
    for a, e in pairwise(edges):
        for at in range(a, e, size):
            yield at, min(at + size, e)


def chunked(rows: DataFrame, arrays: dict[str, str], size: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ids, n (the length of each row's arrays) and the arrays of rows(case_id, arrays), end to
    end: one row for at most `size` rows of a task that follow each other with equal keys (integers).
    arrays: name -> type of the elements."""
    first = next(iter(arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in cuts(b, keys, size):
                part = b.slice(at, to - at)
                one = ends([part.num_rows])
                out = {c: part[c].slice(0, 1) for c in keys} | {"ids": list_of(part["case_id"], one), "n": list_of(part[first].value_lengths().cast(pa.int32()), one)}
                for c in arrays:
                    flat = part[c].flatten()
                    out[c] = list_of(flat, ends([len(flat)]))
                yield pa.record_batch(out)

    schema = "".join(f"{c} int, " for c in keys) + "ids array<long>, n array<int>, " + ", ".join(f"{c} array<{kind}>" for c, kind in arrays.items())
    return rows.select(*keys, "case_id", *arrays).mapInArrow(run, schema)


def query_blocks(rows: DataFrame, arrays: dict[str, str], parts: int, size: int = BLOCK) -> DataFrame:
    """chunked() of the queries, once for each part; columns are prefixed by q_. A shuffle without a number
    of partitions, so adaptive execution gathers few queries into few blocks."""
    made = chunked(rows.repartition("case_id"), arrays, size)
    return made.select(*(F.col(c).alias(f"q_{c}") for c in made.columns), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))


class Best:
    """The k highest scores above `least` of each query of a block so far, ties by id; a query doesn't find itself."""

    def __init__(self, q_ids: np.ndarray, k: int, least: float):
        self.q_ids, self.k, self.least = q_ids, k, least
        self.kth = np.full(len(q_ids), -np.inf)
        self.held, self.waiting = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """of: the places of the queries that the scores are of; without it, all."""
        q_ids, kth = (self.q_ids, self.kth) if of is None else (self.q_ids[of], self.kth[of])
        mask = (scores > self.least) & (scores >= kth[:, None]) & (q_ids[:, None] != ids[None])
        if len(ids) > self.k and np.count_nonzero(mask) > 4 * self.k * len(q_ids):
            mask &= scores >= np.partition(np.where(mask, scores, -np.inf), len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
        q, c = np.nonzero(mask)
        self.held.append((q if of is None else of[q], ids[c], scores[q, c]))
        self.waiting += len(q)
        if 2 * self.waiting > self.k * len(self.q_ids):
            self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.kth[q[place == self.k - 1]] = scores[place == self.k - 1]
        keep = place < self.k
        self.held, self.waiting = [(q[keep], ids[keep], scores[keep])], 0

    def rows(self) -> pa.RecordBatch:
        self.cut()
        q, ids, scores = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.record_batch({"query_id": self.q_ids[q], "case_id": ids, "score": scores})


def flat(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy()


def unit_rows(v: np.ndarray, n: int) -> np.ndarray:
    m = v.reshape(n, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def dense_scores(b: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of the slices of a chunk, by cosine."""
    ids, q_ids = flat(b["ids"], k), flat(b["q_ids"], k)
    m, q = unit_rows(flat(b["v"], k), len(ids)), unit_rows(flat(b["q_v"], k), len(q_ids))
    for at in range(0, len(ids), SLICE):
        yield np.round(q @ m[at : at + SLICE].T, 6) + 0.0, ids[at : at + SLICE]


def top_k(pairs: DataFrame, k: int, scores: Callable, least: float = -np.inf) -> DataFrame:
    """query_id, case_id, score, rank of joined chunks and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for i in range(b.num_rows):
                q_ids = flat(b["q_ids"], i)
                if best is None or not np.array_equal(best.q_ids, q_ids):
                    if best:
                        yield best.rows()
                    best = Best(q_ids.copy(), k, least)
                for matrix, ids in scores(b, i):
                    best.add(matrix, ids)
        if best:
            yield best.rows()

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
    return pairs.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pieces(total: int, most: int, least: int, at_least: int) -> int:
    """How many pieces of `most` at most `total` makes; of `least` at most, up to `at_least` of them."""
    return max(1, -(-total // most), min(at_least, -(-total // least)))


def met(chunks: DataFrame, made: DataFrame, parts: int, groups: int) -> DataFrame:
    """The chunks of the corpus, in parts, beside the blocks of queries, in groups. A merge join on the pair of both:
    blocks are streamed past the chunks of one part. Their copies for all parts are more than their size
    tells Spark, so without the hint it would broadcast them."""
    dealt = lambda ids, n: F.pmod(F.xxhash64(F.get(ids, F.lit(0))), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = made.select(*(F.col(c).alias(f"q_{c}") for c in made.columns), dealt("ids", groups).cast("int").alias("q_group"), every(parts).alias("q_part"))
    held = chunks.select(*chunks.columns, dealt("ids", parts).cast("int").alias("part"), every(groups).alias("group"))
    return asked.join(held.hint("merge"), (F.col("q_part") == F.col("part")) & (F.col("q_group") == F.col("group")))


def exact_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, case_id, score, rank: exact cosine over (case_id, v), self excluded."""
    vector, cores = {"v": "double"}, corpus.sparkSession.sparkContext.defaultParallelism
    made = stash(chunked(queries.repartition("case_id"), vector, BLOCK), "query-blocks")
    asked = made.agg(F.sum(F.size("ids"))).first()[0] or 0
    numbers = corpus.agg(F.sum(F.size("v"))).first()[0] or 0
    return top_k(met(chunked(corpus, vector, CHUNK), made, pieces(numbers, PART, LEAST_PART, cores), pieces(asked, GROUP, GROUP, 1)), k, dense_scores)
