"""Sparse top-k over an inverted index, with bounds that let blocks of rows be skipped.

The rows are dealt to shards of about 16,384. A shard orders its rows by their heaviest dimensions, so
that rows of like content stand together, and cuts them into blocks of 64. Its index holds the
postings of each dimension (rows and weights) and the greatest weight of each dimension in each block.
A query's weights times these bound the score of every row of a block: blocks are taken by falling
bound, a few at a time, until the k-th score found is above what is left. So the result is exact. A
shard of few dimensions is a matrix, and blocks of it are multiplied with all queries that need them.
The index is written once; queries travel in blocks and meet the shards by an equi-join.

Defined results: weights must not be negative; scores are rounded to six places, those above 0 are
given, ties go to the smaller case_id; a row doesn't find itself; rows without dimensions find
nothing; dimensions that no row has add nothing; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks

#: Rows of a shard, rows of a block of it, and blocks that a query takes at a time.
SHARD, BLOCK, STEP = 16_384, 64, 8
#: Cells of the matrix that a shard of few dimensions is made: at most 64 MB.
CELLS = 1 << 23
#: Places to which scores are rounded; two bounds further apart than this differ in their scores too.
PLACES, SLACK = 6, 1e-6
ARRAYS = {"dims": "long", "weights": "double"}
INDEX = "part int, ids array<long>, dims array<long>, starts array<int>, rows array<int>, weights array<double>, group_starts array<int>, group_block array<int>, group_first array<int>, group_most array<double>"
FOUND = blocks.FOUND + ", scored long"


def flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def ordered(n: np.ndarray, dims: np.ndarray, weights: np.ndarray, depth: int = 4) -> np.ndarray:
    """The order of rows (n entries each, end to end) by their heaviest dimensions."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((dims, -weights, row))
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    keys = np.full((depth, len(n)), np.iinfo(np.int64).max)
    for d in range(depth):
        at = order[place == d]
        keys[d, row[at]] = dims[at]
    return np.lexsort(keys[::-1])


def shard_index(t: pa.Table) -> pa.Table:
    """A shard's rows as INDEX, one row."""
    ids, n = t["case_id"].to_numpy(), t["dims"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    dims, weights = flat(t, "dims"), flat(t, "weights")
    order = ordered(n, dims, weights)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    known, dim = np.unique(dims, return_inverse=True)
    row = place[np.repeat(np.arange(len(n)), n)]
    by = np.lexsort((row, dim))
    dim, row, weights = dim[by], row[by], weights[by]
    block = row // BLOCK
    first = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (block[1:] != block[:-1])][: len(dim)])
    most = np.maximum.reduceat(weights, first) if len(first) else weights
    ends = lambda of: np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(known)))])
    one = lambda values, kind: pa.array([np.asarray(values)], pa.list_(kind))
    return pa.table({
        "part": t["part"].slice(0, 1), "ids": one(ids[order], pa.int64()), "dims": one(known, pa.int64()), "starts": one(ends(dim), pa.int32()), "rows": one(row, pa.int32()), "weights": one(weights, pa.float64()),
        "group_starts": one(ends(dim[first]), pa.int32()), "group_block": one(block[first], pa.int32()), "group_first": one(np.r_[first, len(dim)], pa.int32()), "group_most": one(most, pa.float64()),
    })


def build(rows: DataFrame) -> DataFrame:
    """The index of rows(case_id, dims array<long>, weights array<double>), a row for each shard."""
    shards = max(1, -(-rows.count() // SHARD))
    dealt = rows.select("case_id", "dims", "weights", F.pmod(F.xxhash64("case_id"), F.lit(shards)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInArrow(shard_index, INDEX)


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the ranges, their members), end to end."""
    n = (end - begin).astype(np.int64)
    which = np.repeat(np.arange(len(n)), n)
    return which, begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Shard:
    """rows, weights: the postings of each of dims, from starts on; groups: the postings of a dimension
    in one block, with their block, first posting and greatest weight."""

    ids: np.ndarray
    dims: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    group_starts: np.ndarray
    group_block: np.ndarray
    group_first: np.ndarray
    group_most: np.ndarray

    def search(self, dims: np.ndarray, weights: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, rows scored): the k best rows with a score above 0, without the row `own`."""
        at = np.minimum(np.searchsorted(self.dims, dims), max(len(self.dims) - 1, 0))
        here = self.dims[at] == dims if len(self.dims) else np.zeros(len(dims), bool)
        at, weights = at[here], weights[here]
        n_blocks = -(-len(self.ids) // BLOCK)
        dim, group = ranges(self.group_starts[at], self.group_starts[at + 1])
        weight, block = weights[dim], self.group_block[group]
        bound = np.bincount(block, weight * self.group_most[group], n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        held, scores, done, step, kth = np.zeros(0, np.int64), np.zeros(0), 0, STEP, 0.0
        while done < len(order) and not (len(held) >= k and bound[order[done]] < kth - SLACK):
            place = np.full(n_blocks, -1)
            take = order[done : done + step]
            place[take] = np.arange(len(take))
            mine = np.flatnonzero(place[block] >= 0)
            which, posting = ranges(self.group_first[group[mine]], self.group_first[group[mine] + 1])
            to = place[block[mine]][which] * BLOCK + self.rows[posting] % BLOCK
            sums = np.round(np.bincount(to, weight[mine][which] * self.weights[posting], len(take) * BLOCK), PLACES)
            at = np.flatnonzero(sums > 0)
            row = take[at // BLOCK] * BLOCK + at % BLOCK
            keep = self.ids[row] != own
            held, scores = np.concatenate([held, row[keep]]), np.concatenate([scores, sums[at][keep]])
            best = np.lexsort((self.ids[held], -scores))[:k]
            held, scores = held[best], scores[best]
            kth, done, step = (scores[-1] if len(held) >= k else 0.0), done + len(take), 2 * step
        return self.ids[held], scores, int(np.minimum(BLOCK, len(self.ids) - order[:done] * BLOCK).sum())


class Cells:
    """A shard of few dimensions as a matrix of rows by dimensions, for blocks of queries. As in Shard.search, each query
    takes STEP blocks of the highest bounds first, then those whose bound reaches its k-th score."""

    def __init__(self, shard: Shard):
        self.shard, n, d = shard, len(shard.ids), len(shard.dims)
        self.blocks = -(-n // BLOCK)
        self.x = np.zeros((self.blocks * BLOCK, d))
        np.add.at(self.x, (shard.rows, np.repeat(np.arange(d), np.diff(shard.starts))), shard.weights)
        self.x = self.x.reshape(self.blocks, BLOCK, d)
        self.most = self.x.max(axis=1, initial=0)
        self.size = np.minimum(BLOCK, n - np.arange(self.blocks) * BLOCK)

    @staticmethod
    def fits(shard: Shard) -> bool:
        return len(shard.ids) * len(shard.dims) <= CELLS

    def search(self, q_ids: np.ndarray, ends: np.ndarray, dims: np.ndarray, weights: np.ndarray, k: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """(the k best rows of each query as blocks.Best gives them, the rows scored for each query)."""
        best, known = blocks.Best(q_ids, k, 0.0), self.shard.dims
        at = np.minimum(np.searchsorted(known, dims), max(len(known) - 1, 0))
        here = known[at] == dims if len(known) else np.zeros(len(dims), bool)
        q = np.zeros((len(q_ids), len(known)))
        np.add.at(q, (np.repeat(np.arange(len(q_ids)), np.diff(ends))[here], at[here]), weights[here])
        bound = q @ self.most.T
        left = bound > 0
        if self.blocks > STEP:  # each query's own blocks, for a first k-th score
            first = np.argpartition(-bound, STEP - 1, axis=1)[:, :STEP]
            for i in np.flatnonzero(left.any(axis=1)):
                rows = (first[i][:, None] * BLOCK + np.arange(BLOCK)).ravel()
                rows = rows[rows < len(self.shard.ids)]
                scores = np.round(self.x.reshape(-1, len(known))[rows] @ q[i], PLACES)
                best.add(scores[None], self.shard.ids[rows], np.array([i]))
            best.cut()
            scored = (left[np.arange(len(q))[:, None], first] * self.size[first]).sum(axis=1)
            np.put_along_axis(left, first, False, axis=1)
        else:
            scored = np.zeros(len(q), np.int64)
        for b in np.argsort(-bound.sum(axis=0), kind="stable"):
            of = np.flatnonzero(left[:, b] & (bound[:, b] >= best.kth - SLACK))
            if len(of):
                scored[of] += self.size[b]
                scores = np.round(q[of] @ self.x[b, : self.size[b]].T, PLACES)
                best.add(scores, self.shard.ids[b * BLOCK : (b + 1) * BLOCK], of)
        return best.rows(), scored


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, case_id, score, rank of queries(case_id, dims, weights), and scored: the rows of the
    corpus, over all shards, that were scored for the query."""
    spark: SparkSession = queries.sparkSession
    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    asked = blocks.query_blocks(queries, ARRAYS, parts).withColumnRenamed("part", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part = {c: blocks.flat(b[c], r) for c in b.schema.names if c not in ("part", "to")}
                shard = Shard(*(part[f.name] for f in fields(Shard)))
                ends, out = blocks.ends(part["q_n"]), []
                if Cells.fits(shard):
                    found, scored = Cells(shard).search(part["q_ids"], ends, part["q_dims"], part["q_weights"], k)
                    n = found.num_rows
                    case_ids = pa.concat_arrays([found["case_id"], pa.nulls(len(scored), pa.int64())])
                    yield pa.record_batch({"query_id": np.r_[found["query_id"].to_numpy(), part["q_ids"]], "case_id": case_ids, "score": np.r_[found["score"].to_numpy(), np.full(len(scored), -1.0)], "scored": np.r_[np.zeros(n, np.int64), scored]})
                    continue
                for i, own in enumerate(part["q_ids"].tolist()):
                    s = slice(ends[i], ends[i + 1])
                    ids, scores, scored = shard.search(part["q_dims"][s], part["q_weights"][s], own, k)
                    out.append((np.full(len(ids) + 1, own), np.r_[ids, -1], np.r_[scores, -1.0], np.r_[np.zeros(len(ids), np.int64), scored]))
                if out:
                    q, c, score, scored = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.record_batch({"query_id": q, "case_id": pa.array(c, mask=score < 0), "score": score, "scored": scored})

    # blocks are streamed past one shard; their copies for all shards are more than their size tells Spark
    found = asked.join(index.hint("merge"), F.col("part") == F.col("to")).mapInArrow(run, FOUND)
    w = Window.partitionBy("query_id")
    best = found.withColumn("scored", F.sum("scored").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "case_id")))
    return best.filter((F.col("rank") <= k) & F.col("case_id").isNotNull()).select("query_id", "case_id", "score", "rank", "scored")
