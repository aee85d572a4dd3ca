"""Exact top-k by integer inner product (operator 12) with MaxScore.

A dimension is a term, a row's entry there its impact, and a shard's postings of a term are the rows
with an entry other than zero. A term's bound is the most that it can add to a query's score in the
shard (0 if its impacts can only take away). With the k-th score known so far, a query's terms of
least bounds that together stay below it are non-essential: rows in none of the other terms'
postings can't be found. The essential postings are added up; then the other terms are probed, by
falling bound, for the rows that can still reach the k-th score. Shards' results are merged.

Rows are dealt to shards of about 4,096 by a hash, so a group of equal rows is spread; queries travel
in blocks to every shard, by an equi-join. The first shard's k-th scores are the others' start.

Defined results: rows whose key or vector is null, or whose vector holds null or non-finite
entries, take no part; an empty vector scores 0 with every row; entries beyond the end of a shorter
vector are 0; rows of one key are rows of their own, each a query and a candidate of the others;
ties go to the smaller key, then in any fixed order; fewer candidates than k are all given; empty
tables give no rows. A score must fit a long, else the search fails. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stash

#: Rows of a shard and queries of a block, about.
SHARD, BLOCK = 4_096, 256
FOUND = "quid long, query_id long, uid long, id long, score long"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def integers(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, x: floor(scale * entry) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    return rows.filter(F.col(key).isNotNull() & finite(v)).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def lists(b: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, end to end, and the lists' lengths."""
    c = b[name].combine_chunks() if isinstance(b, pa.Table) else b[name]
    return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False)


def one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def postings(t: pa.Table) -> pa.Table:
    """A shard's rows by term: starts (where each term's postings begin), docs and impacts."""
    x, n = lists(t, "x")
    row, term = np.repeat(np.arange(len(n)), n), np.arange(len(x)) - np.repeat(ends(n)[:-1], n)
    here = x != 0
    row, term, x = row[here], term[here], x[here]
    order = np.lexsort((row, term))
    starts = ends(np.bincount(term, minlength=int(n.max(initial=0))))
    ids, uids = t["id"].to_numpy(), t["uid"].to_numpy()
    return pa.table({"shard": t["shard"].slice(0, 1), "uids": one(uids, pa.int64()), "ids": one(ids, pa.int64()), "starts": one(starts, pa.int32()), "docs": one(row[order], pa.int32()), "impacts": one(x[order], pa.int64())})


POSTINGS = "shard int, uids array<long>, ids array<long>, starts array<int>, docs array<int>, impacts array<long>"


@dataclass
class Shard:
    uids: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray

    def __post_init__(self):
        terms = len(self.starts) - 1
        self.high, self.low = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        self.full: dict[int, np.ndarray] = {}  # the impacts of a term that half of the rows have, of all rows
        for t in range(terms):
            docs, v = self.of(t)
            self.high[t], self.low[t] = v.max(initial=0), v.min(initial=0)
            if 2 * len(docs) >= len(self.ids):
                self.full[t] = np.zeros(len(self.ids), np.int64)
                self.full[t][docs] = v

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.docs[at], self.impacts[at]

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows of the shard that reach `floor`, without the row `own`."""
        q = query[: len(self.high)]
        if len(q) and float(np.abs(q).max()) * float(max(self.high.max(), -self.low.min())) * len(q) >= 2.0**63:
            raise ValueError("a score may not fit a long")
        terms = np.flatnonzero(q)
        bounds = np.maximum(np.maximum(q * self.high[: len(q)], q * self.low[: len(q)]), 0)[terms]
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])  # what the terms from here on can add
        least = np.iinfo(np.int64).min if floor is None else floor
        split = int(np.argmax(rest < least)) if rest[-1] < least else len(terms)
        score, met = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), rest[-1] >= least)
        for t in terms[:split]:  # essential
            if t in self.full:
                score += q[t] * self.full[t]
                met |= self.full[t] != 0
            else:
                docs, impacts = self.of(t)
                score[docs] += q[t] * impacts
                met[docs] = True
        met &= self.uids != own
        at = np.flatnonzero(met & (score + rest[split] >= least))
        if split < len(terms) and len(at) > k:  # whole scores of the best so far raise the k-th score
            best = at[np.argpartition(-score[at], k - 1)[:k]]
            least = max(least, int(self.probe(q, terms[split:], best, score[best]).min()))
        partial = score[at]
        for i in range(split, len(terms)):
            keep = partial + rest[i] >= least
            at, partial = at[keep], partial[keep]
            partial = self.probe(q, terms[i : i + 1], at, partial)
        at, partial = at[partial >= least], partial[partial >= least]
        if len(at) > k:
            kth = -np.partition(-partial, k - 1)[k - 1]
            at, partial = at[partial >= kth], partial[partial >= kth]
            order = np.lexsort((self.uids[at], self.ids[at], -partial))[:k]
            at, partial = at[order], partial[order]
        return at, partial

    def probe(self, q: np.ndarray, terms: np.ndarray, at: np.ndarray, partial: np.ndarray) -> np.ndarray:
        """partial with what the terms add for the rows `at`."""
        partial = partial.copy()
        for t in terms:
            docs, impacts = self.of(t)
            if t in self.full:
                partial += q[t] * self.full[t][at]
            elif len(docs):
                place = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
                partial += q[t] * np.where(docs[place] == at, impacts[place], 0)
        return partial


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries end to end, a row for each block."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            x, n = lists(part, "x")
            yield pa.record_batch({"quids": one(part["uid"].to_numpy(), pa.int64()), "q_ids": one(part["id"].to_numpy(), pa.int64()), "q_n": one(n, pa.int32()), "q_x": one(x, pa.int64()), "floors": pa.array([part["floor"].to_pylist()], pa.list_(pa.int64()))})


def searched(index: DataFrame, queries: DataFrame, first: int, past: int, k: int) -> DataFrame:
    """FOUND of queries(uid, id, x, floor) in the shards from `first` to before `past`. A merge join that streams the
    blocks past one shard: their copies for all shards are more than their size tells Spark, so it would broadcast them."""
    made = queries.select("uid", "id", "x", "floor").mapInArrow(blocks, "quids array<long>, q_ids array<long>, q_n array<int>, q_x array<long>, floors array<long>")
    sent = made.withColumn("to", F.explode(F.sequence(F.lit(first), F.lit(past - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part = {n: b[n][r].values for n in b.schema.names if n not in ("shard", "to", "floors")}
                part = {n: v.to_numpy(zero_copy_only=False) for n, v in part.items()}
                shard, at = Shard(*(part[n] for n in ("uids", "ids", "starts", "docs", "impacts"))), ends(part["q_n"])
                quids, q_ids, rows, scores = [], [], [], []
                for i, (quid, floor) in enumerate(zip(part["quids"], b["floors"][r].as_py(), strict=True)):
                    places, found = shard.search(part["q_x"][at[i] : at[i + 1]], quid, k, floor)
                    rows.append(places)
                    scores.append(found)
                    quids.append(np.full(len(places), quid))
                    q_ids.append(np.full(len(places), part["q_ids"][i]))
                rows = np.concatenate(rows)
                yield pa.record_batch({"quid": np.concatenate(quids), "query_id": np.concatenate(q_ids), "uid": shard.uids[rows], "id": shard.ids[rows], "score": np.concatenate(scores)})

    return sent.join(index.hint("merge"), F.col("shard") == F.col("to")).mapInArrow(run, FOUND)


def top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, id, score: the k rows of highest inner product for each row(id, x array<long>)
    that is a query, itself excluded."""
    spark = ready(rows.sparkSession)
    rows = stash(rows.select("id", "x").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-rows.count() // SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    index = stash(dealt.groupBy("shard").applyInArrow(postings, POSTINGS), "postings")
    w = Window.partitionBy("quid").orderBy(F.desc("score"), "id", "uid")
    best = lambda found: found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    queries = rows.filter(is_query).withColumn("floor", F.lit(None).cast("long"))
    found = stash(searched(index, queries, 0, 1, k), "first-shard")
    if shards > 1:
        floors = best(found).filter(F.col("rank") == k).select(F.col("quid").alias("f_uid"), F.col("score").alias("f_score"))
        known = queries.join(floors, F.col("uid") == F.col("f_uid"), "left").withColumn("floor", F.col("f_score"))
        known = stash(known.select("uid", "id", "x", "floor"), "queries")
        found = found.unionByName(searched(index, known, 1, shards, k))
    return best(found).select("query_id", "rank", "id", "score")
