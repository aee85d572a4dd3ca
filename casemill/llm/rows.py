"""Joins and numbers for wide rows, whose texts aren't to be shuffled for a few matches.

A blocked Bloom filter of the keys, of bounded size, parts the rows where they are: those that can't
match go their way, and the exact join sees the others only. More keys than the filter can tell apart
make it pass more rows, and never lose one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, stash
from .url_filter import BITS_PER_KEY, MOST_BLOCKS, WORDS, bloom_blocks, hit_in_block

#: Keys for which the filter keeps its rate of false positives.
MOST_KEYS = MOST_BLOCKS * 32 * WORDS // BITS_PER_KEY
#: Rows that are equal in all that they are sorted by are dealt to so many parts of a range.
TURNS = 4096


class Sieve:
    """A Bloom filter of the distinct tuples of keys; with it, rows are told apart without a shuffle."""

    def __init__(self, keys: DataFrame):
        blocks, n_blocks = bloom_blocks(keys.select(F.xxhash64(*keys.columns).alias("key")), "key", min(keys.count(), MOST_KEYS))
        blocks = blocks.select(*(F.col(c).alias(f"__{c}") for c in blocks.columns))
        self.blocks, self.n_blocks = F.broadcast(blocks), n_blocks  # at most MOST_BLOCKS rows of nine numbers

    def _joined(self, rows: DataFrame, on: list[Column], how: str) -> DataFrame:
        key = F.when(F.greatest(*(c.isNull() for c in on), F.lit(False)), None).otherwise(F.xxhash64(*on))
        hit = F.col("__sieved").isNotNull() & hit_in_block(F.col("__sieved"), self.n_blocks, "__")
        return rows.withColumn("__sieved", key).join(self.blocks, hit, how).drop("__sieved")

    def passing(self, rows: DataFrame, *on: Column) -> DataFrame:
        """The rows whose key may be among the keys; of nulls, none is."""
        return self._joined(rows, list(on), "left_semi")

    def others(self, rows: DataFrame, *on: Column) -> DataFrame:
        return self._joined(rows, list(on), "left_anti")


def without(rows: DataFrame, on: dict[str, Column], keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among keys, which have been written; on: key's column -> rows' own.
    Rows go by the sieve but for its false positives, which are found by their keys alone."""
    sieve = Sieve(keys)
    kept = sieve.others(rows, *on.values())
    slim = sieve.passing(rows.select(*(c.alias(n) for n, c in on.items())), *(F.col(n) for n in on))
    wrong = stash(slim.distinct().join(keys, list(on), "left_anti"), "passed-wrongly")
    if not wrong.limit(1).count():
        return kept
    names = {n: f"__wrong_{n}" for n in on}
    back = Sieve(wrong).passing(sieve.passing(rows, *on.values()), *on.values())
    wrong = wrong.select(*(F.col(n).alias(o) for n, o in names.items()))
    same = [on[n] == F.col(o) for n, o in names.items()]
    return kept.unionByName(back.join(wrong, same, "left_semi"))


def placed(rows: DataFrame, keep: Scratch, *order: str) -> DataFrame:
    """rows with pos, their place in their grp by `order` from 0 on, and n, the rows of their grp.
    A sort over ranges: a grp of any size is spread over tasks, and only counts meet by grp."""
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(TURNS))
    dealt = rows.withColumn("turn", turn).repartitionByRange("grp", *order, "turn").sortWithinPartitions("grp", *order)
    dealt = keep(dealt.drop("turn").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "sorted")
    runs = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    w = Window.partitionBy("grp")  # a row for each part of a group
    before = F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    return dealt.join(keep(runs, "runs"), ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a number from 0 on that tells rows of one doc_id apart; a column of that name
    is replaced. It follows the texts' hashes, so it is the same whenever the table is read, but for rows
    of equal texts, which may be exchanged. Only rows that may share an id are written, and only their
    ids and hashes are sorted, over ranges: an id may hold any share of the rows."""
    docs = docs.drop("__row")
    ids = stash(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shared-ids")
    if not ids.limit(1).count():
        return docs.withColumn("__row", F.lit(0))
    sieve = Sieve(ids)
    shared = stash(sieve.passing(docs, docs["doc_id"]).withColumn("__uid", F.monotonically_increasing_id()), "shared-rows")
    with Scratch(docs.sparkSession) as keep:
        slim = shared.select(F.col("doc_id").alias("grp"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"), F.col("__uid").alias("uid"))
        number = stash(placed(keep(slim, "shared-hashes"), keep, "h", "s").select(F.col("uid").alias("__own"), F.col("pos").cast("int").alias("__row")), "row-numbers")
    shared = shared.join(number, F.col("__uid") == F.col("__own")).drop("__uid", "__own")
    return sieve.others(docs, docs["doc_id"]).withColumn("__row", F.lit(0)).unionByName(shared)
