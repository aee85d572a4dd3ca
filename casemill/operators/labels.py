"""An inverted index of labels: compressed lists of case ids, merged in tasks.

A label's ids are cut into segments of 65,536 consecutive numbers, so that no label, however frequent, is
one row or one task. In a segment they are offsets in order, stored as differences of seven bits a byte:
a label that every second case has takes a byte a case. Union and intersection of labels are made segment
by segment, by joining the lists on their label and merging those that meet in (set, segment).

Defined results: null ids and null labels aren't indexed; a label that a case has twice counts once;
negative ids are in segments of their own; a set without labels, or with labels that no case has, has
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an id within its segment.
SEGMENT_BITS = 16


def encoded(offsets: np.ndarray) -> bytes:
    """Differences of ascending numbers, each as one to three bytes of seven bits, the last with its top bit set."""
    d = np.diff(offsets, prepend=0).astype(np.int64)
    size = 1 + (d >= 1 << 7) + (d >= 1 << 14)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(3):
        here = size > k
        out[ends[here] - 1 - k] = d[here] >> 7 * k & 127
    out[ends - 1] |= 128
    return out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(b & 128)
    first = np.r_[0, last[:-1] + 1][: len(last)]
    d = np.zeros(len(last), np.int64)
    for k in range(3):
        here = first + k <= last
        d[here] = d[here] << 7 | b[first[here] + k] & 127
    return np.cumsum(d)


def postings(cases: DataFrame, labels: str = "accusation") -> DataFrame:
    """label, segment, n, ids (encoded) of each label's cases in each segment."""
    rows = cases.filter("case_id is not null").select(F.col("case_id").cast("long").alias("id"), F.explode(F.array_distinct(F.array_compact(labels))).alias("label"))

    def lists(t: pa.Table) -> pa.Table:
        ids = np.unique(t["id"].to_numpy())
        return pa.table({"label": t["label"].slice(0, 1), "segment": t["segment"].slice(0, 1), "n": pa.array([len(ids)]), "ids": pa.array([encoded(ids & (1 << SEGMENT_BITS) - 1)], pa.binary())})

    cut = rows.withColumn("segment", F.shiftright("id", SEGMENT_BITS))
    return cut.groupBy("label", "segment").applyInArrow(lists, "label string, segment long, n long, ids binary")


def merged(sets: DataFrame, index: DataFrame, key: str, labels: str) -> DataFrame:
    """key, segment, of_any, of_all (encoded ids of the cases with any and with all of the labels), n_any
    and n_all, for each row of sets(key, labels) and each segment in which it has cases."""
    each = sets.select(F.col(key).alias("key"), F.array_distinct(F.array_compact(labels)).alias("labels"))
    asked = each.select("key", F.size("labels").alias("wanted"), F.explode("labels").alias("asked"))
    met = asked.join(index, F.col("asked") == F.col("label")).select("key", "wanted", "segment", "ids")

    def lists(t: pa.Table) -> pa.Table:
        ids, count = np.unique(np.concatenate([decoded(x) for x in t["ids"].to_pylist()]), return_counts=True)
        every = ids[count == t["wanted"][0].as_py()]
        return pa.table({"key": t["key"].slice(0, 1), "segment": t["segment"].slice(0, 1), "of_any": pa.array([encoded(ids)], pa.binary()), "of_all": pa.array([encoded(every)], pa.binary()), "n_any": pa.array([len(ids)]), "n_all": pa.array([len(every)])})

    kind = dict(sets.dtypes)[key]
    made = met.groupBy("key", "segment").applyInArrow(lists, f"key {kind}, segment long, of_any binary, of_all binary, n_any long, n_all long")
    return made.withColumnRenamed("key", key)


def listed(merged: DataFrame, key: str, which: str = "of_any") -> DataFrame:
    """key, case_id of the merged lists."""

    def run(batches):
        for b in batches:
            ids = [decoded(x) + (s << SEGMENT_BITS) for x, s in zip(b["ids"].to_pylist(), b["segment"].to_pylist(), strict=True)]
            n = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            yield pa.record_batch({"key": b["key"].take(pa.array(n)), "case_id": np.concatenate([np.zeros(0, np.int64), *ids])})

    kind = dict(merged.dtypes)[key]
    return merged.select(F.col(key).alias("key"), "segment", F.col(which).alias("ids")).mapInArrow(run, f"key {kind}, case_id long").withColumnRenamed("key", key)
