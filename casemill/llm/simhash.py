"""SimHash near-duplicates (operator 9) by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a common point at most ceil(r / 2) bits from
each. So every distinct fingerprint emits all its variants within half the radius, the
variants are shuffled, and fingerprints that meet are compared. All that meet at a variant
within r / 2 lie within r of each other, so each is linked to the least of its meeting
point only: a group of n costs n links, not n * n / 2, and loses no component.

Defined results: a null, empty or blank text has fingerprint 0, linked like any other; a text
of fewer words than a shingle is one shingle; repeated rows have equal rows; rows with a null
doc_id get a fingerprint and, if they are alone in a component, a null component_id; no rows
give no rows. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ready, stash, utf8
from .components import components

SEED = 42
#: Shingle hashes whose bits are counted at once: 64 bytes each.
CHUNK = 1 << 15


def words(text: bytes) -> list[bytes]:
    """Maximal runs outside \\x20 and \\x09-\\x0D, with A-Z in lower case: on bytes,
    lower() and split() mean just that."""
    return text.lower().split()


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    w = words(text)
    if not w:
        return np.zeros(0, "<u8")
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([h(join(w[i : i + size]), SEED) for i in range(max(1, len(w) - size + 1))], "<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = [signed(majority(shingle_hashes(bytes(t), shingle))) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array(fp, np.int64)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8().alias("text")).mapInPandas(run, "doc_id string, fp long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def masks(radius: int, bits: int = 64) -> list[int]:
    """All patterns of at most ceil(radius / 2) bits."""
    return [signed(sum(1 << i for i in at)) for k in range((radius + 1) // 2 + 1) for at in combinations(range(bits), k)]


def variants(fp: Column, radius: int, bits: int = 64) -> Column:
    return F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks(radius, bits))), lambda m: m.bitwiseXOR(fp)))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): star links among distinct fp, each verified to be within the radius."""
    met = distinct.select("fp", variants(F.col("fp"), radius).alias("variant"))
    met = met.withColumn("a", F.min("fp").over(Window.partitionBy("variant"))).filter("a <> fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    return met.filter(near).select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that can be reached).

    An even radius is exact; an odd one would need the variants of r + 1.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    fps = stash(fingerprints(docs, shingle), "fingerprints")
    with Scratch(docs.sparkSession) as keep:
        classes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
        reached = components(links(classes.select("fp"), radius), keep)
        grouped = classes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        best = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        by_fp = stash(grouped.join(best, "component").select(F.col("fp").alias("__fp"), "component_id"), "components")
    return fps.join(by_fp, F.col("fp") == F.col("__fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
