"""Best-fit packing (operator 10), method best-two-fit.

A bin is filled greedily, largest fitting piece first. Then its smallest piece is replaced by
two unpacked pieces if they fit the gap, widened by that piece, more tightly.

Whole windows (pieces of exactly the capacity) are sequences of their own. All other pieces
are dealt at random into groups of about GROUP_PIECES, each packed in one task, so no task
grows with the input and each group has the same mixture of lengths; at most a bin or so of
each group stays part empty.

Defined results: a null or empty text is the end token alone; a null doc_id packs like any
other; repeated rows are pieces of their own; no rows give no sequences. Columns beside
doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stash, utf8
from .tokens import Ids

GROUP_PIECES = 20_000
PIECE_SCHEMA = "doc_id string, piece int, start long, length long, ids_crc32 long, uid long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into lengths, each of at most capacity.

    Pieces wait in one stack for each length; `have` is an integer whose bit L is set while a
    piece of length L waits, so the largest that fits is one bit operation away.
    """
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[i], []).append(i)
    have = 0
    for length in waiting:
        have |= 1 << length

    def take(length: int) -> int:
        nonlocal have
        own = waiting[length]
        i = own.pop()
        if not own:
            have &= ~(1 << length)
        return i

    def give(length: int, i: int) -> None:
        nonlocal have
        waiting[length].append(i)
        have |= 1 << length

    bins = []
    while have:
        room, inside = capacity, []
        while fits := have & ((2 << room) - 1):
            length = fits.bit_length() - 1
            inside.append(take(length))
            room -= length
            if length == 0:
                break
        if room and have:
            smallest = lengths[inside[-1]]
            wide = room + smallest
            best, pair = smallest, None
            rest = have & ((2 << wide) - 1)
            while rest and best < wide:
                a = rest.bit_length() - 1
                if 2 * a < best:
                    break
                partner = have & ((2 << min(a, wide - a)) - 1)
                b = partner.bit_length() - 1
                if b == a and len(waiting[a]) < 2:
                    b = (partner & ~(1 << a)).bit_length() - 1
                if b >= 0 and a + b > best:
                    best, pair = a + b, (a, b)
                rest &= ~(1 << a)
            if pair:
                i = inside.pop()
                inside += [take(pair[0]), take(pair[1])]
                give(smallest, i)
        bins.append(inside)
    return bins


def pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """Every document's pieces: ids by the library, then id 0 at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Ids.of(vocabulary).encode
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                raw = encode(bytes(text).decode("utf-8", "replace")).tobytes() + bytes(4)
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append((doc_id, k, s, n, zlib.crc32(memoryview(raw)[4 * s : 4 * (s + n)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8().alias("text")).mapInPandas(run, PIECE_SCHEMA.rpartition(",")[0])
    return stash(made.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    ready(docs.sparkSession)
    made = pieces(docs, capacity, vocabulary)
    part = made.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows["length"].tolist()
        for k, inside in enumerate(pack(lengths, capacity)):
            at = 0
            for i in inside:
                sequence[i], offset[i], at = k, at, at + lengths[i]
        return rows.assign(sequence_id=sequence * 2 * groups + 2 * int(key[0]), offset=offset)

    packed = part.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("group").applyInPandas(run, f"{PIECE_SCHEMA}, group long, sequence_id long, offset long")
    whole = made.filter(F.col("length") >= capacity).select("*", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    names = [F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return packed.select(*names).unionByName(whole.select(*names))
