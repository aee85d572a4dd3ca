"""Line dedup (operator 8): an exact set-similarity join of lines; later matches are removed.

A line is the set of its distinct words (A-Z in lower case, split at \\x20 and \\x09-\\x0D).
A line goes if an earlier one, by (doc_id, row, line), has Jaccard similarity of at least the
threshold, equal sets included.

1. Word counts, in a fixed number of hash buckets, order each line's words by rarity. Any
   total order gives the same result; rarity only keeps the postings short.
2. Lines with equal sets become one, at its first place; only the first places are joined.
3. Two sets reach the threshold only if their prefixes, of n - ceil(t * n) + 1 of the rarest
   words, share one. Postings meet at the shared word; lengths, positions and the counts,
   modulo 16, of a line's words in CELLS cells of hashes (which differ by no more than the
   number of differing words) drop nearly all others.
4. A line proposes its nearest partner, by those counts. The pairs are verified on the texts.
   Lines without a true one propose their next TRIES partners, then more in each round, until
   one is true or none is left. So a group of n near copies costs n pairs, and no link is lost.

Postings travel in bundles: a row for each task and bucket of words. A word with more than
CELL_ROWS postings is dealt to cells of pairs of parts, so none meets in one task; no other
word is copied.

Defined results: a null text has no lines and stays null; lines without words stay; rows
with a null doc_id stay whole and match nothing; rows that share a doc_id are told apart by a
row number that follows their texts, and of equal rows the lines of one stay; columns beside
doc_id and text are passed on by remove_lines and aren't read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready, small, stash, utf8
from .hashing import by_eights, hashed, mixed, words_of
from .rows import Sieve, numbered

#: Buckets of words, by the leading bits of their hashes, that are counted for rarity, in slices.
BUCKET_BITS, SLICE = 20, 1 << 14
#: Cells of hashes in which a line's words are counted, 4 bits each.
CELLS = 32
#: Postings of one word that meet in a task.
CELL_ROWS = 20_000
#: Hot words that are told to all tasks; if there are more, the cells grow.
MOST_HOT = 1_000_000
#: Partners of a line that the second round tries; each later one tries eight times as many.
TRIES = 16
#: Words that are told to all tasks, to leave others out.
MOST_WORDS = 2_000_000
#: Postings that a task bundles at once, and those of one bucket on average.
FLUSH, BUCKET_POSTINGS = 60_000, 100_000
#: line: the place of a line in its row, and above LINE_BITS bits the number of the row among those of its doc_id.
LINE_BITS = 32
#: Bytes of a word's hash in a prefix. Words that share one only meet more often.
WORD_BYTES = 5
LINE_SCHEMA = "doc_id long, line long, key binary, size int, even long, odd long, hot int, prefix binary"
#: What a posting holds beside the word at which it meets others.
PARTS = {"doc_id": "<i8", "line": "<i8", "size": "<i8", "pos": "<i8", "even": "<u8", "odd": "<u8"}
#: The last partner that an open line has tried; far is -1 for lines that aren't open.
TRIED = {"far": "<i8", "last_doc": "<i8", "last_line": "<i8"}


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all of a's numbers, then the second ones, and so on: these compress well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()


def of_planes(data, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def fraction(threshold: float) -> Fraction:
    return Fraction(threshold).limit_denominator(1000)


def least_overlap(total, t: Fraction):
    """Words that two sets with `total` words together share at least, to reach t."""
    a, b = t.numerator, t.numerator + t.denominator
    return -(-a * total // b)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of words in each bucket; at most 2 ** BUCKET_BITS numbers."""

    def rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, x in enumerate(total.reshape(-1, SLICE)):
            if x.any():
                yield pa.record_batch({"slice": pa.array([k], pa.int64()), "n": pa.array([planes(x)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for _, _, h in words_of((x.as_buffer() for x in b["text"]), by_eights):
                np.add.at(total, h >> np.uint64(64 - BUCKET_BITS), 1)
        yield from rows(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for k, x in zip(b["slice"].to_pylist(), b["n"], strict=True):
                total[k * SLICE : (k + 1) * SLICE] += of_planes(x.as_buffer(), "<i8")
        yield from rows(total)

    parts = docs.select(utf8().alias("text")).mapInArrow(run, "slice long, n binary").repartition("slice").mapInArrow(added, "slice long, n binary")
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in parts.collect():  # at most 2 ** BUCKET_BITS numbers, as bytes
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = of_planes(r["n"], "<i8")
    return out


def whole_lines(texts, hashes=hashed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """words_of in batches that end at the ends of lines."""
    held: list[tuple[np.ndarray, ...]] = []
    for got in words_of(texts, hashes):
        text, line, _ = got
        if held and (text[-1], line[-1]) == (held[-1][0][-1], held[-1][1][-1]):
            held.append(got)
            continue
        text, line, h = (np.concatenate(x) for x in zip(*held, got, strict=True))
        keep = len(text) - int(np.argmax((text[::-1] != text[-1]) | (line[::-1] != line[-1])))
        if keep == len(text):
            held = [(text, line, h)]
            continue
        yield text[:keep], line[:keep], h[:keep]
        held = [(text[keep:], line[keep:], h[keep:])]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def binaries(data: np.ndarray, counts: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """An Arrow column of byte strings: data cut into pieces of counts bytes."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(counts), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def line_sets(doc: np.ndarray, row: np.ndarray, batch, counts: np.ndarray, rank: np.ndarray, t: Fraction, cell_rows: int) -> pa.RecordBatch:
    """A batch's lines with words, as line_rows gives them."""
    text, line, h = batch
    new_line = np.ones(len(h), bool)
    new_line[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    at = np.cumsum(new_line) - 1
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    code = at << 44 | rank[bucket].astype(np.int64) << 24 | (h & np.uint64(0xFFFFFF)).astype(np.int64)
    order = np.argsort(code)
    own, code = h[order], code[order]
    new, other = np.ones(len(own), bool), code[1:] != code[:-1]
    new[1:] = own[1:] != own[:-1]
    if (new[1:] & ~other).any():  # other words of one code
        own = own[np.lexsort((own, code))]
        new[1:] = own[1:] != own[:-1]
    new[1:] |= other
    h, at = own[new], code[new] >> 44  # each line's distinct words, the rarest first
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    size = np.diff(np.r_[starts, len(at)])
    keys = np.stack([np.add.reduceat(mixed(h, k), starts) for k in (0, 1)], axis=1)
    cell = np.repeat(np.arange(len(size)), size) * CELLS + (h & np.uint64(CELLS - 1)).astype(np.int64)
    count = (np.bincount(cell, minlength=len(size) * CELLS) & 15).astype(np.uint8).reshape(-1, CELLS)
    count = (count[:, 0::2] | count[:, 1::2] << 4).view("<i8")
    text, line = text[new_line], line[new_line]
    order = np.lexsort((keys[:, 1], keys[:, 0], text))  # stable: of equal sets of a text the first stays first
    again = np.zeros(len(order), bool)
    again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
    take = np.where(again, 0, size - -(-t.numerator * size // t.denominator) + 1)
    chosen = np.arange(len(h)) - np.repeat(starts, size) < np.repeat(take, size)
    prefix = h[chosen]
    often = np.zeros(len(h), np.int32)
    often[chosen] = counts[(prefix >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] > cell_rows
    prefix = prefix.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
    return pa.record_batch({
        "doc_id": doc[text], "line": row[text] << LINE_BITS | line, "key": binaries(keys[~again].astype(">u8").view(np.uint8), np.where(again, 0, 16), again),
        "size": size.astype(np.int32), "even": count[:, 0], "odd": count[:, 1],
        "hot": np.add.reduceat(often, starts, dtype=np.int32), "prefix": binaries(prefix, take * WORD_BYTES),
    })


def line_rows(docs: DataFrame, t: Fraction, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Of docs(doc_id, __row, text): a row for each line with words; key is null if the row has had the set before.
    hot: the words of the prefix, its last ones, whose bucket has more than cell_rows words."""
    counts = word_counts(docs)
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    known = docs.sparkSession.sparkContext.broadcast((np.minimum(counts, (1 << 32) - 1).astype(np.uint32), rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = b["doc_id"].to_numpy(), b["row"].to_numpy().astype(np.int64)
            for got in whole_lines((x.as_buffer() for x in b["text"]), by_eights):
                yield line_sets(doc, row, got, *known.value, t, cell_rows)

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row"), utf8().alias("text"))
    return rows.mapInArrow(run, LINE_SCHEMA)


def first_places(lines: DataFrame) -> DataFrame:
    """key, n, and the doc_id, line, size, even, odd, hot and prefix of each set's first place."""
    first = F.min(F.struct("doc_id", "line", "size", "even", "odd", "hot", "prefix")).alias("first")
    return lines.filter("key is not null").groupBy("key").agg(first, F.count("*").alias("n")).select("key", "n", "first.*")


def prefix_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each prefix, all words)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    n = np.diff(ends) // WORD_BYTES
    full = np.zeros((int(n.sum()), 8), np.uint8)
    if len(full):
        full[:, :WORD_BYTES] = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, WORD_BYTES)
    return n, full.view("<u8").ravel()


def hot_words(sets: DataFrame, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, in order, with more than cell_rows postings, the parts of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, word = prefix_words(b["prefix"])
            after = np.repeat(np.cumsum(n), n) - np.arange(len(word))
            word, count = np.unique(word[after <= np.repeat(b["hot"].to_numpy(), n)], return_counts=True)
            yield pa.record_batch({"word": word.view(np.int64), "n": count})

    rows = sets.filter("hot > 0").select("hot", "prefix").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    while (found := rows.filter(F.col("n") > cell_rows)).limit(MOST_HOT + 1).count() > MOST_HOT:
        cell_rows *= 4
    got = found.toArrow()  # at most MOST_HOT rows of two numbers
    word, n = got["word"].to_numpy().view("<u8"), got["n"].to_numpy()
    order = np.argsort(word)
    return word[order], -(-n[order] // cell_rows)


def bundled(sets: DataFrame, n_buckets: int, hot: Broadcast, wanted: Broadcast | None, names: dict[str, str]) -> DataFrame:
    """bucket and, as byte planes, the columns of its postings: one row for each task and bucket.
    wanted: what open_words gives, if only their postings are made."""

    def rows(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        all_of = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        bucket = (mixed(all_of["meet"], 5) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else order
        n = np.diff(np.r_[starts, len(order)])
        out = {"bucket": bucket[order[starts]]}
        for c, a in all_of.items():
            a = a[order]
            out[c] = pa.array([planes(a[s : s + k]) for s, k in zip(starts.tolist(), n.tolist(), strict=True)], pa.binary())
        return pa.record_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_word, parts = hot.value
        held, size = [], 0
        for b in batches:
            n, word = prefix_words(b["prefix"])
            if not len(word):
                continue
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if wanted is not None:
                keep = among(word, wanted.value)
                row, pos, word = row[keep], pos[keep], word[keep]
            if len(hot_word):
                at = np.minimum(np.searchsorted(hot_word, word), len(hot_word) - 1)
                k = np.where(hot_word[at] == word, parts[at], 1)
                place = b["doc_id"].to_numpy()[row] * 31 + b["line"].to_numpy()[row]
                own = (mixed(place.view(np.uint64), 6) % k.astype(np.uint64)).astype(np.int64)
                take = np.repeat(np.arange(len(row)), k)
                other, own = np.arange(len(take)) - np.repeat(np.cumsum(k) - k, k), own[take]
                cell = np.minimum(own, other) << 31 | np.maximum(own, other)
                word = np.where(k[take] > 1, mixed(word[take] + mixed(cell.view(np.uint64), 2), 7), word[take])
                row, pos = row[take], pos[take]
            got = {c: b[c].to_numpy().astype(kind, copy=False)[row] if c != "pos" else pos.astype(kind) for c, kind in names.items()}
            held.append({"meet": word} | got)
            size += len(row)
            if size >= FLUSH:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    made = sets.select(*(c for c in names if c != "pos"), "prefix").mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in ("meet", *names)))
    return made.repartition("bucket").sortWithinPartitions("bucket")


def unbundled(batches: Iterator[pa.RecordBatch], names: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """The postings of one bucket after another, from rows sorted by bucket."""
    kinds = {"meet": "<u8"} | names
    held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    last = None
    for b in batches:
        for k, bucket in enumerate(b["bucket"].to_pylist()):
            if last is not None and bucket != last:
                yield {c: np.concatenate(x) for c, x in held.items()}
                held = {c: [] for c in kinds}
            last = bucket
            for c, kind in kinds.items():
                held[c].append(of_planes(b[c][k].as_buffer(), kind))
    if last is not None:
        yield {c: np.concatenate(x) for c, x in held.items()}


def meeting(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The postings whose word has others, by word and size. age: their order by place; rest: words
    from the shared one on; count: the counts of the cells; first: where the word's postings begin."""
    order = np.lexsort((x["size"], x["meet"]))
    meet = x["meet"][order]
    same = meet[1:] == meet[:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]
    out = {c: a[order] for c, a in x.items()}
    n, meet = len(order), out["meet"]
    out["age"] = np.empty(n, np.int64)
    out["age"][np.lexsort((out["line"], out["doc_id"]))] = np.arange(n)
    count = np.stack([out["even"], out["odd"]], axis=1).view(np.uint8)
    out["count"] = np.concatenate([count & 15, count >> 4], axis=1)
    out["first"] = np.maximum.accumulate(np.where(np.r_[True, meet[1:] != meet[:-1]][:n], np.arange(n), 0))
    return out | {"rest": out["size"] - out["pos"]}


def compared(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, difference of the counts) of the pairs that may reach t."""
    total = x["size"][i] + x["size"][j]
    need = least_overlap(total, t)
    fits = np.minimum(x["rest"][i], x["rest"][j]) >= need
    i, j, most = i[fits], j[fits], (total - 2 * need)[fits]
    low = [np.bitwise_count((x[c][i] ^ x[c][j]) & LOWEST).astype(np.int64) for c in ("even", "odd")]
    fits = low[0] + low[1] <= most
    i, j, most = i[fits], j[fits], most[fits]
    far = ROUND[(x["count"][i] - x["count"][j]) & 15].sum(axis=1, dtype=np.int64)
    fits = far <= most
    return i[fits], j[fits], far[fits]


def near_pairs(x: dict[str, np.ndarray], t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, difference) of the pairs that may reach t, no later one twice in a turn: pairs
    (j - d, j) for d = 1, 2, ... of postings sorted by word and size."""
    size, age = x["size"], x["age"]
    depth = np.arange(len(size)) - x["first"]
    j, d = np.flatnonzero(depth > 0), 1
    while len(j):
        j = j[size[j - d] * t.denominator >= size[j] * t.numerator]
        a, b, far = compared(x, j - d, j, t)
        swap = age[a] > age[b]
        for turn, late, early in ((~swap, b, a), (swap, a, b)):
            if turn.any():
                yield late[turn], early[turn], far[turn]
        d += 1
        j = j[depth[j] >= d]


#: The lowest bit of each count, and the least difference of two numbers by their difference modulo 16.
LOWEST, ROUND = np.uint64(0x1111111111111111), np.minimum(np.arange(16), 16 - np.arange(16)).astype(np.uint8)
PAIR_SCHEMA = "j_doc long, j_line long, far long, i_doc long, i_line long, more boolean"


def pair_rows(x: dict[str, np.ndarray], late: np.ndarray, early: np.ndarray, far: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    doc, line = x["doc_id"], x["line"]
    return pa.record_batch({"j_doc": doc[late], "j_line": line[late], "far": far, "i_doc": doc[early], "i_line": line[early], "more": more})


def nearest(x: dict[str, np.ndarray], t: Fraction) -> pa.RecordBatch:
    """For each posting the nearest earlier one at its word, of equally near ones the first by place;
    more: whether there are others."""
    x = meeting(x)
    n = len(x["meet"])
    none = np.iinfo(np.int64).max
    best, count = np.full(n, none), np.zeros(n, np.int64)
    for late, early, far in near_pairs(x, t):
        best[late] = np.minimum(best[late], far * n + x["age"][early])
        count[late] += 1
    late = np.flatnonzero(count)
    early = np.argsort(x["age"])[best[late] % max(n, 1)]
    return pair_rows(x, late, early, best[late] // max(n, 1), count[late] > 1)


def next_nearest(x: dict[str, np.ndarray], t: Fraction, tries: int) -> pa.RecordBatch:
    """For each open posting the nearest `tries` earlier ones after the last that its line has tried."""
    x = meeting(x)
    n, first, age = len(x["meet"]), x["first"], x["age"]
    end = np.searchsorted(first, first, "right")
    found, more = [np.zeros((3, 0), np.int64)], np.zeros(n, bool)
    for k in np.flatnonzero(x["far"] >= 0).tolist():
        i = np.arange(first[k], end[k])
        i = i[age[i] < age[k]]
        low, high = np.minimum(x["size"][i], x["size"][k]), np.maximum(x["size"][i], x["size"][k])
        i = i[low * t.denominator >= high * t.numerator]
        i, _, far = compared(x, i, np.full(len(i), k), t)
        doc, line, last_doc = x["doc_id"][i], x["line"][i], x["last_doc"][k]
        new = (far > x["far"][k]) | (far == x["far"][k]) & ((doc > last_doc) | (doc == last_doc) & (line > x["last_line"][k]))
        i, far = i[new], far[new]
        order = np.lexsort((age[i], far))
        more[k] = len(order) > tries
        order = order[:tries]
        found.append(np.stack([np.full(len(order), k), i[order], far[order]]))
    late, early, far = np.concatenate(found, axis=1)
    return pair_rows(x, late, early, far, more[late])


def _reaches(t: Fraction):
    """A UDF on two lines' bytes: whether their word sets reach t."""

    @F.pandas_udf("boolean")
    def reaches(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = set(bytes(x).lower().split()), set(bytes(y).lower().split())
            shared = len(a & b)
            out.append(shared * t.denominator >= (len(a) + len(b) - shared) * t.numerator)
        return pd.Series(out, dtype=bool)

    return reaches


def row_of(line: str) -> Column:
    return F.shiftright(F.col(line), LINE_BITS).cast("int")


def place_of(line: str) -> Column:
    return F.col(line).bitwiseAND((1 << LINE_BITS) - 1).cast("int")


def verified(pairs: DataFrame, docs: DataFrame, t: Fraction, keep: Scratch) -> DataFrame:
    """(j_doc, j_line) of the pairs (i_doc, i_line, j_doc, j_line) whose texts reach t."""
    ends = pairs.select(F.col("i_doc").alias("d"), F.col("i_line").alias("l")).union(pairs.select("j_doc", "j_line")).distinct()
    ends = keep(ends, "pair-places")
    own = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("d"), "__row", "text")
    own = Sieve(ends.select("d", row_of("l").alias("r")).distinct()).passing(own, F.col("d"), F.col("__row"))
    split = own.select("d", "__row", F.posexplode(F.split("text", "\n")).alias("place", "w"))
    code = F.shiftleft(F.col("__row").cast("long"), LINE_BITS).bitwiseOR(F.col("place").cast("long"))
    texts = Sieve(ends).passing(split.select("d", code.alias("l"), F.col("w").cast("binary").alias("w")), F.col("d"), F.col("l"))
    texts = keep(texts, "pair-lines")  # with some more lines, which no pair has
    a, b = texts.select(F.col("d").alias("i_doc"), F.col("l").alias("i_line"), F.col("w").alias("wi")), texts.select(F.col("d").alias("j_doc"), F.col("l").alias("j_line"), F.col("w").alias("wj"))
    both = pairs.select("i_doc", "i_line", "j_doc", "j_line").join(a, ["i_doc", "i_line"]).join(b, ["j_doc", "j_line"])
    return keep(both.filter(_reaches(t)("wi", "wj")).select("j_doc", "j_line").distinct(), "line-matches")


def similar_sets(sets: DataFrame, docs: DataFrame, t: Fraction, keep: Scratch, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, line of the first places that have an earlier match."""
    spark = sets.sparkSession
    postings = sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
    n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), postings // WORD_BYTES // BUCKET_POSTINGS)
    hot = spark.sparkContext.broadcast(hot_words(sets, cell_rows))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in unbundled(batches, PARTS):
            yield nearest(x, t)

    near = F.min(F.struct("far", "i_doc", "i_line")).alias("best")
    others = (F.max("more") | (F.min(F.struct("i_doc", "i_line")) != F.max(F.struct("i_doc", "i_line")))).alias("more")
    tried = bundled(sets, n_buckets, hot, None, PARTS).mapInArrow(one, PAIR_SCHEMA).groupBy("j_doc", "j_line").agg(near, others)
    tried = keep(tried.select("j_doc", "j_line", "best.*", "more"), "line-pairs")
    good, tries = verified(tried, docs, t, keep), TRIES
    still = tried.filter("more")
    last, names = good, PARTS | TRIED
    while True:
        still = keep(still.join(last, ["j_doc", "j_line"], "left_anti"), "line-open")
        n = still.count()
        if not n:
            return good.select(F.col("j_doc").alias("doc_id"), F.col("j_line").alias("line"))
        state = still.select(F.col("j_doc").alias("doc_id"), F.col("j_line").alias("line"), "far", F.col("i_doc").alias("last_doc"), F.col("i_line").alias("last_line"))
        wanted = open_words(sets.join(small(state, n), ["doc_id", "line"], "left_semi"))
        if wanted is not None:  # later rounds have fewer open lines, hence none but these sets to meet
            sets = keep(having(sets, wanted), "line-sets")
        marked = sets.join(small(state, n), ["doc_id", "line"], "left").withColumn("far", F.coalesce("far", F.lit(-1))).fillna(0, ["last_doc", "last_line"])

        def more(batches: Iterator[pa.RecordBatch], tries: int = tries) -> Iterator[pa.RecordBatch]:
            for x in unbundled(batches, names):
                yield next_nearest(x, t, tries)

        found = bundled(marked, n_buckets, hot, wanted, names).mapInArrow(more, PAIR_SCHEMA)
        each = found.groupBy("j_doc", "j_line").agg(F.array_sort(F.collect_set(F.struct("far", "i_doc", "i_line"))).alias("all"), F.max("more").alias("more"))
        end = F.least(F.size("all"), F.lit(tries))
        each = keep(each.select("j_doc", "j_line", F.slice("all", F.lit(1), end).alias("all"), (F.col("more") | (F.size("all") > tries)).alias("more")), "line-pairs")
        last = verified(each.select("j_doc", "j_line", F.explode("all").alias("p")).select("j_doc", "j_line", "p.*"), docs, t, keep)
        good = good.unionByName(last)
        still = each.filter("more").select("j_doc", "j_line", F.element_at("all", -1).alias("p")).select("j_doc", "j_line", "p.*")
        tries *= 8


def open_words(sets: DataFrame) -> Broadcast | None:
    """(words of the sets, in order, and which values of their last bits they have), or none if they are too many to tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"word": np.unique(prefix_words(b["prefix"])[1]).view(np.int64)})

    words = sets.select("prefix").mapInArrow(run, "word long").distinct().limit(MOST_WORDS + 1).toArrow()["word"].to_numpy()
    if len(words) > MOST_WORDS or not len(words):
        return None
    bits = np.zeros(1 << 22, bool)
    bits[words & len(bits) - 1] = True
    return sets.sparkSession.sparkContext.broadcast((np.sort(words.view("<u8")), bits))


def among(word: np.ndarray, wanted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each word is one of open_words."""
    words, bits = wanted
    out = bits[word & np.uint64(len(bits) - 1)]
    at = np.flatnonzero(out)
    out[at] = words[np.minimum(np.searchsorted(words, word[at]), len(words) - 1)] == word[at]
    return out


def having(sets: DataFrame, wanted: Broadcast) -> DataFrame:
    """The sets whose prefixes have one of open_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, word = prefix_words(b["prefix"])
            if len(word):
                hits = np.r_[0, np.cumsum(among(word, wanted.value))][np.r_[0, np.cumsum(n)]]
                yield b.filter(pa.array(np.diff(hits) > 0))

    return sets.mapInArrow(run, sets.schema)


def removed_lines(docs: DataFrame, threshold: float = 0.8, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, row, removed: the places (from 0) of the lines that go, for rows that lose any.
    row is the number that `numbered` gives."""
    return _removed(numbered(docs), threshold, cell_rows)


def _removed(docs: DataFrame, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """removed_lines of docs that have their __row."""
    spark = ready(docs.sparkSession)
    t = fraction(threshold)
    with Scratch(spark) as keep:
        lines = keep(line_rows(docs, t, cell_rows), "lines")
        sets = keep(first_places(lines), "line-sets")
        matched = similar_sets(sets.drop("key", "n"), docs, t, keep, cell_rows).withColumn("matched", F.lit(True))
        judged = sets.select("key", "n", "doc_id", "line").join(matched, ["doc_id", "line"], "left").filter("matched or n > 1")
        judged = judged.select(F.col("key").alias("k"), F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"), F.coalesce("matched", F.lit(False)).alias("matched"))
        gone = lines.filter("key is not null").select("key", "doc_id", "line").join(judged, F.col("key") == F.col("k"))
        gone = gone.filter("matched or doc_id <> first_doc or line <> first_line")
        gone = gone.select("doc_id", "line").unionByName(lines.filter("key is null").select("doc_id", "line"))
        return stash(gone.groupBy("doc_id", row_of("line").alias("row")).agg(F.collect_set(place_of("line")).alias("removed")), "removed-lines")


def _rewritten(docs: DataFrame, threshold: float) -> DataFrame:
    """docs with __rest, the remaining lines, and __gone, the places of the others or null."""
    docs = numbered(docs)
    gone = _removed(docs, threshold).select(F.col("doc_id").alias("__gone_id"), F.col("row").alias("__gone_row"), F.col("removed").alias("__gone"))
    sieve, own = Sieve(gone.select("__gone_id", "__gone_row")), (F.col("doc_id").cast("long"), F.col("__row"))
    # by one plan at every size: a hash of the places in each partition, so that texts aren't sorted
    joined = sieve.passing(docs, *own).join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("__gone_id")) & (F.col("__row") == F.col("__gone_row")), "left")
    joined = joined.unionByName(sieve.others(docs, *own), allowMissingColumns=True)
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    rest = F.array_join(F.transform(places, lambda k: F.get("__lines", k)), "\n")
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    return joined.withColumn("__rest", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest)).drop("__lines")


def remove_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with the remaining lines as text; its columns and their order stay."""
    made = _rewritten(docs, threshold)
    return made.select(*(F.col("__rest").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text (what remains), n_lines, n_removed for every document."""
    made = _rewritten(docs.select("doc_id", "text"), threshold)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return made.select("doc_id", F.col("__rest").alias("text"), n.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"))
