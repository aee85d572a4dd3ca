"""Near-duplicate documents for the pipeline: SimHash ball hashing, verified on shingles.

Documents are near-duplicates if the Jaccard similarity of their sets of five-word shingles
is at least 0.8. One 64-bit fingerprint of the shingles differs in 5 to 10 bits for such
pairs, beyond any ball that can be emitted. So the ball hashing of `simhash` runs on TABLES
independent fingerprints of BITS bits of the distinct words, which differ in about 2 bits:
each distinct fingerprint of a table emits all its variants within one bit, and those that
meet are linked to the least. An added block of other words changes up to a sixth of the
distinct words, and more bits than that. So texts also meet that have an equal band of minimum
hashes of their shingles: with BANDS bands of ROWS, a pair of similarity 0.8 shares one with a
probability of 0.995, whatever the edit and the length. Candidates must also have near shingle
fingerprints, and are verified on their full shingle sets.

Documents that share a fingerprint are first proposed to the least and the greatest id of their
class, and classes that meet to the least code, so n documents cost 2 n candidates. That
finds all but those that are near to some member and not to these. So where documents of one
class or meeting point are still in different components, those outside its most frequent
component are open: they are proposed to PIVOTS random open members in turn, and at last to
every member of another component, in cells of CELL_ROWS. No pair of a class or meeting point
is left out then.

Defined results: texts with equal word sequences (A-Z in lower case) are copies, those
without words too; a text of fewer than five words is one shingle; of repeated rows one
stays, and rows that share a doc_id are documents of their own; rows with a null doc_id stay; all columns are passed on; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ready, stash, utf8
from .components import components
from .hashing import mixed, powers, words_of
from .rows import Sieve, numbered, without
from .simhash import majority, masks, signed

SHINGLE, THRESHOLD = 5, 0.8
TABLES, BITS = 6, 32
#: Bands of minimum hashes of the shingles, and hashes of one band.
BANDS, ROWS = 10, 4
#: Shingles whose hashes are permuted at once: 8 * BANDS * ROWS bytes each.
CHUNK = 1 << 12
#: Bits in which the 64-bit shingle fingerprints of a pair may differ.
NEAR = 22
#: Rounds in which open documents meet two members each, before they meet all.
PIVOTS = 2
#: Open documents of one class or meeting point that meet its members in one task.
CELL_ROWS = 2000


def word_hashes(texts: list) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, hashes of its words in order) of the texts that have any."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def whole() -> Iterator[tuple[int, np.ndarray]]:
        text, h = (np.concatenate(x) for x in zip(*held, strict=True))
        cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        yield from zip(text[cuts].tolist(), np.split(h, cuts[1:]), strict=True)

    for text, _, h in words_of(texts):
        if held and held[-1][0][-1] != text[0]:
            yield from whole()
            held = []
        held.append((text, h))
        if text[0] != text[-1]:  # the last text may go on
            cut = int(np.searchsorted(text, text[-1]))
            held[-1] = (text[:cut], h[:cut])
            yield from whole()
            held = [(text[cut:], h[cut:])]
    if held:
        yield from whole()


def shingled(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a text's word hashes: SHINGLE words, or all if there are fewer."""
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    by = powers(FACTOR, size)
    return mixed(sum(h[i : len(h) - size + 1 + i] * by[i] for i in range(size)), 8)


def sequence_key(h: np.ndarray) -> bytes:
    """128 bits of the sequence of words."""
    by = powers(FACTOR, len(h))
    return np.array([(h * by).sum(), (mixed(h, 9) * by).sum(), len(h)], np.uint64).tobytes()


def word_fingerprints(h: np.ndarray) -> list[int]:
    """TABLES fingerprints of BITS bits of the distinct words, two from each 64 bits."""
    h = np.unique(h)
    full = [majority(mixed(h, k)) for k in range(-(-TABLES // 2))]
    return [x >> s & 0xFFFFFFFF for x in full for s in (0, 32)][:TABLES]


FACTOR = 0xD1342543DE82EF95
FACTORS, OFFSETS = np.random.default_rng(13).integers(1 << 64, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """BANDS codes of BITS bits; two texts share one with probability similarity ** ROWS. Without shingles, none."""
    if not len(hashes):
        return []
    h = hashes.view(np.uint64)[:, None]
    least = np.min([(h[i : i + CHUNK] * FACTORS + OFFSETS).min(axis=0) for i in range(0, len(h), CHUNK)], axis=0)
    return [int(x) & 0xFFFFFFFF for x in mixed(least, 3).reshape(BANDS, ROWS) @ np.uint64([1, 3, 5, 7]) >> np.uint64(32)]


def distinct(hashes: np.ndarray) -> np.ndarray:
    h = np.sort(hashes)
    return h[np.r_[len(h) > 0, h[1:] != h[:-1]][: len(h)]].view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """node (doc_id and __row), key of the word sequence, fingerprint and number of the shingles, and as fps the
    word fingerprints and bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = np.zeros(0, np.uint64)
            rows = [(sequence_key(none), 0, 0, word_fingerprints(none))] * len(b)
            for k, words in word_hashes(list(b["text"])):
                h = shingled(words)
                one = distinct(h)
                rows[k] = (sequence_key(words), signed(majority(h)), len(one), word_fingerprints(words) + bands(one))
            out = pd.DataFrame(rows, columns=["key", "fp", "n", "fps"])
            out.insert(0, "doc_id", b["doc_id"])
            out.insert(1, "row", b["row"])
            yield out

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row"), utf8().alias("text"))
    made = rows.mapInPandas(run, "doc_id long, row int, key binary, fp long, n long, fps array<long>")
    return made.select(F.struct("doc_id", "row").alias("node"), "key", "fp", "n", "fps")


def coded(texts: DataFrame) -> DataFrame:
    """code, x and the further columns of texts(rep, fp, n, fps): a row for each fingerprint and band."""
    rest = [c for c in texts.columns if c not in ("rep", "fp", "n", "fps")]
    each = texts.select(F.struct("rep", "fp", "n").alias("x"), *rest, F.posexplode("fps").alias("t", "word_fp"))
    return each.select((F.col("t").cast("long") * (1 << BITS) + F.col("word_fp")).alias("code"), "x", *rest)


def may_be_near(x: str, y: str) -> Column:
    """Whether the fingerprints and the numbers of shingles allow the threshold."""
    sizes = F.least(f"{x}.n", f"{y}.n") >= THRESHOLD * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= NEAR)


def ordered_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) with a < b of rows(x, y)."""
    pairs = rows.filter("x.rep <> y.rep").filter(may_be_near("x", "y"))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def meetings(texts: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(code, low, high) of each class, and (point, code, least) where several codes meet."""
    classes = keep(coded(texts).groupBy("code").agg(F.min("x").alias("low"), F.max("x").alias("high")), "fp-classes")
    ball = F.array(*(F.lit(m).cast("long") for m in masks(2, BITS)))
    balls = classes.filter(F.col("code") < TABLES << BITS)
    met = balls.select("code", F.explode(F.transform(ball, lambda m: m.bitwiseXOR(F.col("code")))).alias("point"))
    w = Window.partitionBy("point")
    met = met.withColumn("least", F.min("code").over(w)).withColumn("most", F.max("code").over(w)).filter("least <> most")
    return classes, keep(met.select("point", "code", "least"), "meetings")


def star_pairs(texts: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b) with a < b: each text with the ends of its classes, and each class with the least it meets."""
    inside = coded(texts).join(classes, "code").select("x", F.explode(F.array("low", "high")).alias("y"))
    other = classes.select(F.col("code").alias("least"), F.col("low").alias("low2"))
    across = met.filter("least <> code").select("code", "least").distinct().join(classes, "code").join(other, "least")
    return ordered_pairs(inside.union(across.select(F.explode(F.array("low", "high")).alias("x"), F.col("low2").alias("y"))))


def open_points(texts: DataFrame, points: DataFrame, reached: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(point, x, component): the members of points whose members are in several components, and
    (point, main, cells) of these points; main is the most frequent component."""
    joined = texts.join(reached, F.col("rep") == F.col("node"), "left")
    each = coded(joined.select("rep", "fp", "n", "fps", F.coalesce("component", "rep").alias("component")))
    span = each.groupBy("code").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    still = points.join(span, "code").groupBy("point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    members = keep(points.join(still.select("point"), "point", "left_semi").join(each, "code").select("point", "x", "component"), "open-members")
    main = members.groupBy("point", "component").count().groupBy("point")
    main = main.agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.ceil(F.sum("count") / CELL_ROWS).alias("cells"))
    return members, keep(main, "open-points")


def outside(members: DataFrame, main: DataFrame) -> DataFrame:
    """The open members: those that aren't of their point's most frequent component."""
    ends = main.select(F.col("point").alias("p"), "main")
    return members.join(ends, (F.col("point") == F.col("p")) & (F.col("component") == F.col("main")), "left_anti")


def pivot_pairs(members: DataFrame, main: DataFrame, turn: int) -> DataFrame:
    """(a, b): the open members of each point with two of them."""
    still = outside(members, main).withColumn("at", F.struct(F.xxhash64("x.rep", F.lit(turn)), "x"))
    ends = still.groupBy("point").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    return ordered_pairs(still.join(ends, "point").select("x", F.explode(F.array("low.x", "high.x")).alias("y")))


def all_pairs(members: DataFrame, main: DataFrame) -> DataFrame:
    """(a, b): the open members of each point with every member of another component."""
    cells = main.select("point", "cells")
    left = outside(members, main).join(cells, "point").select("point", "x", F.col("component").alias("c"), F.pmod(F.xxhash64("x.rep"), "cells").alias("cell"))
    right = members.join(cells, "point").select("point", F.col("x").alias("y"), "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    return ordered_pairs(left.join(right, ["point", "cell"]).filter("c <> component").filter(may_be_near("x", "y")).select("x", "y"))


def near_components(texts: DataFrame, docs: DataFrame, keep: Scratch) -> DataFrame:
    """node, component of the texts that are near to another."""
    classes, met = meetings(texts, keep)
    shared = classes.filter("low.rep <> high.rep").select(F.col("code").alias("point"), "code")
    points = keep(met.select("point", "code").union(shared).distinct(), "points")
    tried = keep(star_pairs(texts, classes, met), "pairs")
    good = keep(verified(tried, docs, keep), "near-pairs")
    for turn in range(PIVOTS + 1):
        members, main = open_points(texts, points, components(good, keep), keep)
        if not members.limit(1).count():
            break
        more = all_pairs(members, main) if turn == PIVOTS else pivot_pairs(members, main, turn)
        more = keep(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.limit(1).count():
            good, tried = good.union(keep(verified(more, docs, keep), "near-pairs")), tried.union(more)
    return components(good, keep)


def verified(pairs: DataFrame, docs: DataFrame, keep: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose shingle sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.zeros(0, np.int64)] * len(b)
            for k, words in word_hashes(list(b["text"])):
                sets[k] = distinct(shingled(words))
            yield pd.DataFrame({"id": pd.Series(b["id"], dtype=object), "s": pd.Series(sets, dtype=object)})

    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    texts = docs.filter("doc_id is not null").select(node().alias("id"), utf8().alias("text"))
    texts = Sieve(keep(ends, "ends")).passing(texts, F.col("id"))  # with some more texts, which no pair has
    sets = keep(texts.mapInPandas(run, "id struct<doc_id: long, row: int>, s array<long>"), "shingles")
    one, two = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def node() -> Column:
    """What tells rows apart: doc_id and the number of `numbered`; the least is of the least doc_id."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("__row").alias("row"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, key) of all documents of numbered docs, and (key, rep, component) of the distinct
    texts; rep and component are nodes."""
    with Scratch(ready(docs.sparkSession)) as keep:
        each = keep(sketches(docs), "sketches")
        first = F.min(F.struct("node", "fp", "n", "fps")).alias("first")
        texts = keep(each.groupBy("key").agg(first).select("key", F.col("first.node").alias("rep"), "first.fp", "first.n", "first.fps"), "texts")
        reached = near_components(texts, docs, keep)
        joined = texts.select("key", "rep").join(reached, F.col("rep") == F.col("node"), "left")
        return stash(each.select("node", "key"), "nodes"), stash(joined.select("key", "rep", F.coalesce("component", "rep").alias("component")), "components")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all documents, and (key, rep, component) of the distinct texts, as doc_ids."""
    each, texts = grouped(numbered(docs))
    return each.select("node.doc_id", "key"), texts.select("key", F.col("rep.doc_id").alias("rep"), F.col("component.doc_id").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of least doc_id of each group, and rows with a null doc_id."""
    rows = numbered(docs)
    each, texts = grouped(rows)
    gone = each.join(texts.select("key", "component"), "key").filter("node <> component")
    gone = stash(gone.select("node.doc_id", "node.row"), "copies")
    return without(rows, {"doc_id": F.col("doc_id").cast("long"), "row": F.col("__row")}, gone).select(docs.columns)
