"""Benchmark decontamination (operator 2) by latent semantic retrieval.

1. Each benchmark item is cut into passages of at most PASSAGE words. Their TF-IDF matrix,
   with document frequencies counted over all documents, is factorised by a distributed
   randomised SVD: tasks add up A'(A Omega) and the Gram matrix of A Q for their rows. What
   reaches the driver is (words of the benchmark) x (rank + OVERSAMPLE), whatever the corpus.
2. Every window of every document is projected (a running sum of word vectors makes that one
   subtraction a window) and compared by cosine with all passages, in blocks.
3. Each candidate is checked by the longest common subsequence of words with the whole item:
   a hit needs SURE of the item's words, or LIKELY of them and SURE of its answer, taken to be
   its last sentence. Candidates near which too few of the item's rarest words stand for LIKELY
   of them to match are left out first: of any LIKELY share of n places, RARE are among the
   n - need + RARE rarest.

The factorised passages are the benchmark's: directions that no benchmark passage has can't
tell one from another, so the corpus adds its statistics and its windows, not its directions.

Defined results: a null or wordless text is clean; benchmark rows with a null id or without
words are left out; repeated rows of it are one, and all texts of an item_id are searched
for; an empty benchmark leaves all clean; verdicts are by text, whatever the doc_id, so rows that
share one or have none are judged by their own text; further columns are passed on by clean().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, stash
from .hashing import hashed, spans
from .rows import without

PASSAGE = 40
#: (length, stride) of the windows over documents, in words: of about a passage's own length.
WINDOWS = ((20, 8), (40, 16))
#: The rank is RANK, or one for each PASSAGES_PER_RANK passages if those are more.
RANK, PASSAGES_PER_RANK, OVERSAMPLE = 96, 4, 16
#: Reached by the best window over an item with an eighth of its words changed and other words around it.
COSINE = 0.5
SURE, LIKELY = 0.8, 0.6
#: Passages that one pass over the documents compares, if an item has no more.
PASSAGES_PER_PASS = 4_000
#: Of an item's rarest words, those that must stand near a candidate.
RARE = 4
#: Numbers that the projection of windows holds at once, and characters that are split at once.
CHUNK, PIECE = 2_000_000, 1 << 17
#: Leading bits of the hashes of known words that are looked at first.
BITS = 20
word_list = re.compile(r"\w+").findall


def tokens(text: str | None) -> list[str]:
    return word_list((text or "").lower())


def answer(text: str) -> list[str]:
    """Words of the last sentence that has three or more, else all."""
    return next((w for s in reversed(re.split(r"[.!?\n]+", text)) if len(w := tokens(s)) >= 3), tokens(text))


def passages(words: list[str], size: int = PASSAGE) -> list[list[str]]:
    """Cuts of near-equal length, at most `size`."""
    k = -(-len(words) // size)
    return [words[i * len(words) // k : (i + 1) * len(words) // k] for i in range(k)]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; b's matches are the bits of an integer."""
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        if m := places.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(b) - row.bit_count()


@cache
def word_characters() -> np.ndarray:
    """Whether each character is one of \\w."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    out[ord("_")] = True
    return out


class Vocabulary:
    """Numbers of known words in texts; words are looked up by 64-bit hashes."""

    def __init__(self, words: list[str]):
        self.words = words
        h = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in self.hashes(["\n".join(words)]))])
        self.order = np.argsort(h)
        self.known = h[self.order]
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[h >> np.uint64(64 - BITS)] = True

    @staticmethod
    def hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, hash) of each word, in order, in parts of about PIECE characters."""

        def pieces() -> Iterator[tuple[int, str]]:
            for k, text in enumerate(texts):
                at = 0
                while len(text) - at > PIECE:
                    end = m.start() if (m := no_word(text, at + PIECE)) else len(text)
                    yield k, text[at:end].lower()
                    at = end
                yield k, text[at:].lower()

        def part(held: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
            codes = np.frombuffer("\n".join(x for _, x in held).encode("utf-32-le", "surrogatepass"), "<u4")
            starts, ends = spans(~word_characters()[codes]) if len(codes) else (codes, codes)
            first = np.cumsum([0, *(len(x) + 1 for _, x in held)])[:-1]
            return np.array([k for k, _ in held])[np.searchsorted(first, starts, "right") - 1], hashed(codes, starts, ends)

        held, size = [], 0
        for k, x in pieces():
            held.append((k, x))
            size += len(x)
            if size >= PIECE:
                yield part(held)
                held, size = [], 0
        if held:
            yield part(held)

    def numbers(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, number of the word or -1) of each word, in order, in parts."""
        for k, h in self.hashes(texts):
            out = np.full(len(h), -1, np.int64)
            at = np.flatnonzero(self.maybe[h >> np.uint64(64 - BITS)])
            if len(at):
                place = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
                out[at] = np.where(self.known[place] == h[at], self.order[place], -1)
            yield k, out

    def whole(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """numbers() in parts that end at the ends of texts."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for k, ids in self.numbers(texts):
            if not len(k):
                continue
            if held and held[-1][0][-1] == k[-1]:
                held.append((k, ids))
                continue
            k, ids = (np.concatenate(x) for x in zip(*held, (k, ids), strict=True))
            cut = np.searchsorted(k, k[-1])
            if cut:
                yield k[:cut], ids[:cut]
            held = [(k[cut:], ids[cut:])]
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


no_word = re.compile(r"\W").search


@dataclass
class Index:
    """What a worker needs; bounded by the benchmark."""

    vocabulary: Vocabulary
    projection: np.ndarray  # words x rank, IDF included
    latent: np.ndarray  # passages x rank, of length 1
    item_of: np.ndarray
    items: list[tuple[int, list[str], list[str]]]  # id, words, words of the answer
    frequency: np.ndarray  # documents with each word

    def __post_init__(self):
        number = {w: k for k, w in enumerate(self.vocabulary.words)}
        self.item_ids = [[number[w] for w in item] for _, item, _ in self.items]
        self.reply_ids = [[number[w] for w in reply] for _, _, reply in self.items]
        self.bags = [Counter(w) for w in self.item_ids]
        self.size = np.array([len(w) for w in self.item_ids])
        self.rare = np.zeros(len(self.items), np.int64)  # places of rare words that a candidate needs
        pairs = set()
        for k, ids in enumerate(self.item_ids):
            need = math.ceil(LIKELY * len(ids) - 1e-9)
            self.rare[k] = min(RARE, need)
            places = sorted(ids, key=lambda w: (self.frequency[w], w))[: len(ids) - need + self.rare[k]]
            pairs |= {(w, k) for w in places}
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.rare_items = pairs[:, 1]
        self.rare_ends = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Documents, and documents with each word, over all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, n = shared.value, 0
        seen = np.zeros(len(wanted.words), np.int64)
        for b in batches:
            for k, ids in wanted.whole([x or "" for x in b["text"]]):
                one = np.unique(k[ids >= 0] * len(seen) + ids[ids >= 0])
                seen += np.bincount(one % len(seen), minlength=len(seen))
            n += len(b)
        yield pd.DataFrame({"word": [*np.flatnonzero(seen), -1], "n": [*seen[seen > 0], n]})

    rows = docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(vocabulary.words) + 1, np.int64)
    for r in rows:
        found[r["word"]] = r["n"]
    return int(found[-1]), found[:-1]


def weights(words: list[str], word: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a TF-IDF row of length 1."""
    count = Counter(word[w] for w in words if w in word)
    cols = np.fromiter(count, np.int64, len(count))
    v = np.fromiter(count.values(), float, len(count)) * idf[cols]
    return cols, v / (np.linalg.norm(v) or 1.0)


def randomised_svd(rows: DataFrame, word: dict[str, int], idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the TF-IDF matrix of rows(words)."""
    spark, width = rows.sparkSession, min(rank + OVERSAMPLE, len(word))
    known = spark.sparkContext.broadcast((word, idf))

    def summed(basis: np.ndarray, gram: bool) -> np.ndarray:
        """A'(A basis), or with gram (A basis)'(A basis), added up over the tasks."""
        held = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (word, idf), basis = known.value, held.value
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for words in b["words"]:
                    cols, v = weights(list(words), word, idf)
                    y = v @ basis[cols]
                    if gram:
                        out[0] = out.get(0, 0) + np.outer(y, y)
                    else:
                        for c, x in zip(cols.tolist(), np.outer(v, y), strict=True):
                            out[c] = out[c] + x if c in out else x
            if gram:
                out = dict(enumerate(out[0])) if out else {}
            yield pd.DataFrame({"c": list(out), "x": pd.Series(list(out.values()), dtype=object)})

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for c, x in zip(b["c"].tolist(), b["x"], strict=True):
                    out[c] = out[c] + x if c in out else x
            yield pd.DataFrame({"c": list(out), "x": pd.Series(list(out.values()), dtype=object)})

        parts = rows.select("words").mapInPandas(run, "c long, x array<double>").repartition("c")
        width = basis.shape[1]
        made = np.zeros((width if gram else len(word), width))
        got = parts.mapInPandas(added, "c long, x array<double>").toArrow()  # a row for each of the benchmark's words
        made[got["c"].to_numpy()] = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        return made

    basis = np.random.default_rng(seed).standard_normal((len(word), width))
    for _ in range(2):  # the range finder and one power iteration
        basis, _ = np.linalg.qr(summed(basis, False))
    values, turn = np.linalg.eigh(summed(basis, True))
    lead = np.argsort(-values)[: min(rank, int((values > 1e-9 * values.max()).sum()))]
    return basis @ turn[:, lead]


def build_index(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> Index:
    """The index of items; its rank is at least `rank`, and grows with the passages."""
    spark = docs.sparkSession
    split = [(i, tokens(t), answer(t)) for i, t in items]
    cuts = [(k, p) for k, (_, w, _) in enumerate(split) for p in passages(w)]
    vocabulary = Vocabulary(sorted({w for _, p in cuts for w in p}))
    word = {w: k for k, w in enumerate(vocabulary.words)}
    n, found = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + found)) + 1
    rows = spark.createDataFrame([(p,) for _, p in cuts], "words array<string>")
    v = randomised_svd(rows, word, idf, max(rank, -(-len(cuts) // PASSAGES_PER_RANK)))
    projection = (v * idf[:, None]).astype(np.float32)
    latent = np.array([sum(projection[word[w]] for w in p) for _, p in cuts], np.float32)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Index(vocabulary, projection, latent, np.array([k for k, _ in cuts]), split, found)


def windows(ends_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the windows of texts that follow one another, in order."""
    begin = np.r_[0, ends_of_texts[:-1]]
    starts, ends = [], []
    for size, stride in WINDOWS:
        n = np.maximum(1, -(-(ends_of_texts - begin - size) // stride) + 1)
        s = np.repeat(begin, n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        starts.append(s)
        ends.append(np.minimum(s + size, np.repeat(ends_of_texts, n)))
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def candidates(ids: np.ndarray, s: np.ndarray, e: np.ndarray, index: Index, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, from, to): windows near a passage. ids: number of each word or -1."""
    out = [np.zeros((3, 0), np.int64)]
    chunk, at = max(1, CHUNK // index.projection.shape[1]), 0
    while at < len(s):
        to = np.searchsorted(s, s[at] + chunk)
        low, high = s[at], e[at:to].max()
        known = ids[low:high] >= 0
        run = np.zeros((int(known.sum()) + 1, index.projection.shape[1]), np.float32)
        np.cumsum(index.projection[ids[low:high][known]], axis=0, out=run[1:], dtype=np.float32)
        before = np.r_[0, np.cumsum(known)]
        window = run[before[e[at:to] - low]] - run[before[s[at:to] - low]]
        length = np.linalg.norm(window, axis=1)
        busy = np.flatnonzero(length > 1e-6)
        near = window[busy] @ index.latent.T
        w, p = np.nonzero(near >= cosine * length[busy, None])
        w = busy[w] + at
        out.append(np.stack([index.item_of[p], s[w], e[w]]))
        at = to
    return tuple(np.concatenate(out, axis=1))


def with_rare_words(ids: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, index: Index) -> np.ndarray:
    """Whether enough of the item's rarest words stand in ids[low:high]."""
    pos = np.flatnonzero(ids >= 0)
    n = index.rare_ends[ids[pos] + 1] - index.rare_ends[ids[pos]]
    at = np.repeat(index.rare_ends[ids[pos]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = len(ids) + 1
    key = np.sort(index.rare_items[at] * wide + np.repeat(pos, n))
    return np.searchsorted(key, item * wide + high) - np.searchsorted(key, item * wide + low) >= index.rare[item]


def found_in(text: np.ndarray, ids: np.ndarray, index: Index, cosine: float) -> dict[int, dict[int, float]]:
    """text -> item -> share of its words in the longest common subsequence, of the items found.
    text: the number of each word's text, in order."""
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) + 1
    s, e = windows(last)
    item, s, e = candidates(ids, s, e, index, cosine)
    k = np.searchsorted(last, s, "right")
    low = np.maximum(np.r_[0, last[:-1]][k], s - index.size[item])
    high = np.minimum(last[k], e + index.size[item])
    keep = with_rare_words(ids, item, low, high, index)
    item, low, high, k = item[keep], low[keep], high[keep], k[keep]
    order = np.lexsort((low, item, k))
    item, low, high, k = item[order], low[order], high[order], k[order]
    out: dict[int, dict[int, float]] = {}
    at = 0
    while at < len(item):
        one, s, e, own = int(item[at]), int(low[at]), int(high[at]), k[at]
        at += 1
        while at < len(item) and item[at] == one and k[at] == own and low[at] <= e:
            e = max(e, int(high[at]))
            at += 1
        whole, reply, bag = index.item_ids[one], index.reply_ids[one], index.bags[one]
        for f in range(s, e, 2 * len(whole) + 64):  # merged spans are read in overlapping parts
            region = ids[max(s, f - len(whole)) : min(e, f + 3 * len(whole) + 64)].tolist()
            if sum(map(bag.__getitem__, bag.keys() & set(region))) < LIKELY * len(whole):
                continue  # no subsequence can be longer
            share = lcs(region, whole) / len(whole)
            if share >= SURE or share >= LIKELY and lcs(region, reply) >= SURE * len(reply):
                found = out.setdefault(int(text[last[own] - 1]), {})
                found[one] = max(found.get(one, 0.0), share)
    return out


def hits(words: list[str], index: Index, cosine: float) -> dict[int, float]:
    """found_in of one text's words."""
    number = {w: k for k, w in enumerate(index.vocabulary.words)}
    ids = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
    return found_in(np.zeros(len(ids), np.int64), ids, index, cosine).get(0, {})


def passes(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Consecutive parts of at most PASSAGES_PER_PASS passages, or of one item."""
    part, n = [], 0
    for item in items:
        own = -(-len(tokens(item[1])) // PASSAGE)
        if part and n + own > PASSAGES_PER_PASS:
            yield part
            part, n = [], 0
        part.append(item)
        n += own
    if part:
        yield part


def text_key() -> Column:
    """What equal texts share; null for a null text."""
    return F.sha2("text", 256).alias("text_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """text_key, item_ids (sorted), share (the highest) for distinct texts with hits."""
    spark = ready(docs.sparkSession)
    named = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    got = named.orderBy("item_id", "text").toArrow()
    items = [(i, t) for i, t in zip(*(got[c].to_pylist() for c in ("item_id", "text")), strict=True) if tokens(t)]
    out = None
    for part_of_items in passes(items):
        index = spark.sparkContext.broadcast(build_index(docs, part_of_items, rank))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            known = index.value
            for b in batches:
                rows, key = [], b["text_key"].tolist()
                for text, ids in known.vocabulary.whole([x or "" for x in b["text"]]):
                    for t, found in found_in(text, ids, known, cosine).items():
                        rows.append((key[t], sorted({known.items[k][0] for k in found}), max(found.values())))
                yield pd.DataFrame(rows, columns=["text_key", "item_ids", "share"])

        part = docs.select(text_key(), "text").mapInPandas(run, "text_key string, item_ids array<long>, share double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "text_key string, item_ids array<long>, share double")
    return out.groupBy("text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("share").alias("share"))


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float) -> DataFrame:
    """text_key, item_ids, share of the texts with hits."""
    return stash(contaminated(docs, benchmark, cosine), "leaks")


def judge(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, contaminated, item_ids, share for every document."""
    found = leaks(docs, benchmark, cosine).withColumnRenamed("text_key", "__key")
    joined = docs.select("doc_id", text_key()).join(found, F.col("text_key") == F.col("__key"), "left")
    return joined.select("doc_id", F.col("share").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The documents without hits, with all their columns."""
    return without(docs, {"text_key": F.sha2("text", 256)}, leaks(docs, benchmark, cosine).select("text_key"))
