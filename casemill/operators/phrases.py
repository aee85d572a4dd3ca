"""Keywords of several words, in any script: leftmost-longest matches of a whole lexicon at once.

The lexicon is a trie held as arrays, broadcast once: the characters in use are numbered, and an edge
is the sorted number of (state, character). All places of a batch of texts where a match may begin
walk the trie together, a character at a time; most leave it after a step or two, so a batch costs
little more than its starts, whatever the size of the lexicon. Of the matches found the leftmost is
taken, of those that begin together the longest, and none overlaps a taken one.

Case is set aside as str.lower does. A match neither begins nor ends inside a run of ASCII letters,
digits and underscores; other scripts need no separators. Runs of white space stand for one blank in
keywords and texts alike. Defined results: null and blank texts have no matches; blank keywords are
left out; keywords that differ in case or spacing only are one, in their lower-case form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of texts that are walked at once; a longer text is walked alone, in parts of this size.
CHARS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def is_word(codes: np.ndarray) -> np.ndarray:
    """ASCII letters, digits and underscores."""
    low = codes | 0x20
    return (codes < 128) & (((low >= ord("a")) & (low <= ord("z"))) | ((codes >= ord("0")) & (codes <= ord("9"))) | (codes == ord("_")))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass(frozen=True)
class Trie:
    """keywords; chars: the code points in use, sorted; edges: sorted state * (len(chars) + 1) + number
    of the character; to: the state that an edge leads to; ends: the keyword that a state ends, or -1."""

    keywords: list[str]
    chars: np.ndarray
    edges: np.ndarray
    to: np.ndarray
    ends: np.ndarray
    depth: int

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """Each character's number from 1 on; 0 for those that no keyword has."""
        if not len(self.chars):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, 0)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = states * (len(self.chars) + 1) + chars
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((self.edges[at] == key) & (chars > 0), self.to[at], -1)

    def matches(self, codes: np.ndarray, begin: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, keyword) of all longest matches that start in codes[begin:end], in order, overlaps included."""
        if not len(self.edges) or begin >= end:
            return []
        word, chars = is_word(codes), self.numbered(codes)
        inner = np.r_[False, word[1:] & word[:-1], False]  # places between two characters of one run
        starts = begin + np.flatnonzero((chars[begin:end] > 0) & ~inner[begin:end])
        states, places, found = np.zeros(len(starts), np.int64), starts.copy(), []
        for _ in range(self.depth):
            states = self.step(states, chars[places])
            alive = states >= 0
            states, places, starts = states[alive], places[alive] + 1, starts[alive]
            hit = (self.ends[states] >= 0) & ~inner[places]
            found.append(np.stack([starts[hit], places[hit], self.ends[states[hit]]]))
            inside = places < len(codes)
            states, places, starts = states[inside], places[inside], starts[inside]
            if not len(states):
                break
        start, stop, keyword = np.concatenate(found, axis=1)
        order = np.lexsort((-stop, start))
        order = order[np.r_[True, np.diff(start[order]) > 0][: len(order)]]
        return list(zip(start[order].tolist(), stop[order].tolist(), keyword[order].tolist(), strict=True))


def trie(keywords: Iterable[str]) -> Trie:
    known = sorted({normal(k) for k in keywords} - {""})
    chars = np.unique(np.concatenate([code_points(k) for k in known])) if known else np.zeros(0, np.int64)
    number = {c: i + 1 for i, c in enumerate(chars.tolist())}
    edges: dict[int, int] = {}
    ends = [-1]
    for i, k in enumerate(known):
        state = 0
        for c in code_points(k).tolist():
            key = state * (len(number) + 1) + number[c]
            if key not in edges:
                edges[key] = len(ends)
                ends.append(-1)
            state = edges[key]
        ends[state] = i
    keys = np.array(sorted(edges), np.int64)
    return Trie(known, chars, keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64), max(map(len, known), default=0))


def taken(matches: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The matches in order that don't overlap one taken before."""
    free = 0
    for start, end, keyword in matches:
        if start >= free:
            yield start, end, keyword
            free = end


def found_in(texts: list[str | None], known: Trie) -> Iterator[tuple[int, int, int, int]]:
    """(text's number, start, end, keyword) of the matches taken in each text, in its normal form."""
    held, size = [], 0

    def walked() -> Iterator[tuple[int, int, int, int]]:
        """Texts end to end, with a character between them that no keyword has."""
        begins = np.cumsum([0] + [len(t) + 1 for _, t in held])
        codes = code_points("".join(t + "\n" for _, t in held))
        every = []
        for at in range(0, len(codes), CHARS):
            every += known.matches(codes, at, min(at + CHARS, len(codes)))
        for start, end, keyword in taken(every):
            k = int(np.searchsorted(begins, start, "right")) - 1
            yield held[k][0], start - int(begins[k]), end - int(begins[k]), keyword

    for i, t in enumerate(texts):
        if text := normal(t):
            held.append((i, text))
            size += len(text)
            if size >= CHARS:
                yield from walked()
                held, size = [], 0
    if held:
        yield from walked()


def phrase_matches(rows: DataFrame, keywords: Iterable[str], key: str = "case_id", text: str = "fact") -> DataFrame:
    """key, place (of the match in its text, from 0), start, end (characters of the text's normal form) and keyword."""
    known = rows.sparkSession.sparkContext.broadcast(trie(keywords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array(list(found_in(b["text"].to_pylist(), known.value)), np.int64).reshape(-1, 4)
            row, start, end, keyword = got.T
            first = np.searchsorted(row, row)
            yield pa.record_batch({"key": b["key"].take(pa.array(row)), "place": np.arange(len(row)) - first, "start": start, "end": end, "keyword": pa.array(known.value.keywords, pa.string()).take(pa.array(keyword))})

    kind = dict(rows.dtypes)[key]
    made = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, place long, start long, end long, keyword string")
    return made.withColumnRenamed("key", key)


def phrase_counts(rows: DataFrame, keywords: Iterable[str], key: str = "case_id", text: str = "fact") -> DataFrame:
    """key, keyword, n. Counted where the text is: a row comes out for each keyword of a text."""
    known = rows.sparkSession.sparkContext.broadcast(trie(keywords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array(list(found_in(b["text"].to_pylist(), known.value)), np.int64).reshape(-1, 4)
            both, n = np.unique(got[:, [0, 3]], axis=0, return_counts=True)
            yield pa.record_batch({"key": b["key"].take(pa.array(both[:, 0])), "keyword": pa.array(known.value.keywords, pa.string()).take(pa.array(both[:, 1])), "n": n})

    kind = dict(rows.dtypes)[key]
    made = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, keyword string, n long")
    return made.withColumnRenamed("key", key)


def by_class(counts: DataFrame, lexicon: dict[str, list[str]], key: str = "case_id") -> DataFrame:
    """key, keyword_counts, crime_counts, crime_keywords, matched_crimes and details of each row with a
    match; a keyword counts for every class that lists it. A row's keywords are bounded by the lexicon."""
    spark = counts.sparkSession
    rows = sorted({(c, normal(k)) for c, ks in lexicon.items() for k in ks if normal(k)})
    listed = counts.join(F.broadcast(spark.createDataFrame(rows, "class string, listed string")), F.col("keyword") == F.col("listed"))  # the lexicon, which every task holds anyway
    pairs = lambda *c: F.sort_array(F.collect_set(F.struct(*c)))
    classes = listed.groupBy(key, "class").agg(F.sum("n").alias("total"), pairs("keyword", "n").alias("own"))
    each = F.col("each")
    rolled = classes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("class", "total", "own"))).alias("each"))
    words = F.sort_array(F.array_distinct(F.flatten(F.transform(each, lambda x: x["own"]))))
    of = lambda make: F.map_from_entries(F.transform(each, lambda x: F.struct(x["class"], make(x))))
    return rolled.select(
        key,
        F.map_from_entries(words).alias("keyword_counts"),
        of(lambda x: x["total"]).alias("crime_counts"),
        of(lambda x: F.transform(x["own"], lambda p: p["keyword"])).alias("crime_keywords"),
        F.transform(each, lambda x: x["class"]).alias("matched_crimes"),
        of(lambda x: F.map_from_entries(x["own"])).alias("details"),
    )
