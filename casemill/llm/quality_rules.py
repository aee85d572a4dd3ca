"""Quality rules (operator 7) as a short-circuit cascade.

The base measures are made for every document. Each rule's cost (seconds a document beyond
those measures) and selectivity (share that it rejects of what passes the base) are estimated
on a random sample; the rules then run in falling order of rejection per cost, and a document
meets no further rule after the first that rejects it. The verdict is the same in any order;
the order only saves work. The sample sets the order alone: every document is judged whole.

Defined results: a null text has no words; texts with no words fail the base; a null doc_id
is carried; repeated rows are judged alike; no rows give no rows. Columns beside doc_id and
text aren't read.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, utf8

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents expected in the sample that sets the order.
SAMPLE_ROWS = 400
#: What every document is measured by before the rules.
DIGEST = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Text:
    """A document; what several rules need is computed once, when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __getattr__(self, name: str):
        value = MEASURES[name](self)
        setattr(self, name, value)
        return value


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of `size` words that occur twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    rank = ids[:n]
    for k in range(1, size):  # exact: windows are numbered anew after each further word
        _, rank = np.unique(rank * len(number) + ids[k : k + n], return_inverse=True)
    twice = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.raw.split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(b"".join(t.words).decode("utf-8", "replace")),
    "n_symbols": lambda t: sum(t.raw.count(c) for c in SYMBOLS.encode()),
    "n_dup_lines": lambda t: duplicate_lines(t.raw),
    "n_lines": lambda t: max(1, sum(1 for x in t.raw.split(b"\n") if x and not x.isspace())),
    "n_repeat_words": lambda t: repeated_words(t.words),
    "n_upper": lambda t: sum(w.isupper() and len(w) > 1 for w in t.words),
    "n_shouts": lambda t: t.raw.count(b"!"),
    "n_distinct": lambda t: len(set(t.words)),
    "n_top": lambda t: max(Counter(t.words).values(), default=0),
    "n_trigrams": lambda t: max(0, t.n_words - 2),
    "n_distinct_trigrams": lambda t: len(set(zip(t.words, t.words[1:], t.words[2:], strict=False))),
    "paragraphs": lambda t: [x for x in t.raw.split(b"\n\n") if x and not x.isspace()],
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Too few or mostly repeated words fail the base already.
RULES = [
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * max(1, t.n_words)),
    Rule("shouting", lambda t: 2 * t.n_upper > t.n_words and t.n_words >= 5),
    Rule("exclamations", lambda t: 4 * t.n_shouts > t.n_words and t.n_words >= 5),
    Rule("word_length", lambda t: t.n_words > 0 and not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("one_word", lambda t: 4 * t.n_top > t.n_words),
    Rule("few_words", lambda t: 50 * t.n_distinct < t.n_words),
    Rule("repeated_trigrams", lambda t: 2 * (t.n_trigrams - t.n_distinct_trigrams) > t.n_trigrams),
    Rule("repeated_paragraphs", lambda t: 2 * (len(t.paragraphs) - len(set(t.paragraphs))) > len(t.paragraphs)),
]


def measured(raw: bytes, known: dict | None = None) -> Text:
    """A text whose DIGEST is there: taken from `known` or made."""
    t = Text(raw)
    t.__dict__.update(known or {c: getattr(t, c) for c in DIGEST})
    return t


def base_fails(t: Text) -> bool:
    return t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[str, tuple[float, float]]:
    """name -> (seconds a document beyond DIGEST, share rejected) of documents that pass the base,
    from a random sample of all rows. Each task times its own share of the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t for t in (measured(bytes(x)) for x in b["text"]) if not base_fails(t)]
            for rule in rules:
                fresh = [measured(t.raw, t.__dict__) for t in texts]
                began = time.perf_counter()
                hits = sum(rule.rejects(t) for t in fresh)
                yield pd.DataFrame({"name": [rule.name], "s": [time.perf_counter() - began], "hits": [hits], "n": [len(fresh)]})

    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(utf8().alias("text")).sample(share, seed)
    rows = sample.mapInPandas(run, "name string, s double, hits long, n long").groupBy("name").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    return {r["name"]: (r["s"] / max(1, r["n"]), r["hits"] / max(1, r["n"])) for r in rows}


def ordered(rules: list[Rule], figures: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejection per cost, highest first; rules without figures keep their place at the end."""
    worth = lambda r: figures[r.name][1] / max(figures[r.name][0], 1e-9) if r.name in figures else -1.0
    return sorted(rules, key=worth, reverse=True)


def cascade(rules: list[Rule], text: Text) -> str | None:
    """The first rule that rejects; the rest aren't evaluated."""
    return next((r.name for r in rules if r.rejects(text)), None)


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, figures: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    ready(docs.sparkSession)
    rules = RULES if rules is None else rules
    rules = ordered(rules, estimate(docs, rules) if figures is None else figures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["text"]:
                t = measured(bytes(raw))
                failed = base_fails(t)
                rows.append((*(getattr(t, c) for c in DIGEST), failed, not failed and cascade(rules, t) is None))
            out = pd.DataFrame(rows, columns=[*DIGEST, "base_failed", "kept"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8().alias("text")).mapInPandas(run, "doc_id string, " + ", ".join(f"{c} long" for c in DIGEST) + ", base_failed boolean, kept boolean")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
