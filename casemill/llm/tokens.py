"""Token counts (operator 5): heap-and-linked-list byte-pair merging, counting only.

The symbols of a pre-token form a linked list; the adjacent pairs wait in a heap by merge
rank. The lowest is popped and merged again and again; the count is the number of initial
symbols less the number of merges, and no identifier is ever emitted. A worker remembers the
counts of the pre-tokens that it has seen, up to a bound.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id is carried;
repeated rows are counted each; no rows give no rows. Columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, utf8

#: Pre-tokens that a worker remembers, and the longest of them in characters.
MEMO_ENTRIES, MEMO_CHARS = 800_000, 48


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitter() -> Callable[[str], list[str]]:
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


class Memo:
    """What `make` gives for a text's pre-tokens; remembers them up to a bound."""

    def __init__(self, make: Callable[[list[str]], list]):
        self.make = make
        self.split, self.seen = splitter(), {}

    def values(self, text: str) -> list:
        words = self.split(text)
        if new := [w for w in dict.fromkeys(words) if w not in self.seen]:
            if len(self.seen) + len(new) > MEMO_ENTRIES:
                self.seen = {w: self.seen[w] for w in dict.fromkeys(words) if w in self.seen}
            self.seen |= zip(new, self.make(new), strict=True)
        out = list(map(self.seen.__getitem__, words))
        for w in new:
            if len(w) > MEMO_CHARS:
                del self.seen[w]
        return out


class Ids:
    """A text's ids as `tokenizers` gives them, without begin, end or added special tokens.

    Where a vocabulary is byte-level and its ids follow the order of its merges, `tiktoken` makes
    the same ids from the file's ranks in a third of the time. Texts with a special token's
    string, whose handling is the library's, and all texts of other vocabularies go to `tokenizers`."""

    made: dict[str, Ids] = {}

    @classmethod
    def of(cls, name: str) -> Ids:
        """The worker's own, kept from task to task."""
        if name not in cls.made:
            cls.made[name] = cls(name)
        return cls.made[name]

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name))
        with open(vocabulary_path(name), encoding="utf-8") as f:
            told = json.load(f)
        self.special = [x["content"] for x in told["added_tokens"]]
        self.fast = self.ranked(told)

    @staticmethod
    def ranked(told: dict) -> Callable[[str], list[int]] | None:
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        if told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model["type"] != "BPE":
            return None
        byte = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in model["vocab"].items() if all(c in byte for c in w)}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or any(model["vocab"][c] >= merged[0] for c in byte):
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special):
            return np.array(self.fast(text), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    where it is printable Latin-1, else the next free one from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    free = iter(range(256, 512))
    return {b: chr(b if b in plain else next(free)) for b in range(256)}


class PairMerger:
    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), (r, a + b))
        self.symbol = byte_symbols()

    @classmethod
    def load(cls, name: str) -> PairMerger:
        with open(vocabulary_path(name), encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        return cls([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges])

    def count(self, word: str) -> int:
        """Initial symbols less merges."""
        part = [self.symbol[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(part)
        if n < 2:
            return n
        rank, nxt, prev = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or part[i] != a or part[j] != b:
                continue  # one of the two has been merged meanwhile
            part[i], part[j] = rank[a, b][1], ""
            merged += 1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if r := rank.get((part[i], part[k])):
                    heapq.heappush(heap, (r[0], i, part[i], part[k]))
            if (p := prev[i]) >= 0 and (r := rank.get((part[p], part[i]))):
                heapq.heappush(heap, (r[0], p, part[p], part[i]))
        return n - merged


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document. A special token's string
    inside a text is one token, as by the library's default."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger, special = PairMerger.load(vocabulary), "<|endoftext|>"
        memo = Memo(lambda words: [merger.count(w) for w in words])
        for b in batches:
            n = []
            for text in b["text"]:
                parts = bytes(text).decode("utf-8", "replace").split(special)
                n.append(len(parts) - 1 + sum(sum(memo.values(p)) for p in parts))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["text"].map(len), "n_tokens": n})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), utf8().alias("text"))
    counted = rows.mapInPandas(run, "doc_id string, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
