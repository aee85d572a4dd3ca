"""Hashes of words eight bytes at a time, and the lines made of them, against plain Python."""

import random
from fractions import Fraction

import numpy as np
from casemill.llm import hashing, lines

WORDS = [b"a", b"a\0", b"a\0\0\0\0\0\0\0", b"\0", b"\0\0", *(bytes([97 + k % 26 for k in range(n)]) for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 200)), b"x" * 64, b"x" * 65, b"aaaaaaaabbbbbbbb", b"bbbbbbbbaaaaaaaa"]


def test_hashes_by_eights_tell_words_apart_wherever_they_are():
    rng = random.Random(31)
    words = [*WORDS, *(bytes(rng.choices(b"ab\0\xc3\xa9", k=rng.randint(1, 80))) for _ in range(300))]
    seen: dict[bytes, int] = {}
    for _ in range(5):
        rng.shuffle(words)
        texts = [b" ".join(words[:100]), b"", b"\t".join(words[100:])]
        got = [h for _, _, hs in hashing.words_of(texts, hashing.by_eights) for h in hs.tolist()]
        plain = [h for _, _, hs in hashing.words_of(texts) for h in hs.tolist()]
        assert len(got) == len(plain) == len(words)
        for w, h, p in zip(words, got, plain, strict=True):
            assert seen.setdefault(w, h) == h
            assert (h == p) == (len(w) > hashing.SHORT)  # long words have the hashes by their characters
    assert len(set(seen.values())) == len(set(words))
    assert not len(hashing.by_eights(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_sets_of_lines_from_hashes_by_eights():
    """Sizes, and which sets a text has had before, whatever the order and the repeats of their words."""
    rng = random.Random(32)
    texts = ["\n".join(" ".join(rng.choices("abcdef", k=rng.randint(0, 4))) for _ in range(rng.randint(0, 30))).encode() for _ in range(20)]
    want = []
    for i, x in enumerate(texts):
        had = set()
        for k, y in enumerate(x.split(b"\n")):
            if s := frozenset(y.split()):
                want.append((i, k, len(s), s in had))
                had.add(s)
    counts = np.ones(1 << lines.BUCKET_BITS, np.uint32)
    for rank in (np.arange(len(counts), dtype=np.uint32), np.zeros(len(counts), np.uint32)):
        got = [lines.line_sets(np.arange(20), np.zeros(20, np.int64), b, counts, rank, Fraction(4, 5), 0) for b in lines.whole_lines(texts, hashing.by_eights)]
        rows = [r for b in got for r in b.to_pylist()]
        assert [(r["doc_id"], r["line"], r["size"], r["key"] is None) for r in rows] == want and any(w[3] for w in want)
        take = [0 if again else n - -(-4 * n // 5) + 1 for _, _, n, again in want]
        assert [len(r["prefix"]) // lines.WORD_BYTES for r in rows] == take == [r["hot"] for r in rows]
