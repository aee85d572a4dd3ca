"""Hashes of the words of whole batches of texts at once, in numpy.

A word's hash is a polynomial of its characters modulo 2**64, made from one running sum over
the batch and mixed by a multiply-and-shift finaliser; it depends on the word alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np

#: Characters that are hashed at once: the arrays of a piece are some 30 times as large in bytes.
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_space = re.compile(rb"[\x20\x09-\x0D]")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same words, by a multiply-and-shift finaliser; sums of them tell sets apart."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2**64."""
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, 2 * PIECE), powers(pow(BASE, -1, 1 << 64), 2 * PIECE)


def spans(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs without gaps, and the places after their last."""
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    inside = ~gap[:1]
    starts, ends = (edge[1::2], edge[0::2]) if inside.any() else (edge[0::2], edge[1::2])
    if inside.any():
        starts = np.r_[0, starts]
    return starts, ends if len(ends) == len(starts) else np.r_[ends, len(gap)]


def hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words codes[starts:ends]."""
    up, down = _tables() if len(codes) < 2 * PIECE else (powers(BASE, len(codes) + 1), powers(pow(BASE, -1, 1 << 64), len(codes) + 1))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts], 4)


#: Words of at most so many bytes are hashed eight bytes at a time.
SHORT = 64


def by_eights(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words codes[starts:ends], for less time a word than `hashed`: eight bytes at a time, with the length
    mixed in. Long words have hashes by their characters."""
    size = ends - starts
    padded = np.zeros(len(codes) + 8, np.uint8)
    padded[: len(codes)] = codes
    eights = np.ndarray(len(codes) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on

    def step(before: np.ndarray, first: np.ndarray, left: np.ndarray) -> np.ndarray:
        spare = (64 - 8 * np.minimum(left, 8)).astype(np.uint64)  # bits of the bytes after the word
        h = (before ^ eights[first] << spare) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        return h

    out = step(size.astype(np.uint64) * np.uint64(BASE), starts, size)
    at = np.flatnonzero((size > 8) & (size <= SHORT))
    for k in range(8, SHORT, 8):
        if not len(at):
            break
        out[at] = step(out[at], starts[at] + k, size[at] - k)
        at = at[size[at] > k + 8]
    out = mixed(out, 4)
    if len(long := np.flatnonzero(size > SHORT)):
        out[long] = hashed(codes, starts[long], ends[long])
    return out


def cut(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end before white space."""
    at = 0
    while len(text) - at > PIECE:
        found = _space.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def batches(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(number of the text, piece) for each piece, in lists of about PIECE bytes."""
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in cut(bytes(text)):
            if size + len(piece) > PIECE and parts:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(k)
            parts.append(piece)
            size += len(piece) + 1
    if parts:
        yield numbers, parts


def words_of(texts: Iterable[bytes], hashes: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = hashed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, number of the line in it, hash) of each word, in order: runs outside
    \\x20 and \\x09-\\x0D, with A-Z in lower case. Batches end at the ends of pieces."""
    last, lines_before = -1, 0
    for numbers, parts in batches(texts):
        raw = np.frombuffer(b"\n".join(parts).lower(), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size + 1) - size - 1
        new_line = np.flatnonzero(raw == 10)
        before = np.searchsorted(new_line, first)  # the separators of the pieces among them
        number = np.array(numbers)
        if number[0] != last:
            lines_before = 0
        own = np.searchsorted(new_line, first + size) - before  # new lines within each piece
        offset = np.zeros(len(parts), np.int64)
        if number[0] == last:
            offset[number == last] = lines_before
        # a text has more than one piece in a batch only where a long one ends or begins
        for k in np.flatnonzero(number[1:] == number[:-1]) + 1:
            offset[k] = offset[k - 1] + own[k - 1]
        last, lines_before = int(number[-1]), int(offset[-1] + own[-1])
        if len(raw):
            starts, ends = spans((raw == 32) | (raw - 9 < 5))  # less than 9 wraps round
            if len(starts):
                # pieces and lines are fewer than words, so they are looked up among these
                piece = np.repeat(np.arange(len(first)), np.diff(np.r_[np.searchsorted(starts, first), len(starts)]))
                line = np.repeat(np.arange(len(new_line) + 1), np.diff(np.r_[0, np.searchsorted(starts, new_line), len(starts)]))
                yield number[piece], line + (offset - before)[piece], hashes(raw, starts, ends)
