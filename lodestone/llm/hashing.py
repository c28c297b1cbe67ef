"""Words of UTF-8 texts and their 64-bit hashes, for whole batches of texts at once in numpy.

Texts are handled as bytes: words are parted by ASCII blanks only, so no decoding is needed and a word's bytes
are exactly its code points'. A batch of texts is joined into one buffer, a blank between any two. The hash of
the bytes s..e is (S[e] - S[s]) * P**-s for prefix sums S of byte * P**i modulo 2**64, so all words of a batch
take a handful of vector operations; a final mix, with the length, spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

U = np.uint64
#: Texts are handled in batches of about so many bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, U)
        grown[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(grown)
    return have[:n]


class Words(NamedTuple):
    """Of a batch: the lowered buffer, and for each word its hash, text number, start and end in the buffer."""

    buffer: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: of each text, its first word, and one past the last word of all
    first: np.ndarray


def _spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = np.empty(len(buffer) + 2, bool)
    blank[0] = blank[-1] = True
    blank[1:-1] = BLANK[buffer]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[0::2], edge[1::2]


def hash_spans(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of the buffer; spans must be ordered by start."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):  # pieces of the buffer, so that the tables of powers stay small
        j = max(i + 1, int(np.searchsorted(end, start[i] + BATCH_BYTES, "right")))
        a, b = int(start[i]), int(end[i:j].max())
        n = b - a
        sums = np.zeros(n + 1, U)
        np.cumsum((buffer[a:b].astype(U) + U(1)) * _powers(_P, n), out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _powers(_INVERSE, n)[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def words_of(texts: list[bytes], lower: bool = True) -> Words:
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    if lower:
        buffer = LOWER[buffer]
    start, end = _spans(buffer)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    text = np.searchsorted(begin, start, "right") - 1
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    return Words(buffer, hash_spans(buffer, start, end), text, start, end, first)


def batches(texts: list[bytes | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in order, in lists of about `most` bytes, each with the number of its first; null texts as empty."""
    at, size, out = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if out and size + len(t) > most:
            yield at, out
            at, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield at, out


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of n words within one text, and the number of its first word."""
    if n == 1:
        return w.hash, np.arange(len(w.hash))
    if len(w.hash) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    h = w.hash[: len(w.hash) - n + 1] * U(0x8CB92BA72F3D8DD7 + 2 * n)
    for k in range(1, n):
        h = mix(h + w.hash[k : len(w.hash) - n + 1 + k]) * U(0xA0761D6478BD642F + 2 * k)
    at = np.flatnonzero(w.text[: len(w.text) - n + 1] == w.text[n - 1 :])
    return h[at], at
