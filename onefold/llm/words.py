"""Words of Arrow text batches as flat numpy arrays: places, documents and hashes, without a loop over words.

A word is a longest run of characters that are none of the space and U+0009 to U+000D. A word or line is hashed eight
bytes at a time, each step mixed before the next, so that no two are equal for all seeds; longer ones and whole texts
are hashed by BLAKE2. Windows of words are polynomials over the words' hashes modulo the prime 2**31 - 1, taken by
differences of prefix sums (Rabin-Karp), two bases a seed: 62 bits. Two seeds give independent hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The pattern of a word, for SQL and brute-force tests.
PATTERN = r"[^\x20\x09-\x0D]+"

#: Powers that a worker makes at first, and keeps at most, for each base.
FIRST_POWERS, KEPT_POWERS = (1 << 17) + 1, 1 << 20
#: Bytes of the longest span that is hashed in steps.
STEPPED = 1024

PRIME = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)
_GOLDEN = 0x9E3779B97F4A7C15
_WHOLE = 0xFFFFFFFFFFFFFFFF

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end]."""
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) + np.uint64((2 * seed + 1) * _GOLDEN & _WHOLE))
    chunks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))  # eight bytes from each place
    longs = np.flatnonzero(sizes > STEPPED)
    live, at, left = np.arange(len(starts)), starts, sizes
    if len(longs):
        live = np.flatnonzero((sizes <= STEPPED) & (sizes > 0))
        at, left = starts[live], sizes[live]
    while len(live):
        step = chunks[at] & np.uint64(_WHOLE) >> (np.uint64(8) * np.clip(8 - left, 0, 8).astype(np.uint64) & np.uint64(63))
        if len(live) == len(out):
            out = mixed(out ^ step)
        else:
            out[live] = mixed(out[live] ^ step)
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in longs:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 modulo PRIME, but that 0 may be PRIME itself."""
    x = (x & PRIME) + (x >> _BITS)
    return (x & PRIME) + (x >> _BITS)


class Rolling:
    """Powers of a base and of its inverse modulo PRIME."""

    def __init__(self, seed: int):
        self.base = int(mixed(np.array([(seed + 0x1234567) * _GOLDEN & _WHOLE], np.uint64))[0]) % (int(PRIME) - 2) + 2
        self.inverse = pow(self.base, -1, int(PRIME))
        self._up = self._down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, done = np.ones(n, np.uint64), 1
        while done < n:  # what is there, times the next power
            some = min(done, n - done)
            out[done : done + some] = _reduced(out[:some] * np.uint64(pow(base, done, int(PRIME))))
            done += some
        return out

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) >= n:
            return self._up, self._down
        n = max(n, FIRST_POWERS)
        up, down = self._powers(self.base, n), self._powers(self.inverse, n)
        if n <= KEPT_POWERS:  # those for a very long text go with it
            self._up, self._down = up, down
        return up, down

    def spans(self, values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """The polynomials of values[start:start + width], below PRIME; values are below PRIME or equal to it."""
        up, down = self.powers(len(values) + 1)
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_reduced(values * up[: len(values)]), out=sums[1:])
        found = _reduced(_reduced(sums[starts + width] - sums[starts]) * down[starts])
        return np.where(found == PRIME, np.uint64(0), found)


@lru_cache(maxsize=16)
def rolling(seed: int = 0) -> Rolling:
    return Rolling(seed)


@dataclass
class Words:
    """Words of some texts in order. doc: the text's number in the batch; start and end: bytes in data."""

    data: np.ndarray
    text_starts: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_texts: int

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n_texts)

    def first_words(self) -> np.ndarray:
        """The number of the first word of each text, with the end."""
        return np.searchsorted(self.doc, np.arange(self.n_texts + 1))

    def digests(self) -> np.ndarray:
        """128 bits of BLAKE2 of all the words of each text with one space between, as two numbers a row."""
        at = self.first_words()
        keep = ~_SPACE[self.data]
        between = self.end[:-1][self.doc[1:] == self.doc[:-1]]
        plain = self.data.copy()
        plain[between] = 0x20
        keep[between] = True
        plain = memoryview(plain[keep])
        sums = np.concatenate([[0], np.cumsum(self.end - self.start + np.append(self.doc[1:] == self.doc[:-1], False)[: len(self.doc)])])
        found = b"".join(hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(sums[at[:-1]].tolist(), sums[at[1:]].tolist(), strict=True))
        return np.frombuffer(found, np.int64).reshape(-1, 2)

    def windows(self, width: int) -> np.ndarray:
        """The first word of each window of `width` consecutive words of one text."""
        if len(self.doc) < width:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - width + 1] == self.doc[width - 1 :])


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Of each window of `width` words from `first` on, given the 64-bit hashes of the words: 62 bits, mixed."""
    if not len(first):
        return np.zeros(0, np.uint64)
    low, high = hashes & PRIME, hashes >> _BITS & PRIME
    one, two = (rolling(2 * seed + k).spans(values, first, width) for k, values in enumerate((low, high)))
    return mixed(one << _BITS | two)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and where each text starts, with the end."""
    texts = texts.cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def words(texts: pa.Array) -> Words:
    data, at = buffers(texts)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]  # a text's end is a word's end
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    return Words(data, at, doc, start, end, len(texts))
