"""Words of concatenated UTF-8 texts and their hashes, on whole Arrow buffers."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of a word: ASCII letters and digits, and all bytes of other characters; A-Z become a-z.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * PRIME
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, PRIME, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words before each text) of concatenated texts.

    A word never runs over the end of a text.
    """
    lower = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_WORD[raw]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]
    begins[joined] = True
    ends[joined] = True
    starts, stops = np.flatnonzero(begins[: len(raw) + 1]), np.flatnonzero(ends[: len(raw) + 1])
    return lower, starts, stops, np.searchsorted(starts, offsets)


def word_hashes(lower: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from one pass of prefix sums over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    flat = np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    power = _powers(int(sizes.max()))
    terms = (lower[flat].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(flat)) - np.repeat(first, sizes)]
    return mixed(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * MIX)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` word hashes; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * PRIME + hashes[k : k + n]
    return mixed(out + np.uint64(size))


#: A second multiplier, and the inverses modulo 2**64 of both, which move a run's hash to the exponent 0.
PRIME_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    table = _POWERS.get(prime)
    if table is None or len(table[0]) < n:
        size = max(n, 1 << 20)
        table = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, p, np.uint64)])) for p in (prime, pow(prime, -1, 1 << 64)))
        if size <= 1 << 22:  # tables for one very long text aren't kept
            _POWERS[prime] = table
    return table


class Spans:
    """Hashes of byte runs of a buffer in constant time each: equal bytes, equal hash, in any buffer."""

    def __init__(self, raw: np.ndarray, prime: np.uint64 = PRIME) -> None:
        power, self.inverse = _power_table(int(prime), len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]
