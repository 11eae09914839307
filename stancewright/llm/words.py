"""Words of a text and hashes of word windows, on NumPy arrays inside a task.

A word is a maximal run of bytes other than blank and the control characters 9 to 13, which
is how ``bytes.split`` cuts. Hashes are polynomials modulo 2**64 over 64-bit word hashes,
in the rolling form of Rabin and Karp: prefix sums give every window in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xC2B2AE3D27D4EB4F
_WORD = 1 << 64


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; NULL is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base % _WORD, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of every ``width`` consecutive entries, one for each start."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(pow(base, -1, _WORD), n), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * _powers(base, n - width + 1))


#: A Mersenne prime, so that remainders need no division.
PRIME = (1 << 61) - 1
_HALF = np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo ``PRIME``, of anything below 2**63."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _product(a: np.ndarray, b) -> np.ndarray:
    """Modulo ``PRIME``, of numbers below it, by halves of 31 bits."""
    b = np.asarray(b, np.uint64)
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _HALF, b >> np.uint64(31), b & _HALF
    middle = a_high * b_low + a_low * b_high
    # 2**62 is 2, and 2**61 is 1.
    high = np.uint64(2) * a_high * b_high + (middle >> np.uint64(30))
    return _reduced(_reduced(high + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31))) + _reduced(a_low * b_low))


def _prime_powers(base: int, n: int) -> np.ndarray:
    powers = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        powers[done : done + step] = _product(powers[:step], pow(base, done, PRIME))
        done += step
    return powers[:n]


def prime_window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries by a polynomial modulo ``PRIME``, in the rolling form.

    Two different windows have one hash for at most ``width`` of the possible bases, so with a base drawn
    when the texts are there already, no text can bring it about.
    """
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    terms = _product(_reduced(words >> np.uint64(2)), _prime_powers(pow(base, -1, PRIME), n))
    sums = np.zeros(n + 1, np.uint64)
    # Halves add up without passing 64 bits for texts of up to 2**33 words.
    low, high = np.cumsum(terms & _HALF), np.cumsum(terms >> np.uint64(31))
    sums[1:] = _reduced(_product(_reduced(high), np.uint64(1 << 31)) + _reduced(low))
    return _product(_reduced(sums[width:] + np.uint64(PRIME) - sums[:-width]), _prime_powers(base, n - width + 1))


def starts_inside(lengths: Iterable[int], width: int) -> np.ndarray:
    """Of texts laid end to end: which positions start a window that ends in the same text."""
    lengths = np.asarray(list(lengths), np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
    return left >= width


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows; fewer words count as one window."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(width, len(words))))
