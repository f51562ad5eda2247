"""Vectorised tokenising and hashing of UTF-8 bytes.

Hashes are 64-bit; equal hashes are taken as equal strings unless a caller verifies them.
"""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 5
_M64 = (1 << 64) - 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i mod 2**64 for i < n."""
    global _pow, _ipow
    if len(_pow) < n:
        size = 1 << int(n - 1).bit_length()
        inv = pow(_R, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _R, np.uint64)], dtype=np.uint64)
            _ipow = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inv, np.uint64)], dtype=np.uint64)
    return _pow, _ipow


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = R**i times the polynomial hash of data[i:j]."""
    p, _ = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * p[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, ip = _powers(len(c))
    with np.errstate(over="ignore"):
        return mix((c[ends] - c[starts]) * ip[starts] + (ends - starts).astype(np.uint64))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = lower_table()


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the texts' offsets into them. Words end with their text."""
    n = len(data)
    w = is_word[data]
    s = w.copy()
    s[1:] &= ~w[:-1]
    at = offs[:-1][offs[:-1] < n]
    s[at] = w[at]
    e = w.copy()
    e[:-1] &= ~(w[1:] & ~s[1:])
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offs)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes, by start; text bounds are the caller's."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * np.uint64(0xBF58476D1CE4E5B9) + h[j : j + n]
    return mix(acc)
