"""Polynomial hashes over a buffer of bytes, vectorised with numpy.

Hashes are modulo 2**64 with an odd base, so powers have inverses and the hash of any slice is one subtraction and one
product of prefix sums. Texts built to collide (Thue-Morse strings of 1024 bytes and more) are out of scope; callers for
which a collision would matter compare the bytes.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def byte_values(seed: int = 0) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(1009 + seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


@functools.lru_cache(4)
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    p = np.full(n, U64(base), U64)
    p[0] = 1
    q = np.full(n, U64(pow(base, -1, 2**64)), U64)
    q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below at least n."""
    return _powers(max(16, int(n).bit_length()), base)


def prefix(data: np.ndarray, seed: int = 0, base: int = BASE) -> np.ndarray:
    """P with P[i] = sum of value(data[j]) * base**j for j < i."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(byte_values(seed)[data] * powers(len(data), base)[0][: len(data)], out=out[1:])
    return out


def slices(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of each slice, whatever its place."""
    return (pre[end] - pre[start]) * powers(len(pre), base)[1][start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))
