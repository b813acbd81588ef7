"""Hashes of words, word windows and byte windows of whole Arrow batches, with numpy inside tasks.

A batch's texts lie in one byte buffer; every figure is computed for all of them at once. Hashes are 64 bits, the same in
every process (no seeded hashing), computed modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BACK = U(pow(int(BASE), -1, 2**64))
_BYTES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
WORDS = 1 << 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1)."""
    out = np.ones(max(n, 1), U)
    filled = 1
    step = base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
        step = U(int(step) ** 2 % 2**64)
    return out[:n]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes with ``is_word``, never across texts) and their texts' numbers."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = inside[0]
        first[1:] = inside[1:-1] & ~inside[:-2]
        cut = at[:-1][(at[:-1] < len(data)) & (at[1:] > at[:-1])]
        first[cut] = inside[cut]
        last = inside[:-1] & ~inside[1:]
        ends = at[1:][at[1:] > at[:-1]] - 1
        last[ends] = inside[ends]
    else:
        last = first
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(at, starts, side="right") - 1


SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word."""
    out = np.empty(len(starts), U)
    size = WORDS  # words at a time, so that the running sums stay small
    for i in range(0, len(starts), size):
        a, b = starts[i : i + size], stops[i : i + size]
        lo, hi = int(a[0]), int(b[-1])
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTES[data[lo:hi]] * powers(BASE, hi - lo), out=sums[1:])
        out[i : i + size] = mix((sums[b - lo] - sums[a - lo]) * powers(BACK, hi - lo + 1)[a - lo])
    return out


def window_hashes(words: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one text, and the number of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = np.zeros(n, U)
    for j in range(k):
        out = mix(out * BASE + words[j : j + n])
    at = np.flatnonzero(texts[:n] == texts[k - 1 :])
    return out[at], at


def byte_window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive bytes of the buffer, across texts too."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers(BACK, n))
