"""Words of many texts at once, as numpy arrays.

A batch of texts arrives as one Arrow buffer; words are found and hashed on that buffer without
making a Python string per word. A word is a run of bytes that are ASCII letters, digits or not
ASCII; A-Z count as a-z. A word's hash is a polynomial over a random table of its bytes, taken as
a difference of prefix sums modulo 2^64 and then mixed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_ids = np.arange(256)
IS_WORD = ((_ids >= 48) & (_ids <= 57)) | ((_ids >= 65) & (_ids <= 90)) | ((_ids >= 97) & (_ids <= 122)) | (_ids >= 128)
_FOLD = np.where((_ids >= 65) & (_ids <= 90), _ids + 32, _ids)
_RAW = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
FOLDED = _RAW[_FOLD]
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + U(0x9E3779B97F4A7C15)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(base), np.uint64)]))
        _POWERS[base] = have
    return have[:n]


def prefix_sums(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of values[buf[k]] * base^k for i <= k < j."""
    c = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[buf] * powers(_BASE, len(buf)), out=c[1:])
    return c


def range_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever the range stands."""
    with np.errstate(over="ignore"):
        return mix((c[end] - c[start]) * powers(_INV, len(c))[start] + (end - start).astype(np.uint64))


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a batch of texts into runs of whole texts of about ``limit`` bytes.

    Yields (index of the first text, bytes, offsets of each text in them); a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of each word; no word crosses the end of a text."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    w = IS_WORD[buf]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(w & ~before)
    return start, np.flatnonzero(w & ~after) + 1, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with a last entry for the end)."""
    start, end, doc = word_spans(buf, off)
    h = range_hash(prefix_sums(buf, FOLDED), start, end) if len(start) else np.zeros(0, np.uint64)
    return h, np.searchsorted(doc, np.arange(len(off)))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside each text -> (hash, text index, word position)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for i in range(k):
            g = mix(g * U(0xD6E8FEB86659FD93) + h[i:i + n])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = np.arange(n) + k <= first[1:][doc]
    at = np.flatnonzero(inside)
    return g[at], doc[at], at - first[:-1][doc[at]]
