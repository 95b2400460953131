"""Vectorised words, word hashes and window hashes over Arrow text columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Everything works
on whole batches with numpy; no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15 | 1)
#: For what must come out alike in every run and is checked by other means, such as min-hash labels.
FIXED_KEY = bytes(range(16))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG = 64
_WMUL = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_WINV = tuple(U(pow(int(m), -1, 1 << 64)) for m in _WMUL)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_power_cache: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; grown on demand and kept."""
    kept = _power_cache.get(int(base))
    if kept is None or len(kept) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        kept = np.empty(size, U)
        kept[0] = 1
        kept[1:] = base
        np.multiply.accumulate(kept, out=kept)
        if size <= 1 << 23:
            _power_cache[int(base)] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    at = bounds[:-1][full]
    first[at] = inside[at]
    at = bounds[1:][full] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds[1:], starts, side="right")


def draw_key() -> bytes:
    """A secret for the hashes of one run, drawn on the driver and sent with its functions: who wrote the texts did not know it."""
    return os.urandom(16)


@lru_cache(maxsize=64)
def _word_keys(key: bytes) -> np.ndarray:
    """Numbers of 32 bits for both lanes, each block of eight bytes and its halves; and two for the end."""
    lanes = [np.frombuffer(hashlib.blake2b(bytes([lane]), digest_size=64, key=key).digest() + hashlib.blake2b(bytes([lane, 1]), digest_size=64, key=key).digest(), "<u4") for lane in range(2)]
    return np.stack(lanes).astype(U)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes = FIXED_KEY) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Words of up to ``LONG`` bytes: in two lanes, both halves of every eight bytes are added to numbers of the key, multiplied,
    and the products added up. Whatever two words are, their sums in a lane agree for one key in 2**32, and the lanes' keys are
    independent; so without the key no two words can be written that agree. Longer words go through keyed BLAKE2b.
    """
    size = ends - starts
    if not len(size):
        return np.empty(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    numbers, half = _word_keys(key), U(0xFFFFFFFF)
    lanes = np.zeros((2, len(size)), U)
    live, at, left, block = np.arange(len(size)), starts, size, 0
    odd = np.flatnonzero(size > LONG)
    if len(odd):
        few = size <= LONG
        live, at, left = live[few], at[few], left[few]
    while len(live):
        x = eight[at] & _LOW[np.minimum(left, 8)]
        low, high = x & half, x >> U(32)
        for lane in range(2):
            a, b = numbers[lane, 2 * block : 2 * block + 2]
            product = ((low + a) & half) * ((high + b) & half)
            if block:
                lanes[lane, live] += product
            else:
                lanes[lane, live] = product
        more = left > 8
        live, at, left, block = live[more], at[more] + 8, left[more] - 8, block + 1
    h = mix(mix(lanes[0] ^ size.astype(U) * U(0xC2B2AE3D27D4EB4F)) + lanes[1] * U(0xD6E8FEB86659FD93))
    for k in odd.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=key).digest(), "little")
    return h


def window_starts(rows: np.ndarray, width: int) -> np.ndarray:
    """Positions at which ``width`` words in a row belong to one text."""
    if len(rows) < width:
        return np.empty(0, np.int64)
    return np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])


def hash_windows(words: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the words of each window; ``which`` picks one of two independent ones."""
    sums = np.zeros(len(words) + 1, U)
    w = words if which == 0 else mix(words ^ U(0x5851F42D4C957F2D))
    np.cumsum(w * powers(_WMUL[which], len(words) + 1)[:-1], out=sums[1:])
    return mix((sums[at + width] - sums[at]) * powers(_WINV[which], len(words) + 1)[at])


def row_batches(bounds: np.ndarray, most: int = 2_000_000):
    """Ranges of rows of about ``most`` bytes, so that temporary arrays stay small; a longer row stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a column."""
    data, bounds = text_bytes(column)
    hashes, rows = [np.empty(0, U)], [np.empty(0, np.int64)]
    for i, j in row_batches(bounds):
        part = data[bounds[i] : bounds[j]]
        s, e, r = split_words(part, bounds[i : j + 1] - bounds[i])
        hashes.append(hash_words(part, s, e))
        rows.append(r + i)
    return np.concatenate(hashes), np.concatenate(rows)
