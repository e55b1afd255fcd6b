"""Array kernels that several operators share: words, hashes and sliding windows.

Words are the runs of bytes between the six ASCII blanks, ``[^\\x20\\x09-\\x0D]+``, which is
exactly what ``bytes.split()`` yields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, n: int, base: int = BASE_A) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values, joined from runs of doubled lengths."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, covered, part, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, covered = part, size
            else:
                m = len(h) - covered - size + 1
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + part[covered : covered + m]
                covered += size
        if 2 * size > n:
            return mix(out)
        m = len(h) - 2 * size + 1
        part = part[:m] * np.uint64(pow(base, size, 1 << 64)) + part[size : size + m]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


def is_in(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values of x are in the sorted array found."""
    if not len(found):
        return np.zeros(len(x), bool)
    at = np.searchsorted(found, x)
    at[at == len(found)] = 0
    return found[at] == x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], most: int = 24_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes; a longer row stands alone."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * most / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def flat_rows(ids: list, parts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Each id once per value of its part, and the values one after another."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = pa.array(np.repeat(np.arange(len(ids)), sizes))
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.array(ids, pa.int64()).take(at), values
