"""Words of Arrow text batches as flat numpy arrays.

A word is a run of characters other than space and U+0009 to U+000D; null and blank texts have none.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multiplier of the rolling hashes (fixed value, the 64-bit golden ratio).
ROLL = 0x9E3779B97F4A7C15
#: Text bytes handled at once in a worker; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text or one row; at the end, unused memory goes back."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, total = stop, int(ends[stop - 1])
        del batch
    give_back()


def give_back() -> None:
    """Return a worker's free memory to the system: Arrow's, and the C library's where that can be asked."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after another, and len + 1 offsets of each text's words."""
    lists = pc.ascii_split_whitespace(texts)
    values = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves empty strings
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        values, offsets = values.filter(pa.array(full)), kept[offsets]
    return values, offsets.astype(np.int64)


def runs_of(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and flat index of each run of ``width`` words that lies in one text."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows, places, offsets[rows] + places


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words."""
    if len(words) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    codes, distinct = word_codes(words)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
    return table[codes] if len(codes) else np.zeros(0, np.uint64)


def rolling(hashes: np.ndarray, width: int, base: int = ROLL) -> np.ndarray:
    """Polynomial hashes of all runs of ``width`` consecutive words, by doubling."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, level, size = None, 0, hashes, 1
        while True:  # level: hashes of runs of size words; out: of the first done words of each run
            if width & size:
                if out is None:
                    out, done = level, size
                else:
                    n = len(hashes) - done - size + 1
                    out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + level[done : done + n]
                    done += size
            if size * 2 > width:
                return out
            n = len(hashes) - 2 * size + 1
            level = level[:n] * np.uint64(pow(base, size, 1 << 64)) + level[size : size + n]
            size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
