"""Vectorised views of Arrow text columns: words, hashes, lines, per-document sums.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All of those
are single bytes of UTF-8, so words can be found on the raw bytes of an Arrow
column without making a Python string of any document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 1 << 20


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


SPACE, LOWER = space_table(), lower_table()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64): every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def process_cache() -> dict:
    """What a worker process keeps from task to task; it is not shipped with functions.

    An entry under a pair is one operator's own, named first: ``slices`` drops it when another operator begins.
    """
    return sys.__dict__.setdefault("_panelspark_cache", {})


def powers(n: int) -> np.ndarray:
    """Powers of BASE modulo 2**64, up to n at least; a worker keeps those that a slice needs, not those of a longer text."""
    cache = process_cache()
    if n > SLICE_BYTES or "powers" not in cache:
        t = np.full(max(n, SLICE_BYTES) + 1, BASE, U64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        if n > SLICE_BYTES:
            return t
        cache["powers"] = t
    return cache["powers"]


class Texts(NamedTuple):
    """The bytes of some documents and where each begins (one more for the end)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """A view of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of at most so many bytes of text (one row at least).

    Workers are used again by later stages: what they keep of operators other than ``keeps`` is dropped first.
    """
    import pyarrow.compute as pc

    drop_kept(keeps)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def drop_kept(keeps: str = "") -> None:
    """Drop what this worker keeps of operators other than ``keeps``."""
    cache = process_cache()
    if others := [k for k in cache if isinstance(k, tuple) and k[0] != keeps]:
        for k in others:
            del cache[k]
        give_back()


def give_back() -> None:
    """Return freed memory to the system: idle workers share an executor's limit with those at work."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Words(NamedTuple):
    start: np.ndarray  # byte positions in the slice
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and one more
    doc: np.ndarray  # document of each word


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capital letters of Latin-1 (two bytes of UTF-8: C3 and 80 to 9E)."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def punctuation_table() -> np.ndarray:
    """Bytes between words where only letters, digits and non-ASCII characters count."""
    t = np.ones(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = False
    return t


PUNCTUATION = punctuation_table()


def words_of(t: Texts, space: np.ndarray = SPACE) -> Words:
    n = len(t.data)
    solid = ~space[t.data]
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(start, t.offsets)
    return Words(start, end, first, np.repeat(np.arange(len(t)), np.diff(first)))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, so that the hash of any span is one subtraction."""
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes wherever they lie."""
    # Every span is moved to the same power, which must not depend on the slice.
    out = (h[end] - h[start]) * powers(SLICE_BYTES)[np.maximum(SLICE_BYTES - start, 0)]
    if len(h) > SLICE_BYTES and (far := start > SLICE_BYTES).any():
        out[far] *= inverse_power(start[far] - SLICE_BYTES)
    return mix(out ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)) ^ U64(seed))


def inverse_power(n: np.ndarray) -> np.ndarray:
    inverse, out, n = U64(pow(int(BASE), -1, 1 << 64)), np.ones(len(n), U64), n.copy()
    while (n > 0).any():
        out = np.where(n & 1, out * inverse, out)
        with np.errstate(over="ignore"):
            inverse = inverse * inverse
        n >>= 1
    return out


def word_hashes(t: Texts, w: Words, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[t.data] if lower else t.data), w.start, w.end)


def shingle_hashes(h: np.ndarray, w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a document, and their documents.

    A document of fewer words (but some) has one shingle of all its words.
    """
    n = len(h)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    padded = np.concatenate([h, np.zeros(size, U64)])
    counts = np.diff(w.first)
    ends = np.repeat(w.first[1:], counts)
    out = np.zeros(n, U64)
    for k in range(size):
        here = padded[k : k + n]
        if k:
            here = np.where(np.arange(k, n + k) < ends, here, U64(0))
        out = mix(out * U64(0xA0761D6478BD642F) + here)
    at = np.arange(n)
    keep = (at + size <= ends) | ((np.repeat(counts, counts) < size) & (at == np.repeat(w.first[:-1], counts)))
    return out[keep], w.doc[keep]


def per_doc(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between cuts (positions, one more than there are documents)."""
    run = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=run[1:])
    return run[cuts[1:]] - run[cuts[:-1]]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (faster than hashing for 64-bit numbers)."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
