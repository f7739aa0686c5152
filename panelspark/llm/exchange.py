"""Shuffling many small keys as a few packed arrays.

A block of documents sends each of its distinct 64-bit keys once, sorted, to the
shard that owns it; a shard meets the arrays of all blocks, and may answer with
one value for each key in the order in which it came.  Keys are dealt by their
hash after this aggregation within a block, so no key is hot however often it
occurs, and a row of the shuffle is an array, not a key.
"""

from __future__ import annotations

import numpy as np
import zstandard

U64 = np.uint64


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Non-negative integers as zstd-compressed byte planes."""
    values = np.ascontiguousarray(values, dtype=U64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width]
    head = len(values).to_bytes(8, "little") + bytes([width])
    return head + zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view(U64).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U64)


def deal(keys: np.ndarray, shards: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (shard, key within the shard), where each shard begins in it, and the ordered keys.

    ``bits`` is how much of a key is sent: less where a rare confusion is harmless.
    """
    if bits < 64:
        keys = keys >> U64(64 - bits)
    shard = (keys % U64(shards)).astype(np.int64)
    inner = keys // U64(shards)
    if bits + int(shards).bit_length() <= 64:
        order = np.argsort((shard.astype(U64) << U64(bits)) | inner)
    else:
        order = np.lexsort((inner, shard))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return order, cuts, inner[order]


def summed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key, the sum of the counts of all that equal it."""
    order = np.argsort(keys)
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(s) else counts
    out = np.empty(len(keys), counts.dtype)
    out[order] = np.repeat(total, np.diff(np.append(first, len(s))))
    return out
