"""Fuzzy line deduplication: of the lines that are alike, across all documents, one stays.

A line is what stands between line breaks and has a word.  Its set is all runs of
so many characters (code points), A-Z lower-cased; a shorter line is one run.  One
length does not serve all lines: short runs make long lines of one language alike,
and long runs break too many of a short line's.  So there are two kinds:

- short, under 80 characters: runs of 4, so one changed character leaves a line of
  39 and more alike; 20 bands of 6 MinHash values, as unrelated lines share some runs;
- long, from 64 characters: runs of 8; 12 bands of 4 values, by one permutation in
  48 bins (an empty bin borrows a full one's value), or a hash function each for few runs.

Two lines are alike if they are of one kind and have a Jaccard similarity of 0.8 or
more in its runs.  Lines of 64 to 79 characters are of both kinds, and a line under
64 cannot reach 0.8 with one of 80 (60 runs and 77), so nothing is lost between
them, unless a line repeats itself.  Lines alike share a band with probability 0.998.
Lines that meet in a band are verified on their sets and connected (see ``neardup``);
equal lines are one item.  The first line of each component, by document id and
place, is kept.  Lines are known by 62-bit digests, runs by 44 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import KEY_BITS, Sets, group, sieve, sifted
from .storage import stored
from .text import LOWER, SPACE, U64, Texts, distinct, mix, prefix_hash, slices, span_hash, texts_of


class Kind(NamedTuple):
    size: int  # characters of a run
    bands: int
    rows: int

    @property
    def values(self) -> int:
        return self.bands * self.rows


SHORT, LONG = KINDS = Kind(4, 20, 6), Kind(8, 12, 4)
#: Lines of fewer characters are short; lines of this many and more are long.
BELOW, FROM = 80, 64
#: Long lines of fewer runs than this get a hash function for each value.
FEW_RUNS = 96
#: Characters worked on at once: the arrays of so many stay in a core's cache.
BLOCK = 1 << 15
#: Fixed odd multipliers of the hash functions and of the characters of a run, from a counter.
MULTIPLIERS = mix(np.arange(1, SHORT.values + 1, dtype=U64)) | U64(1)
PLACES = mix(np.arange(1000, 1004, dtype=U64)) | U64(1)
#: The lowest bits of an item's id: 1 for the long kind, 2 if its line has both.
KIND_BIT, TWIN_BIT = 1, 2


def lines_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, line number) of every line with a word."""
    breaks = np.flatnonzero(t.data == 10)
    start = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([t.offsets[1:], breaks]))
    doc = np.repeat(np.arange(len(t)), 1 + np.diff(np.searchsorted(breaks, t.offsets)))
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    live = end > start
    live[live] = ~SPACE[t.data[start[live]]]
    # Most lines begin with a word; of the others all bytes are looked at.
    rest = np.flatnonzero((end > start) & ~live)
    n = end[rest] - start[rest]
    at = np.arange(int(n.sum())) + np.repeat(start[rest] - (np.cumsum(n) - n), n)
    live[np.repeat(rest, n)[~SPACE[t.data[at]]]] = True
    return start[live], end[live], doc[live], number[live]


def characters(data: np.ndarray) -> np.ndarray:
    """The code points, A-Z lower-cased."""
    return np.frombuffer(LOWER[data].tobytes().decode().encode("utf-32-le"), np.uint32)


def places(data: np.ndarray, *at: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many characters stand before some bytes."""
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    return tuple(a - np.searchsorted(inner, a) for a in at)


def run_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """For each place the hash of the ``size`` characters from there on (zeros after the end)."""
    out = np.empty(len(points), U64)
    for a in range(0, len(points), BLOCK):
        part = points[a : a + BLOCK + size - 1]
        h = out[a : a + BLOCK]
        pair = np.zeros(len(h) + size, U64)
        pair[: len(part)] = part
        pair[: len(part) - 1] |= part[1:].astype(U64) << U64(21)
        np.multiply(pair[: len(h)], PLACES[0], out=h)
        for k in range(2, size, 2):
            h += pair[k : k + len(h)] * PLACES[k // 2]
        scattered(h)
    return out


def scattered(h: np.ndarray) -> np.ndarray:
    h ^= h >> U64(32)
    h *= U64(0x94D049BB133111EB)
    return h


def runs(points: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of all runs of the lines, in order, with repeats; a line of fewer characters is one run, filled up with zeros."""
    n = np.where(end > start, np.maximum(end - start - size + 1, 1), 0)
    line = np.repeat(np.arange(len(start), dtype=np.int32), n)
    at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n - start, n)
    x = hashes[at]
    for k in np.flatnonzero((n == 1) & (end - start < size)).tolist():  # rare: the hash of the line alone
        x[np.searchsorted(line, k)] = run_hashes(np.concatenate([points[start[k] : end[k]], np.zeros(size, np.uint32)]), size)[0]
    return line, x


def blocks(points: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some lines, in order, a block of characters at a time (one line at least): (their rows, line within these, hash of each run)."""
    ends = np.cumsum(end[rows] - start[rows])
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        some = rows[a:b]
        x, y = start[some], end[some]
        text = points[x[0] : y[-1]]
        x, y = x - x[0], y - x[0]
        n = y - x
        if 2 * int(n.sum()) < len(text):  # what stands between them is left out
            to = np.cumsum(n)
            text = text[np.arange(int(to[-1])) + np.repeat(x - (to - n), n)]
            x, y = to - n, to
        yield some, *runs(text, run_hashes(text, size), x, y, size)
        a = b


def signatures(points: np.ndarray, start: np.ndarray, end: np.ndarray, kind: Kind) -> np.ndarray:
    """The MinHash values (32 bits) of each line."""
    out = np.full((len(start), kind.values), np.iinfo(np.uint32).max, np.uint32)
    if not len(start):
        return out
    few = (end - start) < FEW_RUNS + kind.size if kind is LONG else np.ones(len(start), bool)
    for many in (False, True):
        for some, line, x in blocks(points, start, end, np.flatnonzero(few != many), kind.size):
            if many:
                part = np.full(len(some) * kind.values, np.iinfo(np.uint32).max, np.uint32)
                value = (x >> U64(32)).astype(np.uint32)
                place = (((x & U64(0xFFFFFFFF)) * U64(kind.values)) >> U64(32)).astype(np.int64)
                place += line.astype(np.int64) * kind.values
                np.minimum.at(part, place, value)
                out[some] = part.reshape(-1, kind.values)
            else:
                first = np.searchsorted(line, np.arange(len(some)))
                part, product = np.empty((kind.values, len(some)), U64), np.empty_like(x)
                for k in range(kind.values):
                    np.multiply(x, MULTIPLIERS[k], out=product)
                    np.minimum.reduceat(product, first, out=part[k])
                out[some] = (part.T >> U64(32)).astype(np.uint32)
    if kind is LONG and not few.all():
        out[~few] = borrowed(out[~few])
    return out


def borrowed(part: np.ndarray) -> np.ndarray:
    """Empty bins take the value of a full bin, found by trying bins in an order of their own."""
    empty, bins = np.iinfo(np.uint32).max, part.shape[1]
    out, (row, column) = part.copy(), np.nonzero(part == empty)
    for attempt in range(1, 10 * bins):
        if not len(row):
            break
        source = (mix(column.astype(U64) * U64(1009) + U64(attempt)) % U64(bins)).astype(np.int64)
        value = part[row, source]
        hit = value != empty
        out[row[hit], column[hit]] = value[hit]
        row, column = row[~hit], column[~hit]
    return out


def bands(points: np.ndarray, start: np.ndarray, end: np.ndarray, kind: Kind) -> np.ndarray:
    values = signatures(points, start, end, kind).astype(U64)
    h = np.full((len(start), kind.bands), U64(kind.size))
    for k in range(kind.rows):
        h = mix(h * U64(0xA0761D6478BD642F) + values[:, k :: kind.rows] + np.arange(kind.bands, dtype=U64)[None, :])
    return h


def identified(t: Texts, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id of each line (of its short kind, if it has both), from its characters' number too, and whether it is short, and long."""
    short, long = size < BELOW, size >= FROM
    digest = np.empty(len(start), U64)
    cuts = np.searchsorted(start, np.arange(0, len(t.data) + BLOCK, BLOCK)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            digest[a:b] = span_hash(prefix_hash(t.data[start[a] : end[b - 1]]), start[a:b] - start[a], end[a:b] - start[a])
    digest &= ~U64(KIND_BIT | TWIN_BIT)
    digest |= np.where(short & long, U64(TWIN_BIT), np.where(long, U64(KIND_BIT), U64(0)))
    return digest.view(np.int64), short, long


LINES = "id long, doc_id long, line int, bands array<long>"


def signed(rows: DataFrame) -> DataFrame:
    """Every line and its id; bands at its first place in a slice only.  A line of both kinds has another row, of line -1, for the long kind's bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t = texts_of(b.column("text"))
            start, end, doc, number = lines_of(t)
            text = characters(t.data)
            x, y = places(t.data, start, end)
            ids, short, long = identified(t, start, end, y - x)
            first = np.zeros(len(ids), bool)
            first[np.unique(ids, return_index=True)[1]] = True
            low, high = np.flatnonzero(first & short), np.flatnonzero(first & long)
            single, twin = high[~short[high]], high[short[high]]
            lower, upper = bands(text, x[low], y[low], SHORT), bands(text, x[high], y[high], LONG)
            n = np.zeros(len(ids) + len(twin), np.int64)
            n[low], n[single], n[len(ids) :] = SHORT.bands, LONG.bands, LONG.bands
            cuts = np.concatenate([[0], np.cumsum(n)])
            flat = np.empty(int(cuts[-1]), U64)
            place = np.empty(len(high), np.int64)
            place[~short[high]], place[short[high]] = cuts[single], cuts[len(ids) : -1]
            flat[cuts[low][:, None] + np.arange(SHORT.bands)] = lower
            flat[place[:, None] + np.arange(LONG.bands)] = upper
            docs = pa.concat_arrays([b.column("doc_id").take(pa.array(doc)), pa.nulls(len(twin), pa.int64())])
            line = np.concatenate([number, np.full(len(twin), -1)]).astype(np.int32)
            all_bands = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.record_batch([pa.array(np.concatenate([ids, ids[twin] | KIND_BIT])), docs, pa.array(line), all_bands], ["id", "doc_id", "line", "bands"])

    return rows.mapInArrow(sign, LINES)


#: What stands before the text of an item to tell its kind.
MARKS = (b"s", b"l")


def sets(column: pa.Array) -> Sets:
    """The sets of runs of marked lines."""
    t = texts_of(column)
    text = characters(t.data)
    start, end = places(t.data, t.offsets[:-1], t.offsets[1:])
    start = start + 1
    is_long = t.data[t.offsets[:-1]] == MARKS[1][0] if len(t) else np.zeros(0, bool)
    keys = [np.zeros(0, U64)]
    for kind, rows in ((SHORT, np.flatnonzero(~is_long)), (LONG, np.flatnonzero(is_long))):
        for some, line, x in blocks(text, start, end, rows, kind.size):
            # Lines come in order: a block is sorted alone.
            keys.append(distinct((some[line].astype(U64) << U64(KEY_BITS)) | (x >> U64(64 - KEY_BITS))))
    key = np.concatenate(keys)
    if is_long.any() and not is_long.all():
        key.sort()
    return Sets((key >> U64(KEY_BITS)).astype(np.int64), key & U64((1 << KEY_BITS) - 1), np.broadcast_to(np.int64(1), len(key)), np.broadcast_to(1.0, len(key)))


def fuzzy_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(doc_id, line, first_doc_id, first_line, kept) of every line that has a like one.

    ``line`` counts from 0 within the text; the first line of a class, by document
    id and number, is the one kept.  Null and empty texts and blank lines have no
    part; rows without an id come before all others.  Repeated rows are lines like
    any other; of the same line of equal rows all are kept if it is the first.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = stored(signed(rows), "lines")
    items = lines.where("size(bands) > 0").select("id", "bands")

    def fetch(ids: DataFrame) -> DataFrame:
        """The lines of some ids, from the documents again; a filter of fixed size leaves most others behind."""
        wanted = sieve(ids.select(F.expr("shiftright(id, 2)").alias("id")))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                t = texts_of(b.column("text"))
                start, end, _, _ = lines_of(t)
                x, y = places(t.data, start, end)
                digest, _, _ = identified(t, start, end, y - x)
                some = np.flatnonzero(sifted(digest >> 2, wanted))
                some = some[np.unique(digest[some], return_index=True)[1]]
                raw = t.data.tobytes()
                for kind in (0, 1):
                    of = some[(digest[some] & KIND_BIT == kind) | (digest[some] & TWIN_BIT != 0)]
                    text = [MARKS[kind] + raw[x:y] for x, y in zip(start[of].tolist(), end[of].tolist())]
                    yield pa.record_batch([pa.array(digest[of] | kind), pa.array(text, pa.binary()).cast(pa.string())], ["id", "text"])

        return rows.mapInArrow(find, "id long, text string").join(ids, "id", "left_semi").dropDuplicates(["id"])

    def twins(ids: DataFrame) -> DataFrame:
        """A line of both kinds is one line."""
        return ids.where(F.col("id").bitwiseAND(TWIN_BIT) != 0).select(F.col("id").alias("a"), F.col("id").bitwiseXOR(KIND_BIT).alias("b"))

    comp = group(items, fetch, sets, least, twins)
    classed = lines.where("line >= 0").select("id", "doc_id", "line").join(comp, "id", "left").select("doc_id", "line", F.coalesce("component", "id").alias("class"))
    classed = stored(classed, "classes")
    first = classed.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return classed.join(first, "class").select("doc_id", "line", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), (F.struct("doc_id", "line") == F.col("first")).alias("kept"))
