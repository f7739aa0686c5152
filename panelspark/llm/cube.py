"""Mixing sources to target weights by the cube method.

A source's target over its size is how often each of its documents is wanted.
The whole part is taken outright; the rest is an inclusion probability.  The
cube method's flight moves the probabilities of three documents at a time along
the null space of the constraints (document count, words), so both totals stay
as they are while at least one probability becomes 0 or 1.  At most two
documents of a block are left undecided.  They meet in new blocks until a
source's rest fits in one; there the last two land where the words come nearest, and a few choices of that
block are undone if that helps.

Scale: a source is dealt into blocks of some thousand rows by a hash, however
large it is, so no source is hot.  Repeated rows are told apart by their
occurrence, or equal rows would share a block.  Only the list of sources, with
their sizes, comes to the driver.  All choices follow from hashes of the rows,
so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small_table, stored
from .text import U64, give_back, mix, slices, texts_of, words_of

BLOCK_ROWS = 4000
OWN = ["_mix_source", "_mix_size", "_mix_hash", "_mix_block", "_mix_p", "_mix_copies"]


def targets(sizes: dict, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> dict:
    """Words wanted of each source: shares of the total by weight, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    free, left = list(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Move probabilities, three at a time, keeping their sum and the expected words; at most two stay between 0 and 1."""
    p, eps = p.astype(float).tolist(), 1e-9
    size, dice = size.astype(float).tolist(), iter(random.tolist())
    waiting = iter([i for i, x in enumerate(p) if eps < x < 1 - eps])
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            move = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            move = (1.0, -1.0)
        else:
            break
        up = down = math.inf
        for i, m in zip(active, move):
            if m > 0:
                up, down = min(up, (1 - p[i]) / m), min(down, p[i] / m)
            elif m < 0:
                up, down = min(up, p[i] / -m), min(down, (1 - p[i]) / -m)
        step = up if next(dice) * (up + down) < down else -down
        for i, m in zip(active, move):
            x = p[i] + step * m
            p[i] = 0.0 if x < eps else 1.0 if x > 1 - eps else x
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array([0.0 if x <= eps else 1.0 if x >= 1 - eps else x for x in p])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few so that words, then documents, come nearest."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = [np.array([(k >> j) & 1 for j in range(len(open_))], float) for k in range(1 << len(open_))]
        q, s = p[open_], size[open_]
        p = p.copy()
        p[open_] = min(choices, key=lambda x: (abs(float((x - q) @ s)), abs(float((x - q).sum()))))
    return p


def settle(p: np.ndarray, was: np.ndarray, size: np.ndarray, tries: int = 32) -> np.ndarray:
    """Undo a few of the last block's choices while that brings the words nearer to what was expected."""
    free, p = np.flatnonzero((was > 0) & (was < 1) & (size > 0)), p.copy()
    for _ in range(tries if len(free) else 0):
        off = float((p - was) @ size)
        after = np.abs(off + np.where(p[free] == 1, -size[free], size[free]))
        k = int(after.argmin())
        if after[k] >= abs(off):
            break
        p[free[k]] = 1 - p[free[k]]
    return p


def sized(docs: DataFrame, keep: list[str], source_col: str, text_col: str, more: Callable | None = None, fields_more: Sequence[T.StructField] = (), id_col: str = "doc_id") -> DataFrame:
    """Kept columns with source, words and a hash of text and id; ``more`` adds columns in the same pass."""
    extra = [] if text_col in keep else [F.col(text_col).cast("string").alias("_mix_text")]
    if id_col in docs.columns:  # whole numbers as they are, other ids by their text
        whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        extra.append(F.col(f"`{id_col}`").cast("long" if whole else "string").alias("_mix_id"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(source_col).cast("string").alias("_mix_source"), *extra)
    name = text_col if text_col in keep else "_mix_text"  # the text is sent once, also if it is kept
    fields = [f for f in rows.schema.fields if f.name not in ("_mix_text", "_mix_id")]
    schema = T.StructType([*fields, T.StructField("_mix_size", T.LongType()), T.StructField("_mix_hash", T.LongType())])
    names = [f.name for f in schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from .text import LOWER, prefix_hash, span_hash

        seen: Counter = Counter()
        for b in slices(batches, name):
            t = texts_of(b.column(name))
            n = np.diff(words_of(t).first)
            h = span_hash(prefix_hash(t.data), t.offsets[:-1], t.offsets[1:])
            if "_mix_id" in b.schema.names:
                ids = b.column("_mix_id")
                if pa.types.is_integer(ids.type):
                    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                else:
                    i = texts_of(ids)
                    ids = span_hash(prefix_hash(i.data), i.offsets[:-1], i.offsets[1:])
                h = mix(h ^ ids)
            again = np.zeros(len(h), U64)
            for i, x in enumerate(h.tolist()):
                again[i] = seen[x]
                seen[x] += 1
            if len(seen) > 2_000_000:
                seen = Counter({k: v for k, v in seen.items() if v > 1})
            h = mix(h + again * U64(0x9E3779B97F4A7C15)).view(np.int64)
            out = pa.record_batch([*[b.column(f.name) for f in fields], pa.array(n), pa.array(h)], names)
            yield out if more is None else more(out)

    return rows.mapInArrow(count, T.StructType([*schema.fields, *fields_more]))


def mix_sources(docs: DataFrame, *, keep: list[str] | None = None, source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), most: int = 3, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id") -> DataFrame:
    """The kept columns (all by default) of every row, with size, source_size, target and copies.

    ``copies`` is how often the mix takes the row: 0 to ``most``.  Null text has no
    words and is a document like any other; null is a source of its own, the last.
    Reruns agree, whatever the order of rows, where ``id_col`` and the text tell rows
    apart (or rows that share both are equal).
    The result has columns ``_mix_size``, ``_mix_source_size``, ``_mix_target`` and
    ``_mix_copies``, names no input may use.
    """
    keep = list(docs.columns) if keep is None else keep
    if clash := [c for c in docs.columns if c.startswith("_mix_")]:
        raise ValueError(f"columns are named as this operator's own: {clash}")
    found = sized(docs, [], source_col, text_col).groupBy("_mix_source").agg(F.sum("_mix_size").alias("n"), F.count("*").alias("rows")).collect()
    sizes = {r["_mix_source"]: int(r["n"]) for r in found}
    counts = {r["_mix_source"]: int(r["rows"]) for r in found}
    wanted = targets(sizes, weights, most)
    rate = {s: wanted[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}
    added = [T.StructField("_mix_block", T.LongType()), T.StructField("_mix_p", T.DoubleType()), T.StructField("_mix_copies", T.LongType())]

    def block_of(b: pa.RecordBatch, counts: dict, level: int) -> pa.Array:
        h = mix(b.column("_mix_hash").to_numpy(zero_copy_only=False).view(U64) + U64(level))
        blocks = np.array([max(1, -(-counts[s] // block_rows)) for s in b.column("_mix_source").to_pylist()], np.int64)
        return pa.array((h >> U64(1)).astype(np.int64) % blocks if len(h) else blocks)

    def start(b: pa.RecordBatch, counts: dict = counts) -> pa.RecordBatch:
        """A block, the whole copies and the probability of one more."""
        r = np.array([rate[s] for s in b.column("_mix_source").to_pylist()], float)
        whole = np.floor(r)
        return pa.record_batch([*b.columns, block_of(b, counts, 0), pa.array(r - whole), pa.array(whole.astype(np.int64))], [*b.schema.names, *[f.name for f in added]])

    rows = sized(docs, keep, source_col, text_col, start, added, id_col)
    schema = rows.schema
    names = [f.name for f in schema.fields]

    def dealt(df: DataFrame, counts: dict, level: int) -> DataFrame:
        """New blocks for what is left."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.set_column(names.index("_mix_block"), "_mix_block", block_of(b, counts, level))

        return df.mapInArrow(deal, schema)

    def decide(last: bool, level: int):
        def fly(key, table):
            table = table.combine_chunks()
            # Long documents first: what is left to land is short then.
            table = table.take(pa.array(np.lexsort((table.column("_mix_hash").to_numpy(), -table.column("_mix_size").to_numpy()))))
            p, size = table.column("_mix_p").to_numpy(), table.column("_mix_size").to_numpy()
            seed = zlib.crc32(repr((key[0].as_py(), key[1].as_py(), level)).encode())
            was, p = p, flight(p, size, np.random.default_rng(seed).random(2 * len(p) + 8))
            if last:
                p = settle(land(p, size), was, size)
            done = (p == 1.0).astype(np.int64)
            table = table.set_column(names.index("_mix_copies"), "_mix_copies", pa.array(table.column("_mix_copies").to_numpy() + done))
            give_back()
            return table.set_column(names.index("_mix_p"), "_mix_p", pa.array(np.where(p == 1.0, 0.0, p)))

        return fly

    # A source's rows, then its rest, are decided in blocks; the last level has one block a source.
    parts, level, now = [], 0, rows
    while True:
        last = all(c <= block_rows for c in counts.values())
        flown = now.groupBy("_mix_source", "_mix_block").applyInArrow(decide(last, level), schema)
        if last:
            parts.append(flown)
            break
        flown = stored(flown, "mix")
        parts.append(flown.where("_mix_p = 0"))
        rest = flown.where("_mix_p > 0")
        counts = {s: 0 for s in counts} | {r["_mix_source"]: int(r["count"]) for r in rest.groupBy("_mix_source").count().collect()}
        level += 1
        now = dealt(rest, counts, level)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    table = small_table(out.sparkSession, [(s, sizes[s], float(wanted[s])) for s in sizes], [("s", pa.string()), ("_mix_source_size", pa.int64()), ("_mix_target", pa.float64())])
    return out.join(F.broadcast(table), F.col("_mix_source").eqNullSafe(F.col("s"))).select(*[F.col(f"`{c}`") for c in keep], "_mix_size", "_mix_source_size", "_mix_target", "_mix_copies")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, in the columns of ``docs``."""
    mixed = mix_sources(docs, **options).where("_mix_copies > 0")
    return mixed.withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
