"""Substring deduplication by content-defined chunks.

A gear rolling hash over the bytes of a text, h = 2 h + G[byte], cuts after a byte
where some of its bits (which depend on the last 20 bytes) fall below a threshold.
A cut depends only on what stands before it, so text inserted elsewhere moves no
other cut.  Chunks of equal digest are copies; the first document that holds one
(least id, first place) owns it.  A run of chunks that others own is removed if
it is at least ``least_chars`` long, so a common phrase or line is left alone.

Scale: blocks of documents send each distinct digest once to the shard of the
digest, with the least id of a document that has it, and get back whether it
repeats, who owns it and whether the block holds the copy that stays: of rows of
one id in several blocks one block's.  A passage that a third of all documents share is one key a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import U64, deal, pack, pack_sorted, unpack, unpack_sorted
from .storage import stored
from .text import Texts, mix, prefix_hash, slices, span_hash, texts_of

#: A chunk has this many bytes on average, and at most ten times as many.
MEAN_BYTES = 24
GEAR = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)
#: The bits of the hash that decide: the highest depends on the last 20 bytes.
LOW_BIT, BITS = 4, 16


def gear_hashes(t: Texts) -> np.ndarray:
    """The gear hash after each byte, started anew at each document, by doubling the window."""
    h = GEAR[t.data]
    place = np.arange(len(h)) - np.repeat(t.offsets[:-1], np.diff(t.offsets))
    for step in (1, 2, 4, 8, 16):
        more = np.zeros_like(h)
        more[step:] = h[:-step] << np.uint32(step) if len(h) > step else h[:0]
        more[place < step] = 0
        h = h + more
    return h


def chunks(t: Texts, mean: int = MEAN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every chunk of a slice."""
    n = len(t.data)
    bits = (gear_hashes(t) >> np.uint32(LOW_BIT)) & np.uint32((1 << BITS) - 1)
    cut = np.zeros(n + 1, bool)
    cut[1:] = bits < (1 << BITS) // mean
    cut[t.offsets] = True
    at = np.flatnonzero(cut)
    gap, most = np.diff(at), 10 * mean
    if (gap > most).any():  # long chunks are cut from their start, so copies are cut alike
        pieces = -(-gap // most)
        owner = np.repeat(np.arange(len(gap)), pieces)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.append(at[:-1][owner] + k * most, at[-1])
    start, end = at[:-1], at[1:]
    return start, end, np.searchsorted(t.offsets, start, "right") - 1


BLOCK = "block string, docs binary, marks binary, counts binary, keys binary, chars binary, chunks long"


def make_blocks(batches: Iterator[pa.RecordBatch], block_chunks: int, mean: int) -> Iterator[pa.RecordBatch]:
    docs, marks, counts, keys, chars, size = [], [], [], [], [], 0

    def block() -> pa.RecordBatch:
        k = np.concatenate(keys)
        row = [uuid.uuid4().hex, np.concatenate(docs).tobytes(), np.concatenate(marks).tobytes(), pack(np.concatenate(counts)), k.tobytes(), pack(np.concatenate(chars)), len(k)]
        return pa.record_batch([pa.array([x], y) for x, y in zip(row, [pa.string(), *[pa.binary()] * 5, pa.int64()])], ["block", "docs", "marks", "counts", "keys", "chars", "chunks"])

    for b in slices(batches):
        t = texts_of(b.column("text"))
        start, end, doc = chunks(t, mean)
        points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
        docs.append(b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
        marks.append(b.column("mark").to_numpy())
        counts.append(np.bincount(doc, minlength=len(t)))
        keys.append(span_hash(prefix_hash(t.data), start, end))
        chars.append(points[end] - points[start])
        size += len(start)
        if size >= block_chunks:
            yield block()
            docs, marks, counts, keys, chars, size = [], [], [], [], [], 0
    if docs:
        yield block()


def owned(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents, its chunks' documents, and per distinct key: the key, the key of each chunk, least id, count."""
    docs, counts = np.frombuffer(row.docs, np.int64), unpack(row.counts).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), counts)
    keys, inverse, n = np.unique(np.frombuffer(row.keys, U64), return_inverse=True, return_counts=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, docs[doc])
    return docs, doc, keys, inverse, least, n


ASK = "shard int, block string, keys binary, docs binary, counts binary"
ANSWER = "block string, shard int, repeats binary, holds binary, docs binary"


def ask(frames: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            _, _, keys, _, least, n = owned(row)
            o, cuts, inner = deal(keys, shards)
            least, n = least[o], np.minimum(n[o], 2)
            full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pd.DataFrame({"shard": full, "block": row.block, **{c: [f(x[cuts[s] : cuts[s + 1]]) for s in full] for c, f, x in (("keys", pack_sorted, inner), ("docs", lambda v: pack(v.view(U64)), least), ("counts", pack, n))}})


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """For each key sent: whether it repeats, and for those that do whether this block holds the copy that stays, and the least id."""
    keys = [unpack_sorted(k) for k in frame["keys"]]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    key = np.concatenate(keys)
    doc = np.concatenate([unpack(x).view(np.int64) for x in frame["docs"]])
    n = np.concatenate([unpack(x).astype(np.int64) for x in frame["counts"]])
    rank = np.repeat(np.argsort(np.argsort(frame["block"].to_numpy())), [len(k) for k in keys])
    # The copy that stays is of the least id, and of rows of that id in the block of least name.
    order = np.lexsort((rank, doc, key))
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.append(first, len(key)))
    many, holds, least = np.empty(len(key), bool), np.zeros(len(key), bool), np.empty(len(key), np.int64)
    holds[order[first]] = True
    many[order] = np.repeat(np.add.reduceat(n[order], first) > 1, size)
    least[order] = np.repeat(doc[order][first], size)
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "repeats": [pack(m) for m in np.split(many, cuts)], "holds": [pack(x[m]) for x, m in zip(np.split(holds, cuts), np.split(many, cuts))], "docs": [pack(x[m].view(U64)) for x, m in zip(np.split(least, cuts), np.split(many, cuts))]})


SPANS = "doc_id long, start long, end long, first_doc_id long, mark long, row string"


def settle(left: pd.DataFrame, right: pd.DataFrame, shards: int, least_chars: int) -> pd.DataFrame:
    """The runs of a block's chunks that others own."""
    row = next(left.itertuples())
    docs, doc, keys, inverse, _, _ = owned(row)
    o, cuts, _ = deal(keys, shards)
    many, holds, owner = np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    for x in right.itertuples():
        at = o[cuts[x.shard] : cuts[x.shard + 1]]
        m = unpack(x.repeats).astype(bool)
        many[at] = m
        holds[at[m]] = unpack(x.holds).astype(bool)
        owner[at[m]] = unpack(x.docs).view(np.int64)
    chars = unpack(row.chars).astype(np.int64)
    if not len(doc):
        return pd.DataFrame({c.split()[0]: pd.Series([], dtype="object" if c == "row string" else "int64") for c in SPANS.split(", ")})
    # One copy of a key is kept: in the block that holds it, the owner's first place, whatever stands before it.
    mine = np.flatnonzero(holds[inverse] & (owner[inverse] == docs[doc]))
    kept = np.zeros(len(doc), bool)
    kept[mine[np.unique(inverse[mine], return_index=True)[1]]] = True
    theirs = many[inverse] & ~kept
    edge = np.concatenate([[True], (doc[1:] != doc[:-1]) | (theirs[1:] != theirs[:-1])])
    first = np.flatnonzero(edge)
    size = np.add.reduceat(chars, first)
    end = np.cumsum(chars)
    begin = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(unpack(row.counts).astype(np.int64))])][:-1]
    last = np.append(first[1:], len(doc)) - 1
    keep = theirs[first] & (size >= least_chars)
    first, last = first[keep], last[keep]
    d = doc[first]
    return pd.DataFrame({"doc_id": docs[d], "start": end[first] - chars[first] - begin[d], "end": end[last] - begin[d], "first_doc_id": owner[inverse[first]], "mark": np.frombuffer(row.marks, np.int64)[d], "row": pd.Series([f"{row.block}/{i}" for i in d.tolist()], dtype=object)})


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 100, mean_bytes: int = MEAN_BYTES, block_chunks: int = 1_000_000, shard_chunks: int = 2_000_000) -> DataFrame:
    """(doc_id, start, end, first_doc_id, mark, row): passages that an earlier document, or the document itself, holds before.

    Offsets are code points, end exclusive, along chunk edges.  Null and empty
    texts and rows without an id are left alone.  Of rows of one id and text one
    keeps its own: ``mark`` (a hash of the text) and ``row`` tell them apart.
    """
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    blocks = stored(rows.mapInArrow(lambda it: make_blocks(it, block_chunks, mean_bytes), BLOCK), "chunks")
    total = int(blocks.agg(F.sum("chunks")).first()[0] or 0)
    shards = max(8, -(-total // shard_chunks))
    answers = blocks.mapInPandas(lambda it: ask(it, shards), ASK).groupBy("shard").applyInPandas(answer, ANSWER)

    def finish(left, right):  # noqa: ANN001, ANN202
        return settle(left, right, shards, least_chars)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, SPANS)


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts, each row's spans out of one row of that id and text."""
    cuts = spans.groupBy(F.col("doc_id").alias("_cut_id"), F.col("mark").alias("_cut_mark"), "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    cuts = cuts.withColumn("_cut_n", F.row_number().over(Window.partitionBy("_cut_id", "_cut_mark").orderBy("row"))).drop("row")
    text = F.col(f"`{text_col}`")
    begun = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    step = lambda s, c: F.struct(F.concat(s["kept"], F.substring(text, (s["at"] + 1).cast("int"), F.greatest(c["start"] - s["at"], F.lit(0)).cast("int"))).alias("kept"), F.greatest(s["at"], c["end"]).alias("at"))
    done = lambda s: F.concat(s["kept"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    ids, mark = F.col(f"`{id_col}`").cast("long"), F.xxhash64(text.cast("string"))
    numbered = docs.withColumn("_n", F.row_number().over(Window.partitionBy(ids, mark).orderBy(F.lit(0))))
    joined = numbered.join(cuts, (ids == F.col("_cut_id")) & (mark == F.col("_cut_mark")) & (F.col("_n") == F.col("_cut_n")), "left")
    return joined.select(*[F.when(F.col("_cuts").isNull(), F.col(f"`{c}`")).otherwise(F.aggregate("_cuts", begun, step, done)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
