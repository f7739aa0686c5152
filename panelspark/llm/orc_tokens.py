"""Token ids in ORC: stripes, integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of their id and sorted, so the files in the order
of ``part`` hold all documents in ascending order, and minima, maxima and Bloom
filters of ``doc_id`` let a reader skip stripes and row groups.  A row keeps the
number of ids before it in its part; adding the totals of the parts before gives
its place in the whole stream without passing the ids through one task.

Encoding.  A text is cut before each white space that follows something else, and
between an ASCII letter or digit and one of ``.,;:!?``.
A byte-level tokenizer's own pattern always cuts there, whatever stands on either
side, so the ids of a text are those of its pieces, and each distinct piece that a
worker meets is encoded once.  Texts with white space beyond ASCII are encoded whole,
and so are all texts if the tokenizer's file names another way of splitting.  Pieces
are told apart by a 64-bit hash of their bytes and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, small_table
from .text import SPACE, Texts, drop_kept, give_back, prefix_hash, process_cache, slices, span_hash, texts_of

END_ID = 2
ALNUM, MARK = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARK[list(b".,;:!?")] = True
#: Text encoded at once; several numbers a byte are held meanwhile.
ENCODE_BYTES = 1 << 19
#: Distinct pieces that a worker remembers before it starts anew, in a table more than twice as large: about 50 MB.
REMEMBERED = 800_000
SLOT_BITS = 21


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: a character stands for a byte
        for word, i in vocab.items():
            self.size[i] = len(word)
        del vocab
        give_back()
        split = self.tok.pre_tokenizer
        self.cuts = self.tok.normalizer is None and isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        # An open hash table: the key in each slot (0: none) and which piece it is.
        self.slots, self.index = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for those not met before."""
        out, todo, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            there = self.slots[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.index[slot[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def enter(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys not met before take the first free slots from their own on."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slots[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            self.slots[at], self.index[at] = keys[free[first]], numbers[free[first]]
            rest = np.ones(len(keys), bool)
            rest[free[first]] = False
            keys, numbers, slot = keys[rest], numbers[rest], (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)

    def whole(self, data: bytes) -> list[int]:
        return self.tok.encode(data.decode(), add_special_tokens=False).ids

    def joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each begin with white space and end without, and how many each has."""
        ids = np.array(self.whole(b"".join(pieces)), np.int32)
        ends = np.cumsum(self.size[ids])
        cut = np.searchsorted(ends, np.cumsum([len(p) for p in pieces]), "right")
        return ids, np.diff(cut, prepend=0)

    def learn(self, keys: np.ndarray, pieces: list[bytes], plain: np.ndarray) -> None:
        """Encode pieces not met before."""
        todo, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        counts, parts = [], []
        for at in range(0, len(todo), 4096):
            ids, n = self.joined([pieces[i] for i in todo[at : at + 4096].tolist()])
            counts.append(n)
            parts.append(ids)
        single = [np.array(self.whole(pieces[i]), np.int32) for i in rest.tolist()]
        counts.append(np.array([len(x) for x in single], np.int64))
        new = len(self.first) - 1 + np.arange(len(keys))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *parts, *single])
        self.enter(np.concatenate([keys[todo], keys[rest]]), new.astype(np.int32))

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document's followed by the end id, and where each document's begin."""
        docs, n = len(t), len(t.data)
        odd = np.full(docs, not self.cuts)
        odd[np.searchsorted(t.offsets, odd_spaces(t.data), "right") - 1] = True
        for s in self.special:
            if s in t.data.tobytes():
                odd[:] = True
        space = SPACE[t.data]
        begin = np.zeros(n + 1, bool)
        begin[1:n] = (space[1:] & ~space[:-1]) | (MARK[t.data[1:]] & ALNUM[t.data[:-1]])
        if odd.any():
            begin[:n] &= ~np.repeat(odd, np.diff(t.offsets))
        begin[t.offsets] = True
        begin[n] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], n)[: len(start)]
        doc = np.searchsorted(t.offsets, start, "right") - 1
        key = np.maximum(span_hash(prefix_hash(t.data), start, end), np.uint64(1))
        piece = self.find(key)
        new = np.flatnonzero(piece < 0)
        if len(new):
            u, where = np.unique(key[new], return_index=True)
            if len(u) > REMEMBERED:  # of a single very long text
                was, self.cuts = self.cuts, False
                try:
                    return self.encode(t)
                finally:
                    self.cuts = was
            if len(self.first) + len(u) > REMEMBERED:
                self.forget()
                new = np.arange(len(key))
                u, where = np.unique(key, return_index=True)
            w = new[where]
            plain = space[start[w]] & ~space[end[w] - 1] & ~odd[doc[w]]
            raw = t.data.tobytes()
            self.learn(u, [raw[a:b] for a, b in zip(start[w].tolist(), end[w].tolist())], plain)
            piece[new] = self.find(key[new])
        size = self.first[piece + 1] - self.first[piece]
        per = np.bincount(doc, size, minlength=docs).astype(np.int64) + 1
        first = np.concatenate([[0], np.cumsum(per)])
        out = np.full(int(first[-1]), END_ID, np.int32)
        if len(key):
            run = np.cumsum(size) - size
            at = np.arange(int(size.sum()))
            out[at + np.repeat(doc, size)] = self.ids[at + np.repeat(self.first[piece] - run, size)]
        return out, first


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII (or a control that some patterns take for it) begins."""
    out = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    pad = np.append(data, [0, 0]).astype(np.int64)
    for at in (np.flatnonzero(data == x) for x in (0xC2, 0xE1, 0xE2, 0xE3)):
        if len(at):
            two, three = (pad[at] << 8) | pad[at + 1], (pad[at] << 16) | (pad[at + 1] << 8) | pad[at + 2]
            hit = (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | (three == 0xE1A08E) | ((three >= 0xE28080) & (three <= 0xE2808B)) | np.isin(three, [0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
            out.append(at[hit])
    return np.concatenate(out)


def encoder(path: str) -> Encoder:
    cache = process_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


FILE = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Write the ids of every text, an end id after each, as ORC in ascending order of document id.

    Null text counts as empty; a null id sorts first; rows of one id follow each
    other in the order of their texts.  ``tokenizer`` is the path of a byte-level
    tokenizer file, the same on every machine.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, before, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for b in slices(batches, most=ENCODE_BYTES, keeps="encoder"):
            ids, first = e.encode(texts_of(b.column("text")))
            n = b.num_rows
            yield pa.record_batch([b.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + first[:-1]), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], ["doc_id", "part", "before", "n_tokens", "ids"])
            before += int(first[-1])

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_bytes), "orc.compress": "ZSTD"}
    ordered.mapInArrow(encode, FILE).write.options(**options).orc(path)


def in_stream(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with ``part`` and ``before``, and where each document begins in the whole stream (``start``)."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each file
    starts, at = [], 0
    for r in sorted(totals, key=lambda r: r.part):
        starts.append((r.part, at))
        at += r.n
    parts = small_table(rows.sparkSession, starts, [("part", pa.int32()), ("part_start", pa.int64())])
    return rows.join(parts, "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part", "part_start", "before")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files again: doc_id, n_tokens, ids and start.  A filter on doc_id prunes stripes."""
    files = spark.read.schema(FILE).orc(path)
    return in_stream(files, files)


def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unsigned CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    drop_kept()  # the encoder: reading needs none
    for b in batches:
        ids = b.column("ids")
        first, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        n = np.diff(first).astype(np.int64)
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.record_batch([b.column("doc_id"), b.column("part"), b.column("before"), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "part", "before", "n_tokens", "ids_crc32"])
    give_back()


def token_digests(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the ORC files (in the shared folder unless a path is given), read them back, and digest what they hold."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    files = spark.read.schema(FILE).orc(path)
    read = files.mapInArrow(crcs, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return in_stream(read, files).select("doc_id", "start", "n_tokens", "ids_crc32")
