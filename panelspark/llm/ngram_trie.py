"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trigram model with hierarchical Dirichlet smoothing:

    p1(w)        = (c(w) + a) / (N + a (V + 1))
    p2(w | v)    = (c(v w) + m2 p1(w)) / (c(v) + m2)
    p3(w | u v)  = (c(u v w) + m3 p2(w | v)) / (c(u v) + m3)

A node of the trie is an n-gram seen in training.  It holds a quantised log10
probability and a quantised log10 back-off weight, m / (c + m).  Words of a
bigram lie below their first word; the last word of a trigram is stored as its
position among the successors of the word before it (the context), which keeps
the numbers of the last level small.  Each level is an Elias-Fano sequence, made
monotone by adding the last number of the range before, and its ranges are given
by Elias-Fano pointers.

Scale.  Documents are packed into blocks.  A block sends every distinct n-gram
it holds, with its training count, to the shard of the n-gram's hash, and gets
back the counts over the whole corpus.  With these it builds the trie of just
the n-grams it can be asked for (model filtering, which loses nothing), and
scores its documents from it.  No task holds the model of the corpus, and no
word is hot: it is one key per block.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import U64, deal, pack, pack_sorted, summed, unpack, unpack_sorted
from .storage import stored
from .text import mix, slices, texts_of, word_hashes, words_of

#: A bigram's or trigram's hash is sent with so many bits more than number the words of the corpus,
#: so about one in 2**15 counts at most is another's too; a word's hash is sent whole.
SPARE_BITS = 15
#: Quantisation: codes are multiples of 1/4096 of log10, from 0 to -16.
CODES_PER_UNIT = 4096


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * CODES_PER_UNIT), 0, 65535).astype(np.uint16)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._tops = self._buckets = self._wide = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            planes = ((values[:, None] >> np.arange(bits, dtype=U64)) & U64(1)).astype(np.uint8) if n < 1 << 16 else None
            if planes is None:
                planes = np.empty((n, bits), np.uint8)
                for k in range(bits):
                    planes[:, k] = (values >> U64(k)) & U64(1)
            low = np.packbits(planes, bitorder="little")
        ones = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 2 if n else 1, np.uint8)
        unary[ones] = 1
        return cls(n, bits, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(unary, bitorder="little"))

    @property
    def tops(self) -> np.ndarray:
        """High parts, read from the unary code once for many queries."""
        if self._tops is None:
            ones = np.flatnonzero(np.unpackbits(np.asarray(self.high), bitorder="little"))[: self.n]
            self._tops = (ones - np.arange(self.n)).astype(np.int64)
        return self._tops

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        if self._wide is None:  # every 8 bytes as a number, at each byte
            low = np.ascontiguousarray(self.low)
            self._wide = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
        at = i * self.bits
        return (self._wide[at >> 3] >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.tops[i].astype(U64) << U64(self.bits)) | self.lows(i)

    def find(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Where each value first stands in [lo, hi), or -1: successor search by its high part, then by low bits."""
        out = np.full(len(value), -1, np.int64)
        if not self.n or not len(value):
            return out
        if self._buckets is None:
            self._buckets = np.concatenate([[0], np.cumsum(np.bincount(self.tops))])
        top = (value >> U64(self.bits)).astype(np.int64)
        known = top < len(self._buckets) - 1
        top = np.where(known, top, 0)
        a = np.maximum(lo, self._buckets[top])
        b = np.where(known, np.minimum(hi, self._buckets[top + 1]), a)
        want = value & U64((1 << self.bits) - 1)
        end, live = b.copy(), np.flatnonzero(a < b)
        while len(live):  # the first element in the bucket that isn't below
            mid = (a[live] + b[live]) >> 1
            less = self.lows(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        ok = np.flatnonzero(a < end)
        ok = ok[self.lows(a[ok]) == want[ok]]
        out[ok] = a[ok]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, len(self.low), len(self.high)], np.int64).view(np.uint8), self.low, self.high]


class Ranges:
    """Sorted numbers below each parent, one Elias-Fano sequence for all parents."""

    def __init__(self, pointers: EliasFano, numbers: EliasFano):
        self.pointers, self.numbers = pointers, numbers

    @classmethod
    def of(cls, parents: int, parent: np.ndarray, number: np.ndarray) -> Ranges:
        starts = np.searchsorted(parent, np.arange(parents + 1))
        lasts = np.flatnonzero(np.diff(parent, append=-1) != 0) if len(parent) else np.zeros(0, np.int64)
        # The base of a range is the last value of the range before, plus one.
        steps = np.zeros(len(parent) + 1, np.int64)
        steps[lasts + 1] = number[lasts] + 1
        base = np.cumsum(steps[:-1])
        return cls(EliasFano.of(starts), EliasFano.of(base + number))

    def find(self, parent: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The node of each number below its parent, or -1."""
        lo, hi = self.pointers[parent].astype(np.int64), self.pointers[parent + 1].astype(np.int64)
        base = np.zeros(len(lo), U64)
        after = np.flatnonzero((lo > 0) & (lo < hi))
        base[after] = self.numbers[lo[after] - 1] + U64(1)
        return self.numbers.find(lo, hi, base + number.astype(U64))

    def start(self, parent: np.ndarray) -> np.ndarray:
        return self.pointers[parent].astype(np.int64)


class NGramTrie:
    """Levels of a trigram trie over word numbers 0..V-1, readable from one flat buffer."""

    def __init__(self, p1, b1, bi: Ranges, p2, b2, tri: Ranges, p3):
        self.p1, self.b1, self.bi, self.p2, self.b2, self.tri, self.p3 = p1, b1, bi, p2, b2, tri, p3

    @classmethod
    def build(cls, p1, b1, bi_first, bi_second, p2, b2, tri_context, tri_suffix, p3) -> NGramTrie:
        """Bigrams sorted by (first, second); a trigram by the bigrams of its first two and of its last two words, sorted by these."""
        bi = Ranges.of(len(p1), bi_first, bi_second)
        below = tri_suffix - bi.start(bi_second[tri_context])
        return cls(quantise(p1), quantise(b1), bi, quantise(p2), quantise(b2), Ranges.of(len(p2), tri_context, below), quantise(p3))

    def to_bytes(self) -> bytes:
        sets = [self.bi.pointers, self.bi.numbers, self.tri.pointers, self.tri.numbers]
        parts = [np.array([len(self.p1), len(self.p2), len(self.p3)], np.int64).view(np.uint8)]
        for x in sets:
            parts += x.parts()
        parts += [x.view(np.uint8) for x in (self.p1, self.b1, self.p2, self.b2, self.p3)]
        return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    @classmethod
    def over(cls, buffer) -> NGramTrie:
        """A trie whose levels are views of a buffer, such as a memory map."""
        data, at = np.frombuffer(buffer, np.uint8), 0

        def take(n: int, kind=np.uint8) -> np.ndarray:
            nonlocal at
            out = data[at : at + n * np.dtype(kind).itemsize]
            at += n * np.dtype(kind).itemsize
            return out.view(kind) if kind is np.uint8 else np.frombuffer(out, kind)

        n1, n2, n3 = take(3, np.int64)
        sets = []
        for _ in range(4):
            n, bits, low, high = map(int, take(4, np.int64))
            sets.append(EliasFano(n, bits, take(low), take(high)))
        p1, b1, p2, b2, p3 = (take(int(n), np.uint16) for n in (n1, n1, n2, n2, n3))
        return cls(p1, b1, Ranges(sets[0], sets[1]), p2, b2, Ranges(sets[2], sets[3]), p3)

    def mapped(self) -> NGramTrie:
        """The same trie over an anonymous memory map: executors share no folder to map a file from."""
        image = self.to_bytes()
        m = mmap.mmap(-1, max(1, len(image)))
        m.write(image)
        return NGramTrie.over(m)

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def open(cls, path: str) -> NGramTrie:
        """Memory-map a file that ``write`` made."""
        return cls.over(np.memmap(path, np.uint8, "r"))

    def bigram(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.bi.find(v, w)

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 p3(w | u v) for word numbers, all known to the trie."""
        return self.log10_at(self.bigram(u, v), self.bigram(v, w), v, w)

    def log10_at(self, uv: np.ndarray, vw: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The same, given the nodes of the bigrams (-1 if unseen)."""
        units = lambda codes: codes.astype(np.float64) / -CODES_PER_UNIT
        out = np.where(vw >= 0, units(self.p2[vw]) if len(self.p2) else 0.0, units(self.b1[v]) + units(self.p1[w]))
        seen = np.flatnonzero(uv >= 0)
        out[seen] += units(self.b2[uv[seen]])
        both = seen[vw[seen] >= 0]
        node = self.tri.find(uv[both], vw[both] - self.bi.start(v[both]))
        hit = node >= 0
        out[both[hit]] = units(self.p3[node[hit]])
        return out


# Blocks

BLOCK = "block string, docs binary, lengths binary, held binary, vocab binary, ids binary, tokens long, train long, train_docs long"
END = mix(np.array([0x656E64], U64))[0]
BEGIN = mix(np.array([0x626567696E], U64))[0]


def is_held(doc_id: int) -> bool:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def make_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of words, some millions of words a row."""
    import uuid

    schema = pa.schema([(n, t) for n, t in zip(BLOCK.replace(",", "").split()[::2], [pa.string()] + [pa.binary()] * 5 + [pa.int64()] * 3)])
    docs, held, lengths, hashes, size = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        h, n, out = np.concatenate(hashes), np.concatenate(lengths), np.array(held, bool)
        vocab, ids = np.unique(h, return_inverse=True)
        ids_of = pa.array(docs, pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("d", pa.int64())])) as w:
            w.write_batch(pa.record_batch([ids_of], ["d"]))
        row = [[uuid.uuid4().hex], [sink.getvalue().to_pybytes()], [pack(n)], [pack(out)], [pack_sorted(vocab)], [pack(ids, 3)], [len(h)], [int(n[~out].sum())], [int((~out).sum())]]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    for b in slices(batches):
        t = texts_of(b.column("text"))
        w = words_of(t)
        h = word_hashes(t, w)
        n = np.diff(w.first)
        full = np.insert(h, w.first[1:], END)  # one end after each document
        ids = b.column("doc_id").to_pylist()
        docs += ids
        held += [i is not None and is_held(i) for i in ids]
        lengths.append(n + 1)
        hashes.append(full)
        size += len(full)
        if size >= block_tokens:
            yield block()
            docs, held, lengths, hashes, size = [], [], [], [], 0
    if docs:
        yield block()


class Block:
    """A block's words, their n-grams and which of those are for training."""

    def __init__(self, row):
        self.docs = pa.ipc.open_stream(row.docs).read_all().column(0).to_pylist()
        self.lengths = unpack(row.lengths).astype(np.int64)
        self.held = unpack(row.held).astype(bool)
        self.vocab, self.ids = unpack_sorted(row.vocab), unpack(row.ids).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        n = len(self.ids)
        words = len(self.vocab)  # the number of BEGIN
        self.prev = np.concatenate([np.array([words], np.int32), self.ids[:-1]])[:n]
        self.prev[self.first[:-1]] = words
        self.prev2 = np.concatenate([np.array([words], np.int32), self.prev[:-1]])[:n]
        self.prev2[self.first[:-1]] = words
        self.train = np.repeat(~self.held, self.lengths)

    def levels(self, ngram_bits: int):
        """Per order: distinct keys, the distinct key at each position, and how many bits of a key are sent."""
        yield self.vocab, self.ids, 64
        h = np.append(self.vocab, BEGIN)
        k = mix(h[self.prev] * U64(0xA0761D6478BD642F) + h[self.ids])
        u, inverse = np.unique(k, return_inverse=True)
        yield u, inverse.astype(np.int32), ngram_bits
        del u, inverse
        k = mix(mix(h[self.prev2] ^ U64(0x2545F4914F6CDD1D)) * U64(0xE7037ED1A0B428DB) + k)
        u, inverse = np.unique(k, return_inverse=True)
        yield u, inverse.astype(np.int32), ngram_bits


def ask(rows: Iterator[pd.DataFrame], shards: int, bits: int) -> Iterator[pd.DataFrame]:
    for frame in rows:
        for row in frame.itertuples():
            b = Block(row)
            for order, (keys, at, sent) in enumerate(b.levels(bits), 1):
                counts = np.bincount(at[b.train], minlength=len(keys))
                o, cuts, inner = deal(keys, shards, sent)
                counts = counts[o]
                full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
                yield pd.DataFrame({"shard": full, "level": order, "block": row.block, "keys": [pack_sorted(inner[cuts[s] : cuts[s + 1]]) for s in full], "counts": [pack(counts[cuts[s] : cuts[s + 1]]) for s in full]})


ASK = "shard int, level int, block string, keys binary, counts binary"
ANSWER = "block string, level int, shard int, counts binary, words long"


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    keys = [unpack_sorted(x) for x in frame["keys"]]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    keys, counts = np.concatenate(keys), np.concatenate([unpack(x) for x in frame["counts"]]).astype(np.int64)
    order = np.argsort(keys)
    s, c = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(c, first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(first, len(s))))
    words = np.zeros(len(frame), np.int64)
    if frame["level"].iloc[0] == 1:
        words[0] = int((total > 0).sum())
    return pd.DataFrame({"block": frame["block"], "level": frame["level"], "shard": frame["shard"], "counts": [pack(x) for x in np.split(out, cuts)], "words": words})


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_block(left: pd.DataFrame, right: pd.DataFrame, shards: int, bits: int, total: int, words: int, train_docs: int, add: float, m2: float, m3: float) -> pd.DataFrame:
    """Build the block's trie from the counts it was sent, and score its documents."""
    b = Block(next(left.itertuples()))
    counts, at = [], []
    got = {(x.level, x.shard): x.counts for x in right.itertuples()}
    for order, (keys, inverse, sent) in enumerate(b.levels(bits), 1):
        o, cuts, _ = deal(keys, shards, sent)
        c = np.zeros(len(keys), np.int64)
        for s in range(shards):
            if cuts[s] < cuts[s + 1]:
                c[o[cuts[s] : cuts[s + 1]]] = unpack(got[order, s]).astype(np.int64)
        counts.append(c)
        at.append(inverse)
    c1, c2, c3 = counts
    V = len(b.vocab)
    c1 = np.append(c1, train_docs)  # BEGIN as a context
    p1 = (c1 + add) / (total + add * (words + 1))
    base = np.log10(p1)[b.ids]
    known = c1[b.ids] > 0
    # Distinct n-grams: where each first stands, as word numbers.
    where = [np.zeros(len(c), np.int32) for c in counts]
    for k in (1, 2):
        where[k][at[k]] = np.arange(len(b.ids), dtype=np.int32)
    f2, s2 = b.prev[where[1]], b.ids[where[1]]
    p2 = (c2 + m2 * p1[s2]) / (c1[f2] + m2)
    start = (b.prev == V) & (b.prev2 == V)
    last = where[2]  # from here on, trigrams by where they stand
    suffix, upper = at[1][last], at[1][np.maximum(last - 1, 0)]
    opening = start[last]
    p3 = (c3 + m3 * p2[suffix]) / (np.where(opening, train_docs, c2[upper]) + m3)
    # Nodes, in the order of the levels.  (BEGIN, BEGIN) is a bigram too: the last, as BEGIN is the last word.
    n2 = np.flatnonzero(c2 > 0)
    n2 = n2[np.argsort(f2[n2].astype(U64) * U64(V + 1) + s2[n2].astype(U64))]
    f, s, q, n = (np.append(x[n2], y) for x, y in ((f2, V), (s2, V), (p2, 1.0), (c2, train_docs)))
    node = np.full(len(c2), -1, np.int64)
    node[n2] = np.arange(len(n2))
    n3 = np.flatnonzero(c3 > 0)
    above, below = np.where(opening, len(n2), node[upper])[n3], node[suffix][n3]
    both = (above >= 0) & (below >= 0)  # a trigram that a confused hash made up may lack its bigrams
    n3, above, below = n3[both], above[both], below[both]
    o = np.argsort(above.astype(U64) * U64(len(n2) + 1) + below.astype(U64))
    trie = NGramTrie.build(np.log10(p1), np.log10(m2 / (c1 + m2)), f, s, np.log10(q), np.log10(m3 / (n + m3)), above[o], below[o], np.log10(p3[n3[o]])).mapped()
    del p2, p3, above, below, n3, o, node, n2, f, s, q, n
    # Queries: each distinct bigram and trigram once.
    asked = trie.bigram(f2, s2)
    first = trie.bigram(np.array([V]), np.array([V]))[0]
    tokens = trie.log10_at(np.where(opening, first, asked[upper]), asked[suffix], b.prev[last], b.ids[last])[at[2]]
    cut = b.first[:-1]
    return pd.DataFrame({"doc_id": pd.array(b.docs, "Int64"), "held_out": b.held, "n_tokens": b.lengths, "n_known": np.add.reduceat(known.astype(np.int64), cut), "train_tokens": total, "base_score": np.add.reduceat(base, cut), "score": np.add.reduceat(tokens, cut)})


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1, m2: float = 20.0, m3: float = 20.0, block_tokens: int = 1_200_000, shard_tokens: int = 3_000_000) -> DataFrame:
    """One row per input row: the log10 probability of its text under a trigram trie and a unigram base.

    The model learns from rows whose crc32(id as text) mod 10 is not 0.  Null text
    counts as empty: one end token.  A null id is used for training.  Repeated
    rows are scored, and counted, each time.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(lambda it: make_blocks(it, block_tokens), BLOCK), "lm-blocks")
    meta = blocks.agg(F.sum("train"), F.sum("train_docs"), F.sum("tokens")).first()
    total, train_docs, tokens = (int(x or 0) for x in meta)
    shards = max(8, -(-tokens // shard_tokens))
    bits = min(64, SPARE_BITS + tokens.bit_length())
    asked = blocks.mapInPandas(lambda it: ask(it, shards, bits), ASK)
    answers = stored(asked.groupBy("level", "shard").applyInPandas(answer, ANSWER), "lm-counts")
    words = int(answers.agg(F.sum("words")).first()[0] or 0)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return score_block(left, right, shards, bits, total, words, train_docs, add, m2, m3)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, SCORED)
