"""Benchmark decontamination: a BM25 index of test items, searched with every passage.

Items are cut into segments of ``SEGMENT`` words, which are what the index holds.
A document is cut into passages of twice that, each starting ``SEGMENT`` words
after the one before, so some passage holds any copied segment whole.  Impacts
are BM25 weights over the segment's own score, so one threshold serves all
segments.  Search keeps whatever reaches the threshold, by block-max WAND's
bounds: a passage whose terms' greatest impacts don't add up is left, then each
block of segments whose block maxima don't, and only the rest is scored.

A candidate is verified on the whole document: the shares of the item's question
(its first part) and of its answer (the rest) whose runs of three words occur; a
question or answer of fewer words is one run, looked for among runs of its length.

Scale: documents are read once and never shuffled.  An index is built from a
bounded slice of the items (``index_chars``) and shipped to the tasks; more
items mean more passes, not a larger index.  Its statistics (segments, their mean
length, document frequencies) are those of all items, so scores don't depend on
how the items are sliced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_table, stored
from .text import PUNCTUATION, U64, Texts, among, distinct, fold, mix, prefix_hash, slices, span_hash, texts_of, words_of

SEGMENT = 32
BLOCK_SEGMENTS = 16
K1, B = 1.2, 0.75
RUN = 3
#: Text searched at once; postings of all its passages are held.
SEARCH_BYTES = 1 << 20


def words(t: Texts):
    w = words_of(t, PUNCTUATION)
    return w, span_hash(prefix_hash(fold(t.data)), w.start, w.end)


def runs(h: np.ndarray, k: int = RUN) -> np.ndarray:
    """Hashes of all runs of ``k`` words, or of all words if there are fewer."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        out = mix(out * U64(0xA0761D6478BD642F) + h[i : len(h) - k + 1 + i])
    return distinct(out)


def pieces_of(texts: list):
    """Word hashes, the segment of each, the segments of each text, and the texts' words."""
    w, h = words(texts_of(pa.array(texts, pa.string())))
    rank = np.arange(len(h)) - w.first[w.doc]
    size = np.diff(w.first)
    pieces = np.maximum(1, -(-size // SEGMENT))
    start = np.concatenate([[0], np.cumsum(pieces)])
    # Pieces of an item are about as long as each other: a short rest would match anything.
    return h, start[w.doc] + rank // np.maximum(1, -(-size // pieces))[w.doc], pieces, w


class Statistics(NamedTuple):
    """Of all items: segments, their mean length, and the segments of each of the sorted words asked for."""

    segments: int
    length: float
    term: np.ndarray
    df: np.ndarray


class Index(NamedTuple):
    items: list  # item ids
    vocab: np.ndarray  # sorted word hashes
    filter: np.ndarray  # bitmap over 20 bits of the hash
    top: np.ndarray  # greatest impact of each term
    block_first: np.ndarray  # terms' blocks, sorted by term
    block: np.ndarray
    block_top: np.ndarray
    first: np.ndarray  # terms' postings, sorted by term
    segment: np.ndarray
    impact: np.ndarray
    item_of: np.ndarray  # of each segment
    question: list  # run hashes of each item
    answer: list
    size: list  # words of each run of an item's question and answer: three, or all if there are fewer

    @classmethod
    def of(cls, ids: list, texts: list, whole: Statistics | None = None) -> Index:
        h, segment, pieces, w = pieces_of(texts)
        n, item_of = int(pieces.sum()), np.repeat(np.arange(len(ids)), pieces)
        vocab, term = np.unique(h, return_inverse=True)
        (pair, tf) = np.unique(term * max(n, 1) + segment, return_counts=True)
        term, seg = pair // max(n, 1), pair % max(n, 1)
        length = np.bincount(segment, minlength=n).astype(float)
        if whole is None:
            whole = Statistics(n, length.mean() if n else 1.0, vocab, np.bincount(term, minlength=len(vocab)))
        df = whole.df[np.searchsorted(whole.term, vocab)]
        idf = np.log1p((whole.segments - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[seg] / max(whole.length, 1e-9)))
        impact = weight / np.maximum(np.bincount(seg, weight, minlength=n), 1e-12)[seg]
        first = np.searchsorted(term, np.arange(len(vocab) + 1))
        key, at = np.unique(term * (n // BLOCK_SEGMENTS + 1) + seg // BLOCK_SEGMENTS, return_index=True)
        block_top = np.maximum.reduceat(impact, at) if len(at) else impact
        block_term = key // (n // BLOCK_SEGMENTS + 1)
        top = np.maximum.reduceat(impact, first[:-1]) if len(vocab) else impact
        seen = np.zeros(1 << 20, bool)
        seen[(vocab >> U64(44)).astype(np.int64)] = True
        question, answer, length = [], [], []
        for i in range(len(ids)):
            own = h[w.first[i] : w.first[i + 1]]
            cut = len(own) * 2 // 3
            question.append(runs(own[:cut]))
            answer.append(runs(own[cut:]))
            length.append((min(RUN, cut), min(RUN, len(own) - cut)))
        return cls(list(ids), vocab, seen, top, np.searchsorted(block_term, np.arange(len(vocab) + 1)), key % (n // BLOCK_SEGMENTS + 1), block_top, first, seg, impact, item_of, question, answer, length)


def spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the ranges of ``of``, and which of ``of`` each is from."""
    n = first[of + 1] - first[of]
    owner = np.repeat(np.arange(len(of)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of], n), owner


def over(key: np.ndarray, value: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys whose values add up to ``least``, and the sums."""
    u, at = np.unique(key, return_inverse=True)
    s = np.bincount(at, value, minlength=len(u))
    keep = s >= least - 1e-9
    return u[keep], s[keep]


def search(t: Texts, index: Index, least: float, overlap: float):
    """(document, item, score, question's share, answer's share) of verified matches in a slice."""
    w, h = words(t)
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 3
    at = np.flatnonzero(index.filter[(h >> U64(44)).astype(np.int64)])
    if not len(at) or not len(index.vocab):
        return none
    term = np.searchsorted(index.vocab, h[at])
    term[term == len(index.vocab)] = 0
    ok = index.vocab[term] == h[at]
    at, term = at[ok], term[ok]
    # Strides of SEGMENT words, numbered over the slice with a gap after each document.
    strides = np.maximum(1, -(-np.diff(w.first) // SEGMENT))
    base = np.concatenate([[0], np.cumsum(strides + 1)])
    doc = w.doc[at]
    stride = base[doc] + (at - w.first[doc]) // SEGMENT
    T = len(index.vocab)
    pairs = distinct(stride * T + term)
    stride, term = pairs // T, pairs % T
    bound = np.bincount(stride, index.top[term], minlength=int(base[-1]) + 1)
    bound[:-1] += bound[1:]
    hot = bound >= least - 1e-9  # passage = this stride and the next
    a, b = np.flatnonzero(hot[stride]), np.flatnonzero(hot[np.maximum(stride - 1, 0)] & (stride > 0))
    pairs = distinct(np.concatenate([stride[a] * T + term[a], (stride[b] - 1) * T + term[b]]))
    passage, term = pairs // T, pairs % T
    u, where = np.unique(passage, return_inverse=True)
    live = np.bincount(where, index.top[term], minlength=len(u))[where] >= least - 1e-9
    passage, term = passage[live], term[live]
    # Blocks whose maxima can reach the threshold, then the segments in them.
    pos, owner = spread(index.block_first, term)
    blocks = int(index.block.max()) + 1
    good, _ = over(passage[owner] * blocks + index.block[pos], index.block_top[pos], least)
    keep = among(passage, distinct(good // blocks))
    passage, term = passage[keep], term[keep]
    pos, owner = spread(index.first, term)
    inside = among(passage[owner] * blocks + index.segment[pos] // BLOCK_SEGMENTS, good)
    pos, owner = pos[inside], owner[inside]
    segments = len(index.item_of)
    found, score = over(passage[owner] * segments + index.segment[pos], index.impact[pos], least)
    doc = np.searchsorted(base, found // segments, "right") - 1
    item = index.item_of[found % segments]
    key, where = np.unique(doc * len(index.items) + item, return_inverse=True)
    best = np.zeros(len(key))
    np.maximum.at(best, where, score)
    rows, have, last = [], {}, -1
    for k, s in zip(key.tolist(), best.tolist()):
        d, i = divmod(k, len(index.items))
        if d != last:
            have, last = {}, d
        for n in index.size[i]:
            if n not in have:
                have[n] = runs(h[w.first[d] : w.first[d + 1]], n)
        shares = [among(x, have[n]).mean() if len(x) else 1.0 for x, n in zip((index.question[i], index.answer[i]), index.size[i])]
        if min(shares) >= overlap:
            rows.append((d, i, s, *shares))
    return tuple(np.array(x) for x in zip(*rows)) if rows else none


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


TERMS = "term long, segments long, words long"


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, segments, words): segments of ``t`` that hold each word; the null term has all segments and words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            h, segment, pieces, _ = pieces_of(b.column("t").to_pylist())
            n = int(pieces.sum())
            vocab, term = np.unique(h, return_inverse=True)
            df = np.bincount(distinct(term * max(n, 1) + segment) // max(n, 1), minlength=len(vocab))
            terms = pa.concat_arrays([pa.array(vocab.view(np.int64)), pa.nulls(1, pa.int64())])
            yield pa.record_batch([terms, pa.array(np.append(df, n)), pa.array(np.append(np.zeros(len(vocab), np.int64), len(h)))], [x.split()[0] for x in TERMS.split(", ")])

    return rows.select("t").mapInArrow(count, TERMS)


def indexes(items: DataFrame, id_col: str, text_col: str, index_chars: int) -> Iterator[Index]:
    """Indexes over bounded slices of the items, in the order of their ids."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null").distinct()
    size = F.length("t") + 64
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= index_chars:
        if total:
            part = rows.orderBy("i", "t").collect()
            yield Index.of([r.i for r in part], [r.t for r in part])
        return
    n = int(-(-2 * total // index_chars))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    counts = stored(term_counts(rows).groupBy("term").agg(F.sum("segments").alias("segments"), F.sum("words").alias("words")), "decontam-terms")
    every = counts.where("term is null").first()
    for k in range(n):
        part = rows.where(F.col("slice") == k).orderBy("i", "t").collect()
        if part:
            # Only this slice's words come to the driver.
            found = counts.join(term_counts(rows.where(F.col("slice") == k)).select("term").distinct(), "term").select("term", "segments").toArrow()
            term, df = (found.column(c).to_numpy().astype(np.int64) for c in ("term", "segments"))
            order = np.argsort(term.view(U64))
            yield Index.of([r.i for r in part], [r.t for r in part], Statistics(int(every.segments), every.words / every.segments, term.view(U64)[order], df[order]))


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: float = 0.75, overlap: float = 0.6, index_chars: int = 32_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item whose question and answer it holds.

    ``least``: the share of a segment's own BM25 score that a passage must reach.
    ``overlap``: the share of runs of three words of both question and answer that
    the document must hold.  Null texts and items match nothing, items without a
    word neither; a repeated row gives its pairs again, and a null id stays null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for index in indexes(items, item_id_col, item_text_col, index_chars):

        def find(batches, index=index):
            for b in slices(batches, most=SEARCH_BYTES):
                d, i, s, q, a = search(texts_of(b.column("text")), index, least, overlap)
                if len(d):
                    yield pa.record_batch([b.column("doc_id").take(pa.array(d.astype(np.int64))), pa.array([index.items[int(x)] for x in i], pa.int64()), pa.array(s, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        parts.append(rows.mapInArrow(find, FOUND))
    if not parts:  # no items
        return small_table(rows.sparkSession, [], [(c.split()[0], {"long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in FOUND.split(", ")])
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: float = 0.75, overlap: float = 0.6, index_chars: int = 32_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; a null text is kept."""
    for index in indexes(items, item_id_col, item_text_col, index_chars):

        def clean(batches, index=index):
            for b in slices(batches, text_col, SEARCH_BYTES):
                d = search(texts_of(b.column(text_col)), index, least, overlap)[0]
                keep = np.ones(b.num_rows, bool)
                keep[d.astype(np.int64)] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
