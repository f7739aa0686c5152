"""Near-duplicate documents by improved consistent weighted sampling (Ioffe 2010).

A document is the set of its runs of five words (A-Z lower-cased), weighted by
TF-IDF: how often the run occurs times ln(1 + N / df), where a document frequency
below a share ``floor`` of all documents counts as that share (0: df as it is).
The document frequency of every run is counted: blocks of documents send each
distinct run once to the shard of its hash and get its frequency back.  Documents
keep the frequencies only; the runs of those that share a band are read from their
texts again for verification.

A sample of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) by the run and takes
t = floor(ln w / r + b); the run of least ln c - r (t - b + 1) is the sample, and
that value stands for (run, t).  Four samples make a band.  Two documents of
weighted Jaccard similarity 0.8 share one of 16 bands with probability 0.9998.
Exact copies are one item; see ``neardup`` for the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import deal, pack, pack_sorted, summed, unpack, unpack_sorted
from .neardup import KEY_BITS, Sets, group, sieve, sifted
from .storage import drop, stored
from .text import U64, Texts, give_back, mix, process_cache, shingle_hashes, slices, texts_of, word_hashes, words_of

BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Rows of the tables of random numbers; a run picks one row of each by its own bits.
TABLE = 4096
CHUNK = 4096


def runs(t: Texts, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, run, count), sorted: the distinct runs of words of each document of a slice."""
    w = words_of(t)
    h, doc = shingle_hashes(word_hashes(t, w), w, size)
    key = np.sort((doc.astype(U64) << U64(KEY_BITS)) | (h >> U64(64 - KEY_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return (key[first] >> U64(KEY_BITS)).astype(np.int64), key[first] & U64((1 << KEY_BITS) - 1), count


BLOCK = "block string, docs binary, digests binary, sizes binary, keys binary, counts binary, rows long, runs long"
ASK = "shard int, block string, keys binary, df binary"
ANSWER = "block string, shard int, df binary"


def make_blocks(batches: Iterator[pa.RecordBatch], block_runs: int) -> Iterator[pa.RecordBatch]:
    """Documents as their distinct runs and how often each occurs."""
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]]) for x in BLOCK.split(", ")])
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        docs, digest, size, key, n = zip(*held)
        sink = pa.BufferOutputStream()
        ids = pa.concat_arrays(docs)
        with pa.ipc.new_stream(sink, pa.schema([("d", pa.int64())])) as w:
            w.write_batch(pa.record_batch([ids], ["d"]))
        row = [uuid.uuid4().hex, sink.getvalue().to_pybytes(), b"".join(x for d in digest for x in d), pack(np.concatenate(size)), pack(np.concatenate(key)), pack(np.concatenate(n)), len(ids), sum(map(len, key))]
        held.clear()
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    for b in slices(batches):
        t = texts_of(b.column("text"))
        doc, key, n = runs(t)
        held.append((b.column("doc_id"), b.column("digest").to_pylist(), np.bincount(doc, minlength=len(t)), steps(doc, key), n))
        if sum(len(h[3]) for h in held) >= block_runs:
            yield block()
    if held:
        yield block()


def steps(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ascending keys of each document as the first and the differences."""
    return np.where(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(key)], key, np.diff(key, prepend=U64(0)))


def keys_of(row) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The keys of a block and how many each document has."""
    size, total = unpack(row.sizes).astype(np.int64), np.cumsum(unpack(row.keys), dtype=U64)
    before = np.concatenate([np.zeros(1, U64), total])[np.cumsum(size) - size]
    return total - np.repeat(before, size), size


def distinct_runs(row, shards: int) -> tuple:  # noqa: ANN001
    """Of a block: the distinct run of each run, how many documents have it, and the distinct runs as ``deal`` orders them."""
    keys, inverse, n = np.unique(keys_of(row)[0], return_inverse=True, return_counts=True)
    return inverse, n, deal(keys << U64(64 - KEY_BITS), shards, KEY_BITS)


def ask(frames: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            _, n, (o, cuts, inner) = distinct_runs(row, shards)
            full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            yield pd.DataFrame({"shard": full, "block": row.block, "keys": [pack_sorted(inner[cuts[s] : cuts[s + 1]]) for s in full], "df": [pack(n[o][cuts[s] : cuts[s + 1]]) for s in full]})
        del frame
    give_back()


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    give_back()
    keys = [unpack_sorted(x) for x in frame["keys"]]
    total = summed(np.concatenate(keys), np.concatenate([unpack(x) for x in frame["df"]]).astype(np.int64))
    return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "df": [pack(x) for x in np.split(total, np.cumsum([len(k) for k in keys])[:-1])]})


def tables() -> tuple[np.ndarray, ...]:
    """r, 1 / r, ln c and b for each table row and sample, from a counter-based generator."""
    cache = process_cache()
    if "icws" not in cache:
        u = [((mix(np.arange(TABLE * SAMPLES, dtype=U64) + U64(k << 40)) >> U64(11)).astype(float) + 0.5) / 2**53 for k in range(1, 6)]
        r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
        cache["icws"] = tuple(x.reshape(TABLE, SAMPLES).astype(np.float32) for x in (r, 1 / r, np.log(c), u[4]))
    return cache["icws"]


def sample(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """For each document, the value of each of its samples."""
    r, inv, lnc, beta = tables()
    out = np.full((docs, SAMPLES), np.inf, np.float32)
    lnw = np.log(weight).astype(np.float32)
    at = [((key >> U64(s)) & U64(TABLE - 1)).astype(np.int64) for s in (0, 12, 24)]
    for a in range(0, len(key), CHUNK):
        z = slice(a, a + CHUNK)
        rows, b = r[at[0][z]], beta[at[2][z]]
        t = inv[at[0][z]]
        t *= lnw[z, None]
        t += b
        np.floor(t, out=t)
        t -= b
        t += np.float32(1)
        t *= rows
        np.subtract(lnc[at[1][z]], t, out=t)
        first = np.flatnonzero(np.concatenate([[True], doc[z][1:] != doc[z][:-1]]))
        d = doc[z][first]
        out[d] = np.minimum(out[d], np.minimum.reduceat(t, first, axis=0))
    return out


SIGNED = "doc_id long, digest binary, bands array<long>, df binary"


def sign(left: pd.DataFrame, right: pd.DataFrame, shards: int, idf: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """A block's documents with their bands and the document frequencies of their runs, packed."""
    give_back()
    row = next(left.itertuples())
    inverse, n, (o, cuts, _) = distinct_runs(row, shards)
    df = np.zeros(len(n), np.int64)
    for x in right.itertuples():
        df[o[cuts[x.shard] : cuts[x.shard + 1]]] = unpack(x.df).astype(np.int64)
    df, n = df[inverse], unpack(row.counts).astype(np.int64)
    key, size = keys_of(row)
    doc, first = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)]).tolist()
    values = sample(doc, key, n * idf(df), len(size)).view(np.uint32).astype(U64)
    h = np.zeros((len(size), BANDS), U64)
    for k in range(ROWS):
        h = mix(h * U64(0xA0761D6478BD642F) + values[:, k::ROWS] + np.arange(BANDS, dtype=U64)[None, :])
    h = h.view(np.int64)
    ids = pa.ipc.open_stream(row.docs).read_all().column(0).to_pylist()
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "digest": [row.digests[16 * i : 16 * i + 16] for i in range(len(size))], "bands": [b if s else b[:0] for b, s in zip(h, size.tolist())], "df": [pack(df[x:y]) for x, y in zip(first, first[1:])]})


def with_digest(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Ids, texts and the MD5 of each text; null counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), *more)


def classes(rows: DataFrame, least: float, floor: float, block_runs: int, shard_runs: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, class_id, stays) of every text with words and an id.

    ``class_id`` is the least id of a text's class; ``stays`` marks one text of each class, of that id.
    """
    blocks = stored(rows.mapInArrow(lambda it: make_blocks(it, block_runs), BLOCK), "runs")
    meta = blocks.agg(F.sum("rows"), F.sum("runs")).first()
    total, shards = int(meta[0] or 0), max(8, -(-int(meta[1] or 0) // shard_runs))
    answers = blocks.mapInPandas(lambda it: ask(it, shards), ASK).groupBy("shard").applyInPandas(answer, ANSWER)

    def idf(df: np.ndarray) -> np.ndarray:
        return np.log1p(total / np.maximum(df, floor * total))

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return sign(left, right, shards, idf)

    sig = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, SIGNED), "signatures")
    drop(blocks)
    items = sig.where("size(bands) > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("df").alias("df"))
    items = stored(items.withColumn("id", F.monotonically_increasing_id()), "items")

    def fetch(ids: DataFrame) -> DataFrame:
        """The runs of each item, from the text of its row, and their frequencies."""
        ids = ids.join(items.select("id", "doc", "digest", "df"), "id")
        wanted = sieve(ids.select(F.col("doc").alias("id")))

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                b = b.filter(pa.array(sifted(b.column("doc_id").to_numpy(zero_copy_only=False), wanted)))
                doc, key, n = runs(texts_of(b.column("text")))
                first, d = np.searchsorted(doc, np.arange(b.num_rows + 1)).tolist(), steps(doc, key)
                packed = [pack(np.concatenate([d[x:y], n[x:y].astype(U64)])) for x, y in zip(first, first[1:])]
                yield pa.record_batch([b.column("doc_id"), b.column("digest"), pa.array([len(x).to_bytes(4, "little") + x for x in packed], pa.binary())], ["doc", "digest", "runs"])

        some = rows.where("doc_id IS NOT NULL").mapInArrow(sift, "doc long, digest binary, runs binary")
        return some.join(ids, ["doc", "digest"]).dropDuplicates(["id"]).select("id", F.concat("runs", "df").alias("text"))

    def sets(column: pa.Array) -> Sets:
        if not len(column):
            return Sets(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0))
        key, n, df = [], [], []
        for x in column.to_pylist():
            to = 4 + int.from_bytes(x[:4], "little")
            steps, count = unpack(x[4:to]).reshape(2, -1)
            key.append(np.cumsum(steps, dtype=U64))
            n.append(count)
            df.append(unpack(x[to:]))
        return Sets(np.repeat(np.arange(len(key)), [len(x) for x in key]), np.concatenate(key), np.concatenate(n).astype(np.int64), idf(np.concatenate(df).astype(np.int64)))

    comp = group(items.select("id", "bands"), fetch, sets, least)
    linked = items.select("id", "doc", "digest").join(comp, "id")
    first = linked.groupBy("component").agg(F.min(F.struct("doc", "digest")).alias("first"))
    linked = linked.join(first, "component").select("id", F.col("first.doc").alias("class"), (F.col("digest") == F.col("first.digest")).alias("first"))
    return sig.select("doc_id", "digest"), items.select("id", "doc", "digest").join(linked, "id", "left").select("digest", F.coalesce("class", "doc").alias("class_id"), F.coalesce("first", F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, floor: float = 0.0, block_runs: int = 250_000, shard_runs: int = 500_000) -> DataFrame:
    """(doc_id, class_id) of every row: the least id among the documents it is connected with.

    Documents are linked by a weighted Jaccard similarity of ``least`` or more.  A
    text of fewer than five words is one run of them all; texts without a word
    (null, empty) are classes of their own.  Rows of one text share a class, also
    under one id; a row without an id takes the class of its text's least id, and
    null if there is none.  Different texts of one id are documents of their own.
    """
    rows, of = classes(with_digest(docs, id_col, text_col), least, floor, block_runs, shard_runs)
    return rows.join(of, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, floor: float = 0.0, block_runs: int = 250_000, shard_runs: int = 500_000) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class, once.

    Rows without an id and texts without a word are kept; of repeated rows of one
    id and text one stays.
    """
    _, of = classes(with_digest(docs, id_col, text_col), least, floor, block_runs, shard_runs)
    chosen = of.where("stays").select(F.col("class_id").alias("doc_id"), "digest", F.lit(True).alias("chosen"))
    # Joined by id and digest, so a text that a third of all rows hold is no hot key.
    rows = with_digest(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("text")
    named = rows.where("doc_id IS NOT NULL").join(chosen, ["doc_id", "digest"], "left").where("chosen OR blank").dropDuplicates(["doc_id", "digest"])
    return named.select("row").unionByName(rows.where("doc_id IS NULL").select("row")).select("row.*")
