"""Groups of similar items from banded signatures, without pairs within a group.

Items that share a band meet as stars: each points to the least item of its
bucket, first within a block of items, then across blocks, so a bucket of any
size costs one row an item and no task sees more than a row a block for it.
Links are verified in two rounds, and whatever is connected already is not
compared again:

1. each item with one hub: of its buckets' hubs the one that meets most items;
2. within buckets that still hold several components every pair of items of
   different components, on the exact sets, where the items lie: only the links
   leave.  Nothing is left out, so a bucket of n items that are not alike costs
   up to n * n / 2 comparisons.

Components come from a union-find over partitions, every step a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import U64, deal, pack, unpack
from .storage import stored
from .text import give_back, slices

BLOCK_KEYS = 2_000_000
#: A larger bucket is cut into parts of so many items; a task compares two parts.
GROUP_ROWS = 1000
#: Cells of fewer items are compared pair by pair, others by products of matrices.
FEW = 32
#: Bytes of text that a task compares at once, unless a cell has more.
CELL_BYTES = 2 << 20
KEY_BITS = 44
#: Bits that tell most unlike sets apart before they are compared, and how many pairs (or items) are looked at so at once.
SKETCH_BITS = 1024
PAIRS = 4096
STARS = "bucket long, a long, b long"


def stars(items: DataFrame, shard_keys: int = 1_000_000) -> DataFrame:
    """(bucket, a, b): items ``a`` that share a band with the lesser item ``b``, as stars of stars."""
    keys = items.agg(F.sum(F.size("bands"))).first()[0] or 0
    shards = max(8, -(-int(keys) // shard_keys))
    # Of a key as much is sent as tells it from all others but one in 2**16; who meets by chance is verified like the rest.
    bits = min(64, max(32, int(keys).bit_length() + 16))
    cut = U64(64 - bits)
    schema = "shard int, kind int, keys binary, a binary, b binary"

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, item = np.concatenate([k for k, _ in held]) >> cut, np.concatenate([i for _, i in held])
            held.clear()
            order = np.argsort(key)
            key, item = key[order], item[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.minimum.reduceat(item, first)
            hub = np.repeat(least, np.diff(np.append(first, len(key))))
            spoke = np.flatnonzero(item != hub)
            rows = []
            if len(spoke):
                rows.append((int(key[spoke[0]] % U64(shards)), 1, pack(key[spoke]), pack(item[spoke].view(U64)), pack(hub[spoke].view(U64))))
            o, cuts, inner = deal(key[first] << cut, shards, bits)
            own = least[o]
            for s in range(shards):
                x, y = cuts[s], cuts[s + 1]
                if x < y:
                    rows.append((s, 0, pack(np.diff(inner[x:y], prepend=U64(0))), pack(own[x:y].view(U64)), b""))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["shard", "kind", "keys", "a", "b"])

        for b in batches:
            bands, ids = b.column("bands"), b.column("id").to_numpy()
            first = bands.offsets.to_numpy()
            flat = bands.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
            if len(flat):
                held.append((flat.view(U64), np.repeat(ids, np.diff(first))))
            if sum(len(k) for k, _ in held) >= BLOCK_KEYS:
                yield flush()
        if held:
            yield flush()
        give_back()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = []
        near = frame[frame["kind"] == 1]
        for x in near.itertuples():
            out.append((unpack(x.keys), unpack(x.a).view(np.int64), unpack(x.b).view(np.int64)))
        far = frame[frame["kind"] == 0]
        if len(far):
            shard = U64(far["shard"].iloc[0])
            key = np.concatenate([np.cumsum(unpack(k), dtype=U64) for k in far["keys"]])
            item = np.concatenate([unpack(i).view(np.int64) for i in far["a"]])
            order = np.argsort(key)
            key, item = key[order], item[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            hub = np.repeat(np.minimum.reduceat(item, first), np.diff(np.append(first, len(key))))
            spoke = item != hub
            out.append((key[spoke] * U64(shards) + shard, item[spoke], hub[spoke]))
        key, a, b = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"bucket": key.view(np.int64), "a": a, "b": b})

    return items.select("id", "bands").mapInArrow(block, schema).groupBy("shard").applyInPandas(meet, STARS)


def forest(edges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """(item, root) of the components of some edges, the root being the least item, and whether that says more than the edges did."""
    a, b = edges
    items, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(items))
    while True:
        m = np.minimum(root[x], root[y])
        low = root.copy()
        np.minimum.at(low, root[x], m)
        np.minimum.at(low, root[y], m)
        low = low[low]
        while (again := low[low]).tolist() != low.tolist():
            low = again
        low = low[root]
        if np.array_equal(low, root):
            break
        root = low
    spoke = np.flatnonzero(root != np.arange(len(items)))
    return items[spoke], items[root[spoke]], bool((items[root[x]] != b).any())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least item each linked item is connected with.

    Every edge goes to the partitions of both its ends; a partition replaces its
    edges by stars around the least item of each component it sees.  When no
    partition learns anything, every item points to its root.
    """
    schema = "a long, b long, news boolean"

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if parts:
            a, b, news = forest(tuple(np.concatenate(x) for x in zip(*parts)))
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), news))], ["a", "b", "news"])

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    # What lies in one partition already is settled before anything is shuffled.
    edges = edges.mapInArrow(settle, schema)
    while True:
        both = edges.select("a", "b", F.explode(F.array("a", "b")).alias("key")).repartition("key").select("a", "b")
        edges = stored(both.mapInArrow(settle, schema), "edges")
        if not edges.where("news").head(1):
            break
    star = edges.select("a", "b").distinct()
    return star.selectExpr("a AS id", "b AS component").unionByName(star.selectExpr("b AS id", "b AS component").distinct())


#: Bits of the filter that ``sieve`` makes: 1 MB, however many ids there are.
SIEVE_BITS = 23


def sieve(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that all the ids pass (and some others: it only saves shuffling)."""
    slot = F.col("id").bitwiseAND((1 << SIEVE_BITS) - 1) + 1
    bits = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for r in ids.select(F.bitmap_bucket_number(slot).alias("n"), F.bitmap_bit_position(slot).alias("at")).groupBy("n").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        part = np.frombuffer(r["bits"], np.uint8)
        bits[(r["n"] - 1) * 4096 : (r["n"] - 1) * 4096 + len(part)] = part
    return bits


def sifted(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = ids & ((1 << SIEVE_BITS) - 1)
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


class Sets(NamedTuple):
    """Weighted sets: sorted by item, then key (of KEY_BITS), each once; ``unit`` is the weight of one of ``count``."""

    item: np.ndarray
    key: np.ndarray
    count: np.ndarray
    unit: np.ndarray


def group(items: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets: Callable[[pa.Array], Sets], least: float, twins: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) of every item linked to another.

    ``items``: id, bands (array of long).  ``fetch`` takes ids and returns (id,
    text); it is asked once, for the items that share a band with another.  ``sets``
    gives the sets of a column of texts (or whatever stands for them); a weighted Jaccard similarity of ``least`` is a link.
    ``twins`` takes ids and returns (a, b) of those that are one thing under two ids.
    """
    star = stars(items)
    member = stored(star.select("bucket", F.col("a").alias("id")).unionByName(star.select("bucket", F.col("b").alias("id"))).distinct(), "members")
    texts = stored(fetch(member.select("id").distinct()), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(texts.selectExpr("id AS a", "text AS ta"), "a").join(texts.selectExpr("id AS b", "text AS tb"), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "ta"):
                n = b.num_rows
                both = pa.concat_arrays([b.column("ta"), b.column("tb")])
                alike = Compared(sets(both), 2 * n).similarity(np.arange(n), np.arange(n) + n)
                yield b.filter(pa.array(alike >= least - 1e-9)).select(["a", "b"])

        return full.mapInArrow(check, "a long, b long")

    # The hub of a bucket is the item that meets most others: a copied original rather than one of its altered copies.
    size = member.groupBy("bucket").agg(F.count("*").alias("n"))
    met = member.join(size, "bucket").groupBy("id").agg(F.sum("n").alias("met"))
    ranked = stored(member.join(met, "id"), "ranked")
    hub = ranked.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("id"))).alias("hub"))
    pairs = ranked.join(hub, "bucket").select(F.col("id").alias("x"), (-F.col("hub.id")).alias("y"), F.col("hub.met").alias("met")).where("x <> y")
    first = pairs.groupBy("x").agg(F.max_by("y", F.struct("met", "y")).alias("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    links = verify(first)
    if twins is not None:
        links = links.unionByName(twins(member.select("id").distinct()))
    # Stored first: a task that compares and settles at once would keep two Python workers.
    comp = stored(components(stored(links, "verified")), "components")

    # Buckets that hold several components; of those with the same items one.
    state = member.join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    about = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("who"))
    mixed = about.where("x < y").dropDuplicates(["n", "who"]).select("bucket", "n")
    state = stored(state.join(mixed, "bucket").join(texts, "id"), "mixed")
    found = stored(across(state, sets, least), "links")
    if not found.head(1):
        return comp
    # What they link is merged as components, not item by item.
    merged = stored(components(found), "merged").selectExpr("id AS component", "component AS into")
    single = merged.join(comp, merged["component"] == comp["id"], "left_anti").selectExpr("component AS id", "into AS component")
    return stored(comp.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component")).unionByName(single), "components")


class Compared:
    """Some items' sets, for exact similarities of any pairs of them."""

    def __init__(self, s: Sets, n: int):
        self.sets = s
        self.plain = bool((s.count == 1).all() and (s.unit == 1).all())
        self.weight = s.unit if self.plain else s.count * s.unit
        self.total = np.bincount(s.item, self.weight, minlength=n)
        self.first = np.searchsorted(s.item, np.arange(n + 1))
        self.full = (s.item.astype(U64) << U64(KEY_BITS)) | s.key

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        size = np.diff(self.first)
        i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
        for z in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size[i]) // 1_000_000)) + 1) if len(i) else ():
            n = size[i[z]]
            pair = np.repeat(np.arange(len(z)), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[i[z]], n)
            key = (j[z][pair].astype(U64) << U64(KEY_BITS)) | self.sets.key[at]
            found = np.minimum(np.searchsorted(self.full, key), len(self.full) - 1)
            hit = np.flatnonzero(self.full[found] == key)
            both = np.minimum(self.weight[at[hit]], self.weight[found[hit]])
            both = np.bincount(pair[hit], both, minlength=len(z))
            out[z] = both / np.maximum(self.total[i[z]] + self.total[j[z]] - both, 1e-12)
        return out

    def fits(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether two sets are of so like a weight that they can be links."""
        a, b = self.total[i], self.total[j]
        return np.minimum(a, b) >= (least - 1e-9) * np.maximum(a, b)

    def near(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether so few bits differ that two sets can be links; only for sets whose elements weigh 1.

        Each bit that one set has and the other has not is an element, at least, that they do
        not share; of such, links have ``(1 - least) / (1 + least)`` of both totals at most.
        """
        bits = self.sketches()
        out = np.empty(len(i), bool)
        for x in range(0, len(i), PAIRS):
            z = slice(x, x + PAIRS)
            apart = np.bitwise_count(bits[i[z]] ^ bits[j[z]]).sum(1, dtype=np.int64)
            out[z] = apart <= (1 - least + 1e-6) / (1 + least) * (self.total[i[z]] + self.total[j[z]])
        return out

    def sketches(self) -> np.ndarray:
        """For each item SKETCH_BITS bits, those set that one of its keys falls on."""
        n = len(self.total)
        out = np.empty((n, SKETCH_BITS // 64), U64)
        bit = (self.sets.key >> U64(KEY_BITS - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
        for x in range(0, n, PAIRS):
            y = min(x + PAIRS, n)
            p, q = self.first[x], self.first[y]
            held = np.zeros((y - x, SKETCH_BITS), bool)
            held[self.sets.item[p:q] - x, bit[p:q]] = True
            out[x:y] = np.packbits(held, axis=1).view(U64)
        return out

    def shared(self, rows: np.ndarray, columns: np.ndarray, width: int = 2048) -> np.ndarray:
        """The weight that each row's set has in common with each column's, in single precision."""
        both = np.unique(np.concatenate([rows, columns]))
        n = np.diff(self.first)[both]
        owner = np.repeat(np.arange(len(both)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[both], n)
        # The k-th copy of a key is an element of its own: the lesser count is what two items have in common.
        count = self.sets.count[at]
        owner, unit = np.repeat(owner, count), np.repeat(self.sets.unit[at], count)
        copy = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        element, df = np.unique(np.repeat(self.sets.key[at], count) | (copy.astype(U64) << U64(KEY_BITS)), return_inverse=True, return_counts=True)[1:]
        many = df > 1
        place = (np.cumsum(many) - 1)[element]
        keep = np.flatnonzero(many[element])
        keep = keep[np.argsort(place[keep], kind="stable")]
        owner, place, root = owner[keep], place[keep], np.sqrt(unit[keep]).astype(np.float32)
        x, y = np.searchsorted(both, rows), np.searchsorted(both, columns)
        out = np.zeros((len(rows), len(columns)), np.float32)
        for a in range(0, int(many.sum()), width):
            p, q = np.searchsorted(place, [a, a + width])
            dense = np.zeros((len(both), width), np.float32)
            dense[owner[p:q], place[p:q] - a] = root[p:q]
            out += dense[x] @ dense[y].T
        return out


def across(state: DataFrame, sets: Callable[[pa.Array], Sets], least: float) -> DataFrame:
    """(a, b): components that a link between items of one bucket connects.

    ``state``: bucket, n (its size), id, component, text.  All pairs of different
    components are compared where they lie; a large bucket is cut into parts, and
    every two parts meet in a cell.
    """
    parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    dealt = state.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component", "text")
    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            bucket, p, q, own, ids, comp = (rows.column(c).to_numpy() for c in ("bucket", "p", "q", "own", "id", "component"))
            _, at, item = np.unique(ids, return_index=True, return_inverse=True)
            c = Compared(sets(rows.column("text").take(pa.array(at))), len(at))
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            size = np.diff(np.append(first, len(ids)))
            left = np.flatnonzero(np.repeat((size <= FEW) & (p[first] == q[first]), size))
            after = np.repeat(first + size, size)[left] - left - 1
            i = np.repeat(left, after)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            ok = comp[i] != comp[j]
            i, j = i[ok], j[ok]
            # A pair that meets in several buckets is compared once.
            pair = np.unique(np.minimum(item[i], item[j]) * len(at) + np.maximum(item[i], item[j]), return_index=True)[1]
            i, j = i[pair], j[pair]
            ok = c.fits(item[i], item[j], least)
            i, j = i[ok], j[ok]
            if c.plain:
                ok = c.near(item[i], item[j], least)
                i, j = i[ok], j[ok]
            ok = c.similarity(item[i], item[j]) >= least - 1e-9
            found = [(comp[i[ok]], comp[j[ok]])]
            for f, n in zip(first.tolist(), size.tolist()):
                if n > FEW or p[f] != q[f]:
                    z = slice(f, f + n)
                    found.append(linked(c, item[z], comp[z], own[z] if p[f] != q[f] else None, least))
            a, b = (np.concatenate(x) for x in zip(*found))
            if len(a):
                a, b, _ = forest((np.maximum(a, b), np.minimum(a, b)))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])
            del c, rows
            give_back()

    return dealt.mapInArrow(compare, "a long, b long")


def linked(c: Compared, item: np.ndarray, comp: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components of a large cell that links connect; pairs of one side are left to another cell."""
    names, label = np.unique(comp, return_inverse=True)
    # One item of every pair lies outside the largest component.
    few = label != np.bincount(label).argmax()
    if side is None:
        halves = [(np.flatnonzero(few), np.arange(len(item)))]
    else:
        one = side == side.min()
        halves = [(np.flatnonzero(few & one), np.flatnonzero(~one)), (np.flatnonzero(few & ~one), np.flatnonzero(one))]
    a, b = [], []
    for rows, columns in halves:
        if not len(rows) or not len(columns):
            continue
        both = c.shared(item[rows], item[columns])
        for k, r in enumerate(rows.tolist()):
            todo = np.flatnonzero(label[columns] != label[r])
            alike = both[k, todo] / np.maximum(c.total[item[r]] + c.total[item[columns[todo]]] - both[k, todo], 1e-12)
            # Single precision decides unless it is close.
            sure = alike >= least + 1e-3
            near = np.flatnonzero(~sure & (alike >= least - 1e-3))
            sure[near] = c.similarity(np.full(len(near), item[r]), item[columns[todo[near]]]) >= least - 1e-9
            other = np.unique(label[columns[todo[sure]]])
            if len(other):
                a.append(np.full(len(other), names[label[r]]))
                b.append(names[other])
                label[np.isin(label, other)] = label[r]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches in tables that end where a cell (bucket, p, q) ends."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if sum(t.nbytes for t in held) >= CELL_BYTES:
            t = pa.concat_tables(held)
            bucket, p, q = (t.column(c).to_numpy() for c in ("bucket", "p", "q"))
            last = np.flatnonzero((bucket[:-1] != bucket[1:]) | (p[:-1] != p[1:]) | (q[:-1] != q[1:]))
            if len(last):
                yield t.slice(0, int(last[-1]) + 1).combine_chunks()
                held = [t.slice(int(last[-1]) + 1)]
    if held:
        yield pa.concat_tables(held).combine_chunks()
