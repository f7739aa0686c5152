"""Quality rules: statistics of a text, and a decision list learned from labelled ones.

Sequential covering learns rules one after another: a rule is grown, threshold by
threshold, on two thirds of the rows not covered yet, to gain most information on
the rows to reject, then pruned from its end on the other third.  Learning stops
when a rule is no better than chance on the pruning rows.  The list becomes one
ordered ``CASE WHEN`` of Spark: the first rule that holds rejects, else a
document is kept.

Statistics are taken on the bytes of Arrow batches in one pass without a shuffle.
Only the sample for learning comes to the driver: at most ``most_rows`` labelled
rows, the first by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import small_table
from .text import SPACE, U64, Texts, mix, per_doc, prefix_hash, shingle_hashes, slices, span_hash, texts_of, words_of

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_word_chars", "symbol_share", "dup_line_share", "repeat_word_share", "digit_share", "upper_share", "mark_share", "distinct_word_share", "mean_line_words"]


def byte_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def statistics(t: Texts) -> dict[str, np.ndarray]:
    """Counts and shares of each document of a slice.  Shares of nothing are 0."""
    data, cuts, n = t.data, t.offsets, len(t)
    w = words_of(t)
    run = prefix_hash(data)
    h = span_hash(run, w.start, w.end)
    solid = ~SPACE[data]
    points = solid & ((data & 0xC0) != 0x80)
    out = {"n_words": np.diff(w.first), "word_chars": per_doc(points, cuts), "n_symbols": per_doc(byte_table(SYMBOLS)[data], cuts)}
    # Lines with a word, and those equal to an earlier one of the same document.
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([cuts[:-1], breaks + 1]))
    end = np.sort(np.concatenate([cuts[1:], breaks]))
    filled = np.concatenate([[0], np.cumsum(solid)])
    live = filled[end] > filled[start]
    start, end = start[live], end[live]
    doc = np.searchsorted(cuts, start, "right") - 1
    lines = np.bincount(doc, minlength=n)
    x = span_hash(run, start, end)
    order = np.lexsort((x, doc))
    d, x = doc[order], x[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    out["n_dup_lines"] = np.bincount(d[again], minlength=n)
    # Words within a window of five that the document has twice or more.
    five, owner = shingle_hashes(h, w, 5)
    full = out["n_words"][owner] >= 5
    five, owner = mix(five[full] + owner[full].astype(U64) * U64(0x9E3779B97F4A7C15)), owner[full]
    counts = np.maximum(out["n_words"] - 4, 0)
    at = np.arange(len(five)) - np.repeat(np.cumsum(counts) - counts, counts) + w.first[owner]
    order = np.argsort(five)
    same = five[order][1:] == five[order][:-1]
    twice = np.zeros(len(five), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(edge)[: len(h)] > 0, w.first)
    # Shares.
    k = mix(h + w.doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    own = np.argsort(k)
    k = k[own]
    fresh = np.ones(len(h), bool)
    fresh[1:] = k[1:] != k[:-1]
    distinct = np.bincount(w.doc[own][fresh], minlength=n)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    words, chars = out["n_words"], out["word_chars"]
    out["mean_word_chars"] = share(chars, words)
    out["symbol_share"] = share(out["n_symbols"], chars)
    out["dup_line_share"] = share(out["n_dup_lines"], lines)
    out["repeat_word_share"] = share(out["n_repeat_words"], words)
    out["digit_share"] = share(per_doc(byte_table(b"0123456789")[data], cuts), chars)
    out["upper_share"] = share(per_doc((data >= 65) & (data <= 90), cuts), chars)
    out["mark_share"] = share(per_doc(byte_table(b".,;:!?\"'()[]{}-_/=+@^~`\\")[data], cuts), chars)
    out["distinct_word_share"] = share(distinct, words)
    out["mean_line_words"] = share(words, lines)
    return out


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and, as ``_stats``, the statistics of the text (null: empty)."""
    # The text is sent once, also if it is kept.
    name = text_col if text_col in keep and dict(docs.dtypes)[text_col] == "string" else "_stats_text"
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text_col}`").cast("string").alias(name)] if name not in keep else []))
    inner = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES])
    fields = [f for f in rows.schema.fields if f.name != "_stats_text"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name):
            s = statistics(texts_of(b.column(name)))
            stats = pa.StructArray.from_arrays([pa.array(s[c].astype(np.int64)) for c in COUNTS] + [pa.array(s[c].astype(float)) for c in SHARES], COUNTS + SHARES)
            yield pa.record_batch([*[b.column(i) for i in range(len(fields))], stats], [*[f.name for f in fields], "_stats"])

    return rows.mapInArrow(add, T.StructType([*fields, T.StructField("_stats", inner)]))


class Condition(NamedTuple):
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, stats: Column) -> Column:
        c = stats.getField(self.feature)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = list  # of conditions, all of which must hold


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Add the threshold of the greatest information gain until no good row is covered."""
    rule, live = [], np.ones(len(bad), bool)
    while len(rule) < most and live.any():
        p, n = int(bad[live].sum()), int((~bad[live]).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (0.0, None)
        for f, edges in cuts.items():
            bins = np.searchsorted(edges, x[f][live], "right")
            P, N = (np.bincount(bins[y], minlength=len(edges) + 1) for y in (bad[live], ~bad[live]))
            up = [np.cumsum(a[::-1])[::-1][1:] for a in (P, N)]
            for above, (a, b) in ((True, up), (False, (p - up[0], n - up[1]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - before), 0.0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(f, above, float(edges[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, rules: int = 12, conditions: int = 3, precision: float = 0.9, bins: int = 64, seed: int = 7) -> list[Rule]:
    """A decision list for the rows in ``bad``; empty if nothing separates them."""
    n = len(bad)
    prune = np.random.default_rng(seed).permutation(n) % 3 == 0
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for f, v in x.items()} if n else {}
    live, out = np.ones(n, bool), []
    take = lambda m: ({f: v[m] for f, v in x.items()}, bad[m])
    while len(out) < rules and bad[live].any():
        (gx, gy), (px, py) = take(live & ~prune), take(live & prune)
        rule = grow(gx, gy, cuts, conditions)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, int]:
            hit = covered(r, px, len(py))
            p, q = int(py[hit].sum()), int((~py[hit]).sum())
            return (p - q) / (p + q) if p + q else -1.0, -len(r)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        hit = covered(rule, x, n) & live
        held = hit & prune
        p, q = int(bad[held].sum()), int((~bad[held]).sum())
        if p < 1 or p / (p + q) < precision:
            break
        out.append(rule)
        live &= ~hit
    return out


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The list as an ordered conditional: false where a rule rejects, else true."""
    out = None
    for rule in rules:
        cond = rule[0].column(stats)
        for c in rule[1:]:
            cond = cond & c.column(stats)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: Column) -> Column:
    return (stats.getField("n_words") < 10) | (100 * stats.getField("n_repeat_words") > 20 * stats.getField("n_words"))


def learn_from(docs: DataFrame, labels: DataFrame, *, most_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", **options) -> list[Rule]:
    """Learn from a bounded sample of the labelled documents (label: column ``quality``, 0 is to reject)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_bad"))
    sample = known.groupBy("_id").agg(F.min("_bad").alias("_bad")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = sample.collect()
    if not rows:
        return []
    # At most ``most_rows`` pairs of numbers: small enough to send whatever the size of the corpus.
    table = small_table(labels.sparkSession, [(r["_id"], r["_bad"]) for r in rows], [("_id", pa.int64()), ("_bad", pa.int32())])
    chosen = docs.join(F.broadcast(table), F.col(f"`{id_col}`").cast("long") == F.col("_id")).select(F.col("_id").alias("_stats_id"), F.col("_bad").alias("_stats_bad"), F.col(f"`{text_col}`").alias("_t"))
    got = with_statistics(chosen, ["_stats_id", "_stats_bad"], "_t").select("_stats_id", "_stats_bad", "_stats.*").toPandas()
    got = got.drop_duplicates("_stats_id").sort_values("_stats_id")
    # Documents that the base rules reject anyway teach nothing.
    got = got[~((got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words))]
    x = {f: got[f].to_numpy(float) for f in ["n_words", *SHARES]}
    return learn(x, (got._stats_bad == 0).to_numpy(), **options)


def judge(docs: DataFrame, rules: list[Rule], *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with ``_stats``, ``_base_failed`` and ``_kept``.

    A null or empty text has no words, so the base rules reject it.  Repeated rows
    are judged alike.  Other columns pass through as they are.
    """
    rows = with_statistics(docs, keep, text_col).withColumn("_base_failed", base_failed(F.col("_stats")))
    return rows.withColumn("_kept", ~F.col("_base_failed") & verdict(rules, F.col("_stats")))
