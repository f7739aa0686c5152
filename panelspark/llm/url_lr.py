"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Host, path and rule are Spark expressions.  The model is trained on the driver
from a small labelled table, at most ``most_rows`` distinct URLs, and its weights
(a fixed number) go with the tasks; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import U64, mix, prefix_hash, span_hash, texts_of

#: The rules of the query, as (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


class Model(NamedTuple):
    """Weights over hashed n-grams, and a constant."""

    weights: np.ndarray
    constant: float
    sizes: tuple[int, ...]

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, feature = features(hosts, paths, self.sizes, len(self.weights))
        return self.constant + np.bincount(row, self.weights[feature], minlength=len(hosts))


def features(hosts: pa.Array, paths: pa.Array, sizes: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct character n-grams of each host (within ``^ $``) and path."""
    rows, keys = [], []
    for side, column in ((1, hosts), (2, paths)):
        mark = pa.array(["^" + (x or "") + "$" for x in column.to_pylist()], pa.large_string())
        t = texts_of(mark)
        h, n = prefix_hash(t.data), len(t.data)
        owner = np.repeat(np.arange(len(t)), np.diff(t.offsets))
        for size in sizes:
            start = np.arange(max(0, n - size + 1))
            start = start[owner[start] == owner[start + size - 1]] if len(start) else start
            rows.append(owner[start])
            keys.append(span_hash(h, start, start + size, side))
    row, key = np.concatenate(rows), np.concatenate(keys)
    bucket = (mix(key) % U64(buckets)).astype(np.int64)
    pair = np.sort(row * buckets + bucket)
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    return pair // buckets, pair % buckets


def train(hosts: list[str], paths: list[str], block: np.ndarray, *, sizes: Sequence[int] = (3, 4, 5), buckets: int = 1 << 16, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Full-batch logistic regression with per-weight step sizes; with one class only, a constant."""
    w, n = np.zeros(buckets), len(block)
    if not n or block.all() or not block.any():
        return Model(w, 0.0 if not n else 4.0 if block.all() else -4.0, tuple(sizes))
    row, feature = features(pa.array(hosts), pa.array(paths), sizes, buckets)
    y, c = block.astype(float), 0.0
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    seen, c_seen = np.full(buckets, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(c + np.bincount(row, w[feature], minlength=n))))
        g = np.bincount(feature, (p - y)[row] * scale, minlength=buckets) / n + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen) / 10
        gc = float((p - y).mean())
        c_seen += gc * gc
        c -= rate * gc / np.sqrt(c_seen) / 10
    return Model(w, c, tuple(sizes))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, most_rows: int = 5000) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; a rule's verdict stands, the model gives the others.

    ``labelled`` has columns url and label (``allow`` or ``block``).  By default the
    URLs that a rule decides are the labelled table.  Of it, the first ``most_rows``
    distinct URLs by hash are used.  A null or malformed URL has empty host and
    path and no rule; the model judges it by its constant and the empty marks.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict})
    if labelled is None:
        known = rows.where("verdict IS NOT NULL").select("host", "path", "verdict")
    else:
        h, p = host_and_path(F.col("url").cast("string"))
        known = labelled.select(h.alias("host"), p.alias("path"), F.col("label").alias("verdict")).where("verdict IN ('allow', 'block')")
    sample = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).orderBy(F.xxhash64("host", "path"), "host", "path").limit(most_rows).collect()
    model = train([r.host for r in sample], [r.path for r in sample], np.array([r.verdict == "block" for r in sample], bool))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column("host"), b.column("path"))
            given = b.column("verdict").to_pylist()
            judged = [g if g is not None else "block" if x > 0 else "allow" for g, x in zip(given, s.tolist())]
            yield pa.record_batch([*b.columns[:4], pa.array(judged, pa.string()), pa.array(s)], [*b.schema.names, "score"])

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
