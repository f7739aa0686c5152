"""Panels and the planner that turns expressions over them into few window passes.

A panel is a long table of (date, code, fields).  The planner evaluates a batch of
expressions together: equal sub-trees once (whatever expression they are in), and
all operators that need the same partitioning and whose inputs are ready in one
``select``.  Spark runs such a select as one exchange and one sort, so a batch costs
as many shuffles as its deepest expression changes between code and date, not as
many as it has operators.
"""

from __future__ import annotations

import inspect
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.values import number
from panelspark.operators.registry import CODE, DATE, get

from .language import Call, Field, Literal, Node, canonical, children, fields, parse, text_of


class Panel:
    """A dense panel: every code has a row on every date.

    Fields are doubles (missing: NULL), groups strings, vectors arrays of doubles.
    """

    def __init__(self, df: DataFrame, groups: Iterable[str] = (), vectors: Iterable[str] = ()):
        self.df, self.groups, self.vectors = df, frozenset(groups), frozenset(vectors)

    @classmethod
    def of(cls, df: DataFrame, date: str = "date", code: str = "code", groups: Iterable[str] = (), order: str | None = None, dense: bool = True) -> Panel:
        """Ingest a long table.

        Of repeated keys the last value that is there counts, in the order of the
        column ``order``; without one, repeats are an error of the caller's, and any
        value may win.  Columns ``name__0, name__1, ...`` become the vector ``name``.
        """
        groups = [g for g in groups if g in df.columns]
        parts: dict[str, list[str]] = {}
        for c in df.columns:
            base, _, tail = c.rpartition("__")
            if base and tail.isdigit():
                parts.setdefault(base, []).append(c)
        # Text columns that aren't declared are groups too.
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in (date, code)]
        groups = list(dict.fromkeys([*groups, *texts]))
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        bundled = {c for v in parts.values() for c in v}
        scalars = [c for c in df.columns if c not in {date, code, order, *groups, *arrays, *bundled}]
        cols = [F.col(date).cast("date").alias(DATE), F.col(code).alias(CODE)]
        cols += [number(F.col(c)).alias(c) for c in scalars] + [F.col(g).cast("string").alias(g) for g in groups]
        cols += [number(F.col(c)).alias(c) for v in parts.values() for c in v]
        cols += [F.transform(F.col(a), number).alias(a) for a in arrays]
        names = [*scalars, *groups, *bundled, *arrays]
        rows = df.select(*cols, *([F.col(order).alias("_order")] if order else [])).where(F.col(DATE).isNotNull() & F.col(CODE).isNotNull())
        if order:
            rows = rows.groupBy(DATE, CODE).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in names])
        bundles = [F.array(*sorted(v, key=lambda c: int(c.rpartition("__")[2]))).alias(k) for k, v in parts.items()]
        rows = rows.select(DATE, CODE, *scalars, *groups, *arrays, *bundles)
        if dense:
            rows = densify(rows)
        return cls(rows, groups, [*parts, *arrays])


def densify(rows: DataFrame) -> DataFrame:
    """Every (date, code) of the dates and codes that occur.

    The two axes are distinct keys of the panel, a few thousand dates at most, so
    the product has as many rows as the dense panel, which is what is asked for.
    """
    dates, codes = rows.select(DATE).distinct(), rows.select(CODE).distinct()
    return codes.crossJoin(F.broadcast(dates)).join(rows, [DATE, CODE], "left")


class Planner:
    def __init__(self, panel: Panel):
        self.panel, self.df = panel, panel.df
        self.done: dict[str, object] = {}  # canonical text -> Column or Python value
        self.names = 0

    def fresh(self) -> str:
        self.names += 1
        return f"_v{self.names}"

    def leaf(self, n: Node) -> object:
        if isinstance(n, Literal):
            return n.value
        if n.name not in self.panel.df.columns:
            raise KeyError(f"unknown field: {n.name}")
        return F.col(f"`{n.name}`")

    def arguments(self, n: Call) -> tuple[list, dict]:
        """Columns where the signature has columns, plain values for windows and literals."""
        op = get(n.op)
        need, _, optional = op.inputs.partition("|")
        given = [self.done[text_of(a)] for a in n.args]
        letters = need + optional
        if not len(need) <= len(given) + len(n.named) or len(given) > len(letters):
            raise TypeError(f"{n.op} takes {op.inputs!r}, got {len(given)} arguments")
        out = []
        for letter, v in zip(letters, given):
            if letter in "sgbv":
                out.append(v if isinstance(v, Column) else F.lit(float(v) if letter == "s" and isinstance(v, (int, float)) and not isinstance(v, bool) else v))
            elif isinstance(v, Column):
                raise TypeError(f"{n.op}: a window or literal is needed, got a column")
            else:
                out.append(v)
        params = list(inspect.signature(op.build).parameters)
        named = {}
        for k, v in n.named:
            if k not in params:
                raise TypeError(f"{n.op} has no argument {k!r}")
            named[k] = self.done[text_of(v)]
        return out, named

    def evaluate(self, roots: Mapping[str, Node]) -> DataFrame:
        """The panel's keys and a column for each named expression."""
        waiting: dict[str, Node] = {}

        def collect(n: Node) -> None:
            key = text_of(n)
            if key in self.done or key in waiting:
                return
            for c in children(n):
                collect(c)
            if isinstance(n, Call):
                get(n.op)
                waiting[key] = n
            else:
                self.done[key] = self.leaf(n)

        needed = set().union(*(fields(n) for n in roots.values())) if roots else set()
        for n in roots.values():
            collect(n)
        self.df = self.df.select(DATE, CODE, *[F.col(f"`{c}`") for c in self.df.columns if c in needed])
        last = ""
        while waiting:
            ready = [n for n in waiting.values() if all(text_of(c) in self.done for c in children(n))]
            rows = [n for n in ready if get(n.op).kind == "row"]
            if rows:
                for n in rows:
                    args, named = self.arguments(n)
                    self.done[text_of(n)] = get(n.op).build(*args, **named)
                    del waiting[text_of(n)]
                continue
            kinds = [get(n.op).kind for n in ready]
            kind = last if last in kinds else max(set(kinds), key=lambda k: (kinds.count(k), k))
            batch = [n for n in ready if get(n.op).kind == kind]
            (self.fold if kind == "fold" else self.windows)(batch)
            for n in batch:
                del waiting[text_of(n)]
            last = kind
        def final(v: object) -> Column:
            return v if isinstance(v, Column) else F.lit(v)

        return self.df.select(DATE, CODE, *[final(self.done[text_of(n)]).alias(name) for name, n in roots.items()])

    def windows(self, batch: list[Call]) -> None:
        """One select for the first columns of all, one for what the generators among them ask next, and so on."""
        running, now = [], {}
        for n in batch:
            args, named = self.arguments(n)
            built = get(n.op).build(*args, **named)
            if inspect.isgenerator(built):
                running.append((n, built, next(built)))
            else:
                now[self.fresh()] = (n, built)
        while now or running:
            asked = {}
            for n, g, column in running:
                asked[self.fresh()] = (n, g, column)
            self.df = self.df.select("*", *[c.alias(k) for k, (_, c) in now.items()], *[c.alias(k) for k, (_, _, c) in asked.items()])
            for k, (n, _) in now.items():
                self.done[text_of(n)] = F.col(k)
            running, now = [], {}
            for k, (n, g, _) in asked.items():
                try:
                    running.append((n, g, g.send(F.col(k))))
                except StopIteration as end:
                    now[self.fresh()] = (n, end.value)

    def fold(self, batch: list[Call]) -> None:
        """All recursions that are ready in one grouped map by code."""
        inputs, work = {}, []
        for n in batch:
            args, named = self.arguments(n)
            f, columns = get(n.op).build(*args, **named)
            ins = []
            for c in columns:
                k = self.fresh()
                inputs[k] = c.cast("double")
                ins.append(k)
            work.append((self.fresh(), f, ins, n))
        df = self.df.select("*", *[c.alias(k) for k, c in inputs.items()])
        keep = self.df.columns
        schema = T.StructType([*self.df.schema.fields, *[T.StructField(k, T.DoubleType()) for k, *_ in work]])
        plain = [(k, f, ins) for k, f, ins, _ in work]

        def along(frame):  # noqa: ANN001, ANN202
            import numpy as np

            frame = frame.sort_values(DATE)
            out = frame[keep].copy()
            for k, f, ins in plain:
                y = np.asarray(f(*[frame[i].to_numpy(dtype=float) for i in ins]), dtype=float)
                out[k] = np.where(np.isfinite(y), y, np.nan)
            return out

        self.df = df.groupBy(CODE).applyInPandas(along, schema)
        # pandas has NaN for missing; the engine has NULL only.
        doubles = [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        self.df = self.df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in doubles})
        for k, _, _, n in work:
            self.done[text_of(n)] = F.col(k)


def evaluate(panel: Panel, expressions: Mapping[str, str] | Iterable[str], rewrite: bool = True) -> DataFrame:
    """date, code and a column for each expression; ``expressions`` maps names to texts, or is a list (alpha_0001, ...)."""
    if not isinstance(expressions, Mapping):
        unique = list(dict.fromkeys(expressions))
        expressions = {f"alpha_{i:04d}": x for i, x in enumerate(unique, 1)}
    trees = {k: parse(x) for k, x in expressions.items()}
    return Planner(panel).evaluate({k: canonical(n) if rewrite else n for k, n in trees.items()})
