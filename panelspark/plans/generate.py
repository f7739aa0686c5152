"""Making candidate expressions: templates, typed search, mutation, filtering and choice.

All of it is work on short texts and lists of some thousands of candidates, so it
runs on the driver; the one aggregation over stored results (``feedback_weights``)
is Spark's.
"""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.registry import REGISTRY

from .language import Call, ExpressionError, Field, Literal, Node, canonical, children, degenerate, fields, parse, portable, structural_hash, text_of

WINDOWS = (5, 10, 22, 66, 132)
#: Names that may tell the future or aren't features: parts of names, and whole names.
LEAKY = re.compile(
    r"future|target|label|next_return|^ret_exec_|_audit_|(^|_)(fwd|forward|next)(_|$)"
    r"|^(date|trade_date|code|znz_code|ticker|symbol|universe|tradable|can_trade|can_buy|can_sell|is_one_price_up_limit|is_one_price_down_limit|is_limit_up_close|is_limit_down_close"
    r"|is_tradeable|is_st|is_suspended|suspended|pct_chg|ret_1d|return_col|y)$",
    re.IGNORECASE,
)
#: Operators that take each other's place without a change of arguments.
SWAPS = [("ts_mean", "ts_median", "ts_decay_linear"), ("ts_max", "ts_min"), ("rank", "zscore", "normalize"), ("ts_corr", "ts_covariance"), ("add", "sub"), ("group_rank", "group_zscore", "group_neutralize")]


def expand(template: str, pools: Mapping[str, Sequence]) -> list[str]:
    """All fillings of ``{name}`` places; none if a pool is missing or empty."""
    names = list(dict.fromkeys(re.findall(r"{(\w+)}", template)))
    if any(not pools.get(n) for n in names):
        return []
    return [template.format(**dict(zip(names, v))) for v in itertools.product(*(pools[n] for n in names))]


def search_space(templates: Iterable[str], pools: Mapping[str, Sequence]) -> list[str]:
    return list(dict.fromkeys(x for t in templates for x in expand(t, pools)))


def result_type(n: Node, kinds: Mapping[str, str]) -> str:
    """The type of an expression (s, g, b, v or l); raises TypeError where an argument doesn't fit."""
    if isinstance(n, Literal):
        return "l"
    if isinstance(n, Field):
        if n.name not in kinds:
            raise TypeError(f"unknown field {n.name}")
        return kinds[n.name]
    op = REGISTRY.get(n.op)
    if op is None:
        raise TypeError(f"unknown operator {n.op}")
    need, _, more = op.inputs.partition("|")
    if not len(need) <= len(n.args) + len(n.named) or len(n.args) > len(need + more):
        raise TypeError(f"{n.op} takes {op.inputs}")
    for want, a in zip(need + more, n.args):
        got = result_type(a, kinds)
        fits = got == want or (want in "wl" and got == "l") or (want == "s" and got in "lb") or (want == "g" and got == "s" and isinstance(a, Call) and REGISTRY[a.op].output == "g")
        if not fits:
            raise TypeError(f"{n.op}: {got} where {want} is wanted")
    return op.output


def random_expression(r: random.Random, kinds: Mapping[str, str], depth: int = 3, want: str = "s") -> Node:
    """A well-typed expression of bounded depth."""
    own = [f for f, k in kinds.items() if k == want]
    ops = [o for o in REGISTRY.values() if o.output == want and o.name.isidentifier() and not o.name.startswith("_") and o.name != "bucket"]
    ops = [o for o in ops if all(c in "wl" or any(k == c for k in kinds.values()) or c == "b" for c in o.inputs.partition("|")[0])]
    if (depth <= 0 or r.random() < 0.2) and own or not ops:
        return Field(r.choice(own))
    if depth <= 0 and want == "b":
        return Call("greater", (Field(r.choice([f for f, k in kinds.items() if k == "s"])), Literal(0)))
    op = r.choice(ops)
    make = {"w": lambda: Literal(r.choice(WINDOWS)), "l": lambda: Literal(r.choice([0.5, 1, 2]))}
    return Call(op.name, tuple(make[c]() if c in make else random_expression(r, kinds, depth - 1, c) for c in op.inputs.partition("|")[0]))


def prepared(name: str, window: int = 120, std: float = 4.0) -> str:
    """A raw field with gaps filled and outliers clipped."""
    return f"winsorize(ts_backfill({name}, {window}), {std})"


def swap_at(n: Node, target: Node, new: Node) -> Node:
    if n is target:
        return new
    if not isinstance(n, Call):
        return n
    return Call(n.op, tuple(swap_at(a, target, new) for a in n.args), tuple((k, swap_at(v, target, new)) for k, v in n.named))


def nodes(n: Node) -> list[Node]:
    return [n, *(x for c in children(n) for x in nodes(c))]


def mutations(n: Node, roles: Mapping[str, Sequence[str]] | None = None) -> list[Node]:
    """Neighbours of an expression: another window, a field of the same role, a similar operator, a wrapper."""
    out = []
    for x in nodes(n):
        if isinstance(x, Literal) and isinstance(x.value, int) and x.value in WINDOWS:
            k = WINDOWS.index(x.value)
            out += [swap_at(n, x, Literal(WINDOWS[j])) for j in (k - 1, k + 1) if 0 <= j < len(WINDOWS)]
        if isinstance(x, Field):
            for names in (roles or {}).values():
                if x.name in names:
                    out += [swap_at(n, x, Field(y)) for y in names if y != x.name]
        if isinstance(x, Call):
            for names in SWAPS:
                if x.op in names:
                    out += [swap_at(n, x, replace(x, op=y)) for y in names if y != x.op]
    out += [Call(w, (n,)) for w in ("rank", "zscore", "reverse") if not (isinstance(n, Call) and n.op == w)]
    return list(dict.fromkeys(out))


def crossover(a: Node, b: Node, r: random.Random, kinds: Mapping[str, str]) -> Node | None:
    """``a`` with one of its sub-trees replaced by one of ``b`` of the same type."""
    places = [x for x in nodes(a) if isinstance(x, Call) and x is not a]
    r.shuffle(places)
    for x in places:
        fits = [y for y in nodes(b) if isinstance(y, Call) and REGISTRY[y.op].output == REGISTRY[x.op].output and y != x]
        if fits:
            out = swap_at(a, x, r.choice(fits))
            try:
                result_type(out, kinds)
            except TypeError:
                continue
            return out
    return None


@dataclass
class Prefilter:
    """Keeps what parses, says something, is new, small enough, safe and well typed; ``rejected`` tells why the others went."""

    kinds: Mapping[str, str]
    seen: set[str] = field(default_factory=set)
    operators: int = 8
    names: int = 3
    rejected: Counter = field(default_factory=Counter)

    def why_not(self, text: str) -> str | None:
        try:
            n = canonical(parse(text))
        except ExpressionError:
            return "parse"
        if degenerate(n):
            return "degenerate"
        if structural_hash(n) in self.seen:
            return "seen"
        if not portable(n, self.operators, self.names):
            return "too large"
        if any(LEAKY.search(f) for f in fields(n)):
            return "leakage"
        if fields(n) - set(self.kinds):
            return "field"
        try:
            if result_type(n, self.kinds) not in "sb":
                return "type"
        except TypeError:
            return "type"
        self.seen.add(structural_hash(n))
        return None

    def keep(self, texts: Iterable[str]) -> list[str]:
        out = []
        for t in texts:
            if reason := self.why_not(t):
                self.rejected[reason] += 1
            else:
                out.append(t)
        return out


def fragments(texts: Iterable[str], least: int = 2) -> list[tuple[str, int]]:
    """Sub-expressions that occur in several expressions, most frequent first."""
    n = Counter(t for x in texts for t in {text_of(y) for y in nodes(canonical(parse(x))) if isinstance(y, Call)})
    return sorted(((t, k) for t, k in n.items() if k >= least), key=lambda x: (-x[1], x[0]))


def rank_candidates(scored: Sequence[tuple[str, float, str]], n: int, explore: float = 0.3, quota: int | None = None, seed: int = 7) -> list[str]:
    """n of (text, score, family): the best by score in turn over the families, within a quota, then some at random."""
    by: dict[str, list] = defaultdict(list)
    for t, _, fam in sorted(scored, key=lambda x: (-x[1], x[0])):
        by[fam].append(t)
    turn = [t for row in itertools.zip_longest(*(v[:quota] for v in by.values())) for t in row if t]
    best = turn[: n - int(n * explore)]
    rest = [t for t in turn if t not in set(best)]
    random.Random(seed).shuffle(rest)
    return best + rest[: n - len(best)]


def feedback_weights(scores: DataFrame, share: float = 0.2, least: int = 2) -> DataFrame:
    """(token, weight): how much more frequent a name is in the best expressions than in all, from (expression, score)."""
    top = scores.agg(F.percentile("score", F.lit(1 - share)).alias("_cut"))
    words = scores.crossJoin(F.broadcast(top)).select((F.col("score") >= F.col("_cut")).alias("best"), F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"([A-Za-z_][A-Za-z_0-9]*)"), 1))).alias("token"))
    one = words.groupBy("token").agg(F.count("*").alias("n"), F.count_if("best").alias("b"))
    total = scores.crossJoin(F.broadcast(top)).agg(F.count("*").alias("_n"), F.count_if(F.col("score") >= F.col("_cut")).alias("_b"))
    return one.where(F.col("n") >= least).crossJoin(F.broadcast(total)).select("token", F.try_divide(F.col("b") * F.col("_n"), F.col("n") * F.col("_b")).alias("weight"))
