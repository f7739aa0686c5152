"""The operators of the expression language as builders of Spark columns.

``kind`` says how an operator's rows are partitioned, which is all the planner
needs: ``row`` (none), ``ts`` (by code), ``cs`` (by date), ``fold`` (a recursion by
code, run in a grouped map).  A builder may be a generator: each column it yields
is materialised and handed back, so operators that need one window on another
share the planner's passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from panelspark.functions.values import clip, finite, inverse_normal, nonzero, ratio

DATE, CODE = "date", "code"


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    inputs: str  # a letter an argument: s scalar, g group, b bool, v vector, w window, l literal; those after '|' are optional
    output: str
    build: Callable
    names: tuple = ()  # of optional arguments


REGISTRY: dict[str, Operator] = {}


def register(names: str, kind: str, inputs: str, output: str = "s", optional: tuple = ()) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names.split():
            REGISTRY[n] = Operator(n, kind, inputs, output, f, optional)
        return f

    return add


def get(name: str) -> Operator:
    if name not in REGISTRY:
        raise KeyError(f"unknown operator: {name}")
    return REGISTRY[name]


def register_pandas(name: str, fn: Callable, inputs: str = "s") -> None:
    """An operator from a function of a pandas Series (one code in date order) to a Series of the same length."""
    REGISTRY[name] = Operator(name, "fold", inputs, "s", lambda *a: (fn, a), ())


def over_date(*more: Column) -> Window:
    return Window.partitionBy(DATE, *more)


def by_code() -> Window:
    return Window.partitionBy(CODE).orderBy(DATE)


def trailing(d: int) -> Window:
    return by_code().rowsBetween(-(max(int(d), 1) - 1), 0)


# Row operators


def row(names: str, inputs: str, output: str = "s", optional: tuple = ()) -> Callable:
    return register(names, "row", inputs, output, optional)


row("add", "ss")(lambda x, y: finite(x + y))
row("sub subtract", "ss")(lambda x, y: finite(x - y))
row("mul multiply", "ss")(lambda x, y: finite(x * y))
row("div divide", "ss")(lambda x, y: ratio(x, F.when(F.abs(y) >= 1e-12, y)))
row("inverse", "s")(lambda x: ratio(F.lit(1.0), F.when(F.abs(x) >= 1e-12, x)))
row("power", "ss")(lambda x, y: F.when(y == 0, F.lit(1.0)).when(x == 1, F.lit(1.0)).otherwise(finite(F.pow(x, y))))
row("signed_power", "ss")(lambda x, y: F.when(x.isNotNull(), finite(F.signum(x) * F.when(y == 0, F.lit(1.0)).otherwise(F.pow(F.abs(x), y)))))
row("max", "ss")(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)))
row("min", "ss")(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)))
row("+", "ss")(lambda x, y: x + y)
row("-", "ss")(lambda x, y: x - y)
row("*", "ss")(lambda x, y: x * y)
row("/", "ss")(ratio)
row("**", "ss")(lambda x, y: F.when(y == 0, F.lit(1.0)).when(x == 1, F.lit(1.0)).otherwise(finite(F.pow(x, y))))
row("%", "ss")(lambda x, y: finite(x - y * F.floor(F.try_divide(x, y))))
row("neg", "s")(lambda x: -x)
row("abs", "s")(F.abs)
row("sign", "s")(F.signum)
row("log", "s")(lambda x: F.when(x > 0, F.log(x)))
row("sqrt", "s")(lambda x: F.when(x >= 0, F.sqrt(x)))
row("s_log_1p", "s")(lambda x: F.signum(x) * F.log1p(F.abs(x)))
row("reverse", "s")(lambda x: -x)
row("zero_like", "s")(lambda x: x * 0.0)
row("truncate", "s|l", optional=("max_percent",))(lambda x, max_percent=0.01: clip(x, F.lit(-abs(float(max_percent))), F.lit(abs(float(max_percent)))))
row("left_tail", "s|l", optional=("maximum",))(lambda x, maximum=0.0: F.when(x <= float(maximum), x))
row("right_tail", "s|l", optional=("minimum",))(lambda x, minimum=0.0: F.when(x >= float(minimum), x))
row("greater", "ss", "b")(lambda x, y: F.coalesce(x > y, F.lit(False)))
row("less", "ss", "b")(lambda x, y: F.coalesce(x < y, F.lit(False)))
row("greater_equal", "ss", "b")(lambda x, y: F.coalesce(x >= y, F.lit(False)))
row("less_equal", "ss", "b")(lambda x, y: F.coalesce(x <= y, F.lit(False)))
row("equal", "ss", "b")(lambda x, y: F.coalesce(x == y, F.lit(False)))
row("not_equal", "ss", "b")(lambda x, y: F.coalesce(x != y, F.lit(True)))
row("is_nan", "s", "b")(lambda x: x.isNull())
row("is_not_nan", "s", "b")(lambda x: x.isNotNull())
row("if_else trade_when", "bss")(lambda c, a, b: F.when(c, a).otherwise(b))
row("event_active", "bs")(lambda e, x: F.when(e, x))
row("group_cartesian_product", "gg", "g")(lambda a, b: F.concat(a.cast("string"), F.lit("__"), b.cast("string")))


@row("bucket", "sl", "g")
def bucket(x: Column, range: str = "0.1,1,0.1") -> Column:  # noqa: A002
    """Right-closed bins of equal steps, numbered from 0, the lowest edge included; NULL outside or for a bad range."""
    import numpy as np

    try:
        start, end, step = (float(v) for v in str(range).split(","))
    except ValueError:
        return F.lit(None).cast("string")
    if step <= 0 or end <= start:
        return F.lit(None).cast("string")
    edges = np.arange(start, end + step, step).tolist()
    out = F.when((x >= edges[0]) & (x <= edges[1]), F.lit("0"))
    for k, (a, b) in enumerate(zip(edges[1:], edges[2:]), 1):
        out = out.when((x > a) & (x <= b), F.lit(str(k)))
    return out


# Vectors: arrays of doubles, missing members skipped


def members(v: Column) -> Column:
    return F.filter(v, lambda x: F.abs(x) < float("inf"))


def total(v: Column) -> Column:
    return F.aggregate(members(v), F.lit(0.0), lambda a, x: a + x)


def some(v: Column, x: Column) -> Column:
    return F.when(F.size(members(v)) > 0, x)


row("vec_sum", "v")(lambda v: some(v, total(v)))
row("vec_avg", "v")(lambda v: some(v, F.try_divide(total(v), F.size(members(v)))))
row("vec_max", "v")(lambda v: F.array_max(members(v)))
row("vec_min", "v")(lambda v: F.array_min(members(v)))
row("vec_count", "v")(lambda v: F.when(v.isNotNull(), F.size(members(v)).cast("double")).otherwise(0.0))


@row("vec_stddev", "v")
def vec_stddev(v: Column) -> Column:
    """Population deviation; a variance below 0 by rounding counts as 0."""
    n = F.size(members(v))
    mean = F.try_divide(total(v), n)
    square = F.try_divide(F.aggregate(members(v), F.lit(0.0), lambda a, x: a + x * x), n)
    return some(v, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))


# Across a date


def cs(names: str, inputs: str, output: str = "s", optional: tuple = ()) -> Callable:
    return register(names, "cs", inputs, output, optional)


def average_rank(x: Column, *by: Column) -> Column:
    """Average rank of x over its count, within a date (and group)."""
    rank = F.rank().over(over_date(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(over_date(*by, x))
    return F.when(x.isNotNull(), F.try_divide(rank + (ties - 1) / 2, F.count(x).over(over_date(*by))))


cs("rank", "s")(average_rank)
cs("normalize", "s")(lambda x: x - F.avg(x).over(over_date()))
cs("zscore", "s")(lambda x: ratio(x - F.avg(x).over(over_date()), nonzero(F.stddev_samp(x).over(over_date()))))


@cs("scale", "s|lll", optional=("scale", "longscale", "shortscale"))
def scale(x: Column, scale=1.0, longscale=None, shortscale=None) -> Column:  # noqa: ANN001
    if longscale is None and shortscale is None:
        return ratio(x, nonzero(F.sum(F.abs(x)).over(over_date()))) * float(scale)
    up, down = (max(0.0, float(scale) / 2 if v is None else float(v)) for v in (longscale, shortscale))
    gain, loss = F.sum(F.when(x > 0, x)).over(over_date()), F.sum(F.when(x < 0, -x)).over(over_date())
    return F.when(x > 0, F.try_divide(x, gain) * up).when(x < 0, F.try_divide(x, loss) * down).otherwise(x * 0.0)


@cs("winsorize", "s|l", optional=("std",))
def winsorize(x: Column, std=4.0) -> Column:  # noqa: ANN001
    mean, sd = F.avg(x).over(over_date()), F.stddev_samp(x).over(over_date())
    return F.when(sd.isNull() | (sd == 0), x).otherwise(clip(x, mean - float(std) * sd, mean + float(std) * sd))


@cs("quantile cs_quantile", "s|ll", optional=("driver", "sigma"))
def quantile(x: Column, driver="gaussian", sigma=1.0) -> Column:  # noqa: ANN001
    kind = str(driver or "gaussian").strip().lower()
    if kind in ("uniform", "u"):
        return average_rank(x)
    if kind not in ("gaussian", "normal", "n"):
        raise ValueError(f"unsupported quantile driver: {driver}")
    return _gaussian(x, max(abs(float(sigma)), 1e-12))


def _gaussian(x: Column, sigma: float):  # noqa: ANN202
    rank = yield average_rank(x)
    return F.when(rank.isNotNull(), inverse_normal(rank) * sigma)


def within(x: Column, g: Column) -> Column:
    """x where it has a group."""
    return F.when(g.isNotNull(), x)


def grouped(names: str, f: Callable) -> None:
    cs(names, "sg")(lambda x, g: F.when(g.isNotNull() & x.isNotNull(), f(within(x, g), over_date(g), g)))


grouped("group_rank", lambda x, w, g: average_rank(x, g))
grouped("group_zscore", lambda x, w, g: ratio(x - F.avg(x).over(w), nonzero(F.stddev_samp(x).over(w))))
grouped("group_mean", lambda x, w, g: F.avg(x).over(w))
grouped("group_sum", lambda x, w, g: F.sum(x).over(w))
grouped("group_median", lambda x, w, g: F.median(x).over(w))
grouped("group_scale", lambda x, w, g: ratio(x, nonzero(F.sum(F.abs(x)).over(w))))
grouped("group_neutralize", lambda x, w, g: x - F.avg(x).over(w))
cs("densify", "g", "g")(lambda g: F.when(g.isNotNull(), F.dense_rank().over(over_date().orderBy(g.cast("string").asc_nulls_last())).cast("string")))


@cs("group_normalize", "sg")
def group_normalize(x: Column, g: Column):  # noqa: ANN201
    centred = yield F.when(g.isNotNull(), x - F.avg(x).over(over_date(g)))
    return ratio(centred, nonzero(F.sum(F.abs(centred)).over(over_date(g))))


@cs("regression_neut", "ss")
def regression_neut(y: Column, x: Column) -> Column:
    """Residual of y on x and a constant, over the date's complete pairs."""
    both = y.isNotNull() & x.isNotNull()
    p, q, w = F.when(both, y), F.when(both, x), over_date()
    slope = F.try_divide(F.covar_samp(p, q).over(w), nonzero(F.var_samp(q).over(w)))
    return F.when(F.count(p).over(w) >= 2, finite(p - F.avg(p).over(w) - slope * (q - F.avg(q).over(w))))


# Along a code


def ts(names: str, inputs: str, optional: tuple = ()) -> Callable:
    return register(names, "ts", inputs, "s", optional)


ts("ts_delay", "sw")(lambda x, d: F.lag(x, int(d)).over(by_code()))
ts("ts_delta", "sw")(lambda x, d: finite(x - F.lag(x, int(d)).over(by_code())))
ts("ts_mean", "sw")(lambda x, d: F.avg(x).over(trailing(d)))
ts("ts_sum", "sw")(lambda x, d: F.sum(x).over(trailing(d)))
ts("ts_min", "sw")(lambda x, d: F.min(x).over(trailing(d)))
ts("ts_max", "sw")(lambda x, d: F.max(x).over(trailing(d)))
ts("ts_median", "sw")(lambda x, d: F.percentile(x, F.lit(0.5)).over(trailing(d)))
ts("ts_std_dev", "sw")(lambda x, d: F.stddev_samp(x).over(trailing(d)))
ts("ts_product", "sw")(lambda x, d: F.when(F.count(x).over(trailing(d)) == F.count(F.lit(1)).over(trailing(d)), finite(F.product(1 + x).over(trailing(d)) - 1)))
ts("ts_av_diff", "sw")(lambda x, d: x - F.avg(x).over(trailing(d)))
ts("ts_zscore", "sw")(lambda x, d: ratio(x - F.avg(x).over(trailing(d)), nonzero(F.stddev_samp(x).over(trailing(d)))))
ts("ts_ir", "sw")(lambda x, d: ratio(F.avg(x).over(trailing(d)), nonzero(F.stddev_samp(x).over(trailing(d)))))
ts("ts_count_nans", "sw")(lambda x, d: F.sum(x.isNull().cast("double")).over(trailing(d)))
ts("ts_backfill", "sw")(lambda x, d: x if int(d) <= 0 else F.last(x, True).over(by_code().rowsBetween(-int(d), 0)))


@ts("ts_rank", "sw")
def ts_rank(x: Column, d: int):  # noqa: ANN201
    held = yield F.collect_list(x).over(trailing(d))
    below, same = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return F.when(x.isNotNull(), F.try_divide(below + (same + 1) / 2, F.size(held)))


def pairs(x: Column, y: Column) -> tuple[Column, Column]:
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


@ts("ts_corr", "ssw")
def ts_corr(x: Column, y: Column, d: int) -> Column:
    (p, q), w = pairs(x, y), trailing(d)
    spread = nonzero(F.stddev_samp(p).over(w)) * nonzero(F.stddev_samp(q).over(w))
    return ratio(F.covar_samp(p, q).over(w), spread)


@ts("ts_covariance", "ssw")
def ts_covariance(x: Column, y: Column, d: int) -> Column:
    p, q = pairs(x, y)
    return finite(F.when(F.count(p).over(trailing(d)) >= 2, F.covar_samp(p, q).over(trailing(d))))


@ts("ts_regression", "ssw|l", optional=("rettype",))
def ts_regression(y: Column, x: Column, d: int, rettype=0) -> Column:  # noqa: ANN001
    """Slope of y on x over the window, or with rettype 2 the residual of the last row."""
    (p, q), w = pairs(y, x), trailing(d)
    slope = F.when(F.count(p).over(w) >= 2, F.try_divide(F.covar_samp(p, q).over(w), nonzero(F.var_samp(q).over(w))))
    return finite(p - F.avg(p).over(w) - slope * (q - F.avg(q).over(w))) if int(rettype) == 2 else finite(slope)


def place() -> Column:
    return F.row_number().over(by_code()).cast("double")


@ts("ts_arg_max", "sw")
def ts_arg_max(x: Column, d: int):  # noqa: ANN201
    at = yield place()
    return at - F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), at.alias("at")))).over(trailing(d))["at"]


@ts("ts_arg_min", "sw")
def ts_arg_min(x: Column, d: int):  # noqa: ANN201
    at = yield place()
    return at + F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), (-at).alias("at")))).over(trailing(d))["at"]


@ts("ts_decay_linear", "sw")
def ts_decay_linear(x: Column, d: int):  # noqa: ANN201
    """Weights d, d - 1, ... by age, over the members that are there."""
    at = yield place()
    w, there = trailing(d), F.when(x.isNotNull(), at)
    age = float(d) - at
    return ratio(age * F.sum(x).over(w) + F.sum(x * at).over(w), age * F.count(x).over(w) + F.sum(there).over(w))


@ts("days_from_last_change", "s")
def days_from_last_change(x: Column):  # noqa: ANN201
    same = F.coalesce(x == F.lag(x).over(by_code()), F.lit(False))
    changed = yield F.when(same, 0).otherwise(1)
    at = yield place()
    return at - F.max(F.when(changed == 1, at)).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


@ts("trade_when_hold", "bsb")
def trade_when_hold(entry: Column, x: Column, exit: Column) -> Column:  # noqa: A002
    """From an entry on, the value at that time; nothing from an exit on.  An exit wins."""
    event = F.when(exit | entry, F.struct((~exit).alias("open"), x.alias("x")))
    state = F.last(event, True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(state["open"], state["x"])


# Recursions along a code: functions of numpy arrays with NaN for missing


def ewm(x, alpha: float):  # noqa: ANN001, ANN201
    """Exponential average that starts at the first value; a gap lets the old weight decay on."""
    import numpy as np

    out, y, weight = np.full(len(x), np.nan), np.nan, 1.0
    for i, v in enumerate(x):
        if y == y:
            weight *= 1 - alpha
            if v == v:
                y = (weight * y + alpha * v) / (weight + alpha)
                weight = 1.0
        elif v == v:
            y, weight = v, 1.0
        out[i] = y
    return out


def held_steps(x, step: float):  # noqa: ANN001, ANN201
    import numpy as np

    out, last = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x):
        if last != last:
            last = v
        elif v == v and abs(v - last) > step:
            last += step if v > last else -step
        out[i] = last
    return out


def fold(names: str, inputs: str, optional: tuple = ()) -> Callable:
    return register(names, "fold", inputs, "s", optional)


def _ewm_then_mean(x, d: int, factor: float):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series(ewm(x, factor)).rolling(d, min_periods=1).mean().to_numpy()


fold("hump", "s|l", ("hump",))(lambda x, hump=0.01: (lambda a, s=max(abs(float(hump)), 0.0): held_steps(a, s), (x,)))
fold("event_decay", "bs|l", ("half_life",))(lambda e, x, half_life=5: (lambda a, k=1 - 2 ** (-1 / max(int(half_life), 1)): ewm(a, k), (F.when(e, x),)))
fold("ts_decay_exp_window", "sw|l", ("factor",))(lambda x, d, factor=0.5: (lambda a, n=int(d), k=min(max(float(factor), 1e-9), 1.0): _ewm_then_mean(a, n, k), (x,)))
fold("_ewm", "sl")(lambda x, alpha: (lambda a, k=float(alpha): ewm(a, k), (x,)))
