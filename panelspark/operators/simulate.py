"""From a raw signal to weights: delay, decay, universe, neutralisation, scaling, capping.

All work on a long frame with the keys date and code and the column ``value``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.values import clip, nonzero

from .registry import CODE, DATE, by_code, over_date

V = F.col


@dataclass(frozen=True)
class Settings:
    delay: int = 1
    decay: int = 0
    universe: str | None = None  # a boolean or 0/1 column
    neutralization: str = "NONE"  # NONE, MARKET, SECTOR, INDUSTRY, SUBINDUSTRY or GROUP:column
    scale: float | None = None
    longscale: float | None = None
    shortscale: float | None = None
    truncation: float | None = None
    truncation_mode: str = "clip"  # clip, capped_rescale, long_short_capped_rescale


def delay(df: DataFrame, n: int) -> DataFrame:
    return df if n <= 0 else df.withColumn("value", F.lag("value", n).over(by_code()))


def decay(df: DataFrame, n: int) -> DataFrame:
    """Exponential average of span n along each code; missing rows repeat the last one."""
    if n <= 1:
        return df
    from .registry import ewm

    alpha, schema = 2.0 / (n + 1), df.schema

    def along(frame):  # noqa: ANN001, ANN202
        frame = frame.sort_values(DATE)
        return frame.assign(value=ewm(frame["value"].to_numpy(dtype=float), alpha))

    return df.groupBy(CODE).applyInPandas(along, schema).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def universe(df: DataFrame, member: str | None) -> DataFrame:
    return df if member is None else df.withColumn("value", F.when(F.coalesce(V(member).cast("boolean"), F.lit(False)), V("value")))


def neutralize(df: DataFrame, kind: str) -> DataFrame:
    kind = (kind or "NONE").strip()
    if kind.upper() == "NONE":
        return df
    if kind.upper() == "MARKET":
        return df.withColumn("value", V("value") - F.avg("value").over(over_date()))
    group = kind[6:] if kind.upper().startswith("GROUP:") else {"SECTOR": "sector", "INDUSTRY": "industry", "SUBINDUSTRY": "subindustry"}.get(kind.upper())
    if group is None or group not in df.columns:
        raise ValueError(f"unknown neutralization: {kind}")
    return df.withColumn("value", F.when(V(group).isNotNull(), V("value") - F.avg("value").over(over_date(V(group)))))


def portfolio_scale(df: DataFrame, scale: float = 1.0, longscale: float | None = None, shortscale: float | None = None) -> DataFrame:
    """Weights of a date: to a sum of absolute values, or each side to its own; a date without any gets zeros."""
    x, w = V("value"), over_date()
    if longscale is None and shortscale is None:
        out = F.coalesce(F.try_divide(x, nonzero(F.sum(F.abs(x)).over(w))) * float(scale), F.lit(0.0))
    else:
        up, down = (max(0.0, float(scale) / 2 if s is None else float(s)) for s in (longscale, shortscale))
        gain, loss = F.sum(F.when(x > 0, x)).over(w), F.sum(F.when(x < 0, -x)).over(w)
        out = F.when(x > 0, F.try_divide(x, gain) * up).when(x < 0, F.try_divide(x, loss) * down).otherwise(F.lit(0.0))
    return df.withColumn("value", F.when(x.isNotNull(), out))


def truncate(df: DataFrame, bound: float | None) -> DataFrame:
    return df if not bound or bound <= 0 else df.withColumn("value", clip(V("value"), F.lit(-float(bound)), F.lit(float(bound))))


def capped(df: DataFrame, cap: float, by: list[Column], weight: Column, target: Column) -> DataFrame:
    """Column ``_capped``: weights shared out to the target with a cap for each, the excess going to the others in proportion.

    Closed form of water-filling: in descending order, the first k get the cap,
    where k is the least for which the next one, scaled to what is left, stays
    under it.  Weights of 0 share equally what positive ones cannot take.
    """
    w = Window.partitionBy(*by)
    # Summed from the least up: a frame that ends at the last row is summed anew for each row, in the square of a date's codes.
    up = w.orderBy(weight.asc(), F.col(CODE).desc())
    tail = F.sum(weight).over(up.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_w": weight, "_n": F.count(weight).over(w), "_k": F.count(F.lit(1)).over(w) - F.row_number().over(up), "_tail": tail})
    df = df.withColumn("_t", F.least(target, V("_n") * cap))
    df = df.withColumn("_rate", F.try_divide(V("_t") - V("_k") * cap, nonzero(V("_tail"))))
    fits = V("_rate").isNotNull() & (V("_rate") * V("_w") <= cap + 1e-12)
    df = df.withColumn("_first", F.min(F.when(fits, F.struct(V("_k"), V("_rate")))).over(w))
    df = df.withColumn("_some", F.sum(F.when(V("_w") > 0, 1).otherwise(0)).over(w))
    rest = F.try_divide(V("_t") - V("_some") * cap, nonzero(V("_n") - V("_some")))
    value = F.when(V("_first").isNull(), F.when(V("_w") > 0, F.lit(cap)).otherwise(F.greatest(rest, F.lit(0.0)))).when(V("_k") < V("_first._k"), F.lit(cap)).otherwise(V("_first._rate") * V("_w"))
    value = F.when(V("_t") > 0, F.least(value, F.lit(cap))).otherwise(F.lit(0.0))
    return df.withColumn("_capped", F.when(V("_w").isNotNull(), value)).drop("_w", "_n", "_k", "_tail", "_t", "_rate", "_first", "_some")


def truncate_capped(df: DataFrame, cap: float | None) -> DataFrame:
    """Cap absolute weights of a date and keep their sum, then give the signs back."""
    if not cap or cap <= 0:
        return df
    x = V("value")
    df = df.withColumn("_sum", F.sum(F.abs(x)).over(over_date()))
    df = capped(df, float(cap), [V(DATE), x.isNull()], F.abs(x), V("_sum"))
    return df.withColumn("value", F.signum(x) * V("_capped")).drop("_sum", "_capped")


def truncate_long_short(df: DataFrame, cap: float | None) -> DataFrame:
    """The same for longs and shorts apart."""
    if not cap or cap <= 0:
        return df
    if cap > 1:
        raise ValueError("the cap of a side must not be above 1")
    side = F.signum("value")
    df = df.withColumn("_sum", F.sum(F.abs("value")).over(over_date(side)))
    df = capped(df, float(cap), [V(DATE), side], F.abs("value"), V("_sum"))
    return df.withColumn("value", F.when(V("value") == 0, F.lit(0.0)).otherwise(side * V("_capped"))).drop("_sum", "_capped")


def portfolio_truncation(df: DataFrame, cap: float | None, mode: str = "clip") -> DataFrame:
    kinds = {"clip": truncate, "capped_rescale": truncate_capped, "long_short_capped_rescale": truncate_long_short}
    if (mode or "clip").strip().lower() not in kinds:
        raise ValueError(f"unknown truncation mode: {mode}")
    return kinds[(mode or "clip").strip().lower()](df, cap)


def simulate(df: DataFrame, s: Settings) -> DataFrame:
    """The whole chain."""
    df = neutralize(universe(decay(delay(df, s.delay), s.decay), s.universe), s.neutralization)
    if s.scale is not None or s.longscale is not None or s.shortscale is not None:
        df = portfolio_truncation(portfolio_scale(df, 1.0 if s.scale is None else s.scale, s.longscale, s.shortscale), s.truncation, s.truncation_mode)
    else:
        df = truncate(df, s.truncation)
    return universe(df, s.universe)
