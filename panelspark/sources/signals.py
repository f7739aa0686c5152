"""Stores of expressions and metrics, combined signals, target holdings and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.values import finite, nonzero, ratio

from .lake import merged

C = F.col


def register_expressions(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Append expressions whose hash is new, numbered on from the highest number; the first of equal hashes counts.

    ``registry``: id, name, expression, hash; ``new``: seq, expression, hash.
    """
    fresh = new.withColumn("_rn", F.row_number().over(Window.partitionBy("hash").orderBy("seq"))).where("_rn = 1").join(registry.select("hash"), "hash", "left_anti")
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    # A registry holds some thousands of expressions.
    numbered = fresh.crossJoin(F.broadcast(top)).withColumn("id", C("_top") + F.row_number().over(Window.orderBy("seq")))
    return registry.unionByName(numbered.select("id", F.format_string("alpha_%06d", "id").alias("name"), "expression", "hash"))


def pending(registry: DataFrame, done: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Registered and not yet analysed."""
    return registry.join(done.select(*keys), list(keys), "left_anti")


def upsert_metrics(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    return merged(old, new, keys)


def scoreboard(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of z-scores (deviation of the population; 0 where flat) and its dense rank, best first."""
    stats = metrics.agg(*[F.avg(c).alias(f"_m_{c}") for c in weights], *[F.stddev_pop(c).alias(f"_s_{c}") for c in weights])
    rows = metrics.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for c, k in weights.items():
        score = score + k * F.coalesce(F.try_divide(C(c) - C(f"_m_{c}"), nonzero(C(f"_s_{c}"))), F.lit(0.0))
    return rows.withColumn("score", score).withColumn("rank", F.dense_rank().over(Window.orderBy(C("score").desc()))).select(*metrics.columns, "score", "rank")


def cross_zscore(df: DataFrame, ddof: int = 0, *by: str) -> DataFrame:
    """Column ``value`` standardised within a date; population deviation for combined signals, sample deviation for live ones."""
    w = Window.partitionBy("date", *by)
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)("value").over(w)
    return df.withColumn("value", ratio(C("value") - F.avg("value").over(w), nonzero(sd)))


def combine(parts: DataFrame, table: DataFrame, how: str = "sum", ddof: int = 0) -> DataFrame:
    """(date, code, value) from parts (name, date, code, value) and (name, weight, direction).

    Each part is turned, standardised, weighted (weights over the sum of their
    sizes) and added up; ``inner`` wants all parts of a cell.  The sum is
    standardised again.
    """
    total = table.agg(F.sum(F.abs("weight")).alias("_t"), F.count("*").alias("_n"))
    w = table.crossJoin(F.broadcast(total)).select("name", (C("weight") / C("_t")).alias("_w"), "direction", "_n")
    rows = parts.join(F.broadcast(w), "name").withColumn("value", C("value") * C("direction"))
    rows = cross_zscore(rows, ddof, "name")
    one = rows.where(C("value").isNotNull()).groupBy("date", "code").agg(F.sum(C("value") * C("_w")).alias("value"), F.count("*").alias("_have"), F.max("_n").alias("_n"))
    if how == "inner":
        one = one.where("_have = _n")
    return cross_zscore(one.select("date", "code", "value"), ddof)


def parse_combination(text: str, names: Sequence[str], columns: dict[str, Sequence[float]] | None = None) -> list[float]:
    """Weights from ``1`` (equal), a list in brackets, or the name of a column of metadata; they add up to 1 in size."""
    import ast

    text = text.strip()
    if text == "1":
        out = [1.0] * len(names)
    elif text.startswith("["):
        out = [float(x) for x in ast.literal_eval(text)]
    elif columns and text in columns:
        out = [float(x) for x in columns[text]]
    else:
        raise ValueError(f"unknown combination: {text}")
    if len(out) != len(names) or not (size := sum(map(abs, out))):
        raise ValueError("a weight is needed for each part, and one at least not 0")
    return [x / size for x in out]


def target_holdings(day: DataFrame, count: int = 100, least_count: int = 50, least_fill: float = 0.7, most_weight: float = 0.02, cash: float = 0.02, tradable_only: bool = True) -> DataFrame:
    """(code, signal, signal_rank, layer, target_weight, close): the best names of a signal that can be bought, in equal weights.

    ``day``: code, score, close and can_buy, is_st, is_suspended, is_limit_up_close
    (a missing flag counts as 0).  Nothing is held if there are fewer than
    ``least_count`` names or ``least_fill`` of ``count``, or if a name would weigh more
    than ``most_weight``.  Layers are tenths of the ranks.  Ties go by code.
    """
    ok = day.where(C("score").isNotNull())
    if tradable_only:
        flag = lambda c: F.coalesce(C(c).cast("double"), F.lit(0.0)) > 0
        ok = ok.where(flag("can_buy") & ~flag("is_st") & ~flag("is_suspended") & ~flag("is_limit_up_close"))
    best = ok.orderBy(C("score").desc(), "code").limit(count)  # from here on some hundred rows
    best = best.withColumns({"signal_rank": F.row_number().over(Window.orderBy(C("score").desc(), "code")), "_n": F.count("*").over(Window.partitionBy())})
    best = best.withColumn("target_weight", F.lit(1 - cash) / C("_n"))
    best = best.where((C("_n") >= least_count) & (C("_n") / max(1, count) >= least_fill) & (C("target_weight") <= most_weight + 1e-12))
    # Rank r of n lies in the k-th of q parts if (r - 1) / (n - 1) is at most k / q.
    q = F.least(F.lit(10), C("_n"))
    layer = F.greatest(F.lit(1), F.ceil(F.try_divide((C("signal_rank") - 1) * q, nonzero(C("_n") - 1))).cast("int"))
    return best.select("code", C("score").alias("signal"), "signal_rank", F.coalesce(layer, F.lit(1)).alias("layer"), "target_weight", "close")


def rebalance(targets: DataFrame, positions: DataFrame, total: float, cash: float, gross: float = 0.98, cash_buffer: float = 0.02, lot: int = 100, least_value: float = 5000.0, odd_lot_sell: bool = False, keep_unsellable: bool = True) -> DataFrame:
    """(code, side, target_value, current_value, order_shares, order_value, blocked_reason) from targets (code, target_weight, close) and positions (code, shares, available, last_price, can_sell, is_suspended, is_limit_down_close).

    What cannot be sold is taken out of the value to invest; purchases are scaled
    down to the cash there is before any sale, less a buffer; shares are whole lots,
    and orders under ``least_value`` are left.  ``side`` is what was wanted.
    """
    zero = F.lit(0.0)
    both = targets.select("code", "target_weight", "close").join(positions, "code", "full")
    both = both.withColumns({c: F.coalesce(C(c).cast("double"), zero) for c in ("target_weight", "close", "shares", "available", "last_price")})
    both = both.withColumns({"_value": C("shares") * C("last_price"), "_price": F.when(C("close") > 0, C("close")).otherwise(C("last_price"))})
    wants_sale = (C("shares") > 0) & ((C("target_weight") <= 0) | (C("_value") > C("target_weight") * total * gross + 1e-9))
    flag = lambda c: F.coalesce(C(c).cast("double") > 0, F.lit(False))
    why = F.concat_ws(",", F.when(C("available") <= 0, "available_shares"), F.when(F.coalesce(C("can_sell").cast("double") <= 0, F.lit(False)), "can_sell"), F.when(flag("is_suspended"), "is_suspended"), F.when(flag("is_limit_down_close"), "is_limit_down_close"))
    both = both.withColumn("_why", F.when(wants_sale & F.lit(keep_unsellable) & (why != ""), F.concat(F.lit("blocked_sell:"), why)).otherwise(""))
    kept = both.agg(F.greatest(zero, F.lit(total * gross) - F.coalesce(F.sum(F.when(C("_why") != "", C("_value"))), zero)).alias("_invest"))
    both = both.crossJoin(F.broadcast(kept)).withColumn("_want", C("target_weight") * C("_invest")).withColumn("_delta", C("_want") - C("_value"))  # kept is one row
    need = both.agg(F.coalesce(F.sum(F.when(C("_delta") > 0, C("_delta"))), zero).alias("_need"))
    both = both.crossJoin(F.broadcast(need))  # need is one row
    scale = F.when(C("_need") > 0, F.least(F.lit(1.0), F.lit(max(0.0, cash * (1 - cash_buffer))) / nonzero(C("_need")))).otherwise(F.lit(1.0))
    both = both.withColumn("_move", F.when(C("_delta") > 0, C("_delta") * scale).otherwise(C("_delta")))
    lots = lambda n: F.floor(n / lot) * lot
    size = F.floor(F.try_divide(F.abs("_move"), F.when(C("_price") > 0, C("_price"))))
    sale = F.least(size, F.floor("available"))
    shares = F.when(C("_move") > 0, lots(size)).otherwise(sale if odd_lot_sell else lots(sale))
    both = both.withColumn("_shares", F.coalesce(shares, F.lit(0)).cast("long")).withColumn("_order", C("_shares") * C("_price"))
    idle = (C("_price") <= 0) | (C("_move") == 0)
    small = ~idle & (C("_order") < least_value)
    sign = F.signum("_move")
    value = F.when(C("_why") != "", zero).when(idle, C("_move")).when(small, zero).otherwise(C("_order") * sign)
    count = F.when((C("_why") != "") | idle | small, F.lit(0)).otherwise(C("_shares") * sign).cast("long")
    side = F.when(C("_why") != "", "HOLD").when(C("_move") > 0, "BUY").when(C("_move") < 0, "SELL").otherwise("HOLD")
    reason = F.when((C("_why") == "") & small, "small_order_filtered").otherwise(C("_why"))
    return both.select("code", side.alias("side"), C("_want").alias("target_value"), C("_value").alias("current_value"), count.alias("order_shares"), value.alias("order_value"), reason.alias("blocked_reason"))


def compare_sections(a: DataFrame, b: DataFrame, k: int = 50) -> DataFrame:
    """Of two signals of a day (code, value): the pairs both have, their rank correlation, the missing rates, and how much of the top and bottom k of the pairs they share (k at most their number)."""
    both = a.select("code", C("value").alias("x")).join(b.select("code", C("value").alias("y")), "code", "full")
    rates = both.agg(F.coalesce(F.avg(C("x").isNull().cast("double")), F.lit(1.0)).alias("missing_x"), F.coalesce(F.avg(C("y").isNull().cast("double")), F.lit(1.0)).alias("missing_y"))
    # One day's codes, some thousands of rows.
    pairs = both.where(C("x").isNotNull() & C("y").isNotNull())
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    place = lambda c, up: F.row_number().over(Window.orderBy(C(c).asc() if up else C(c).desc(), "code"))
    rows = pairs.withColumns({"_rx": rank("x"), "_ry": rank("y"), "_tx": place("x", False), "_ty": place("y", False), "_bx": place("x", True), "_by": place("y", True), "_k": F.least(F.lit(k), F.count("*").over(Window.partitionBy()))})
    share = lambda p, q: F.try_divide(F.count_if((C(p) <= C("_k")) & (C(q) <= C("_k"))).cast("double"), F.max("_k"))
    one = rows.agg(F.count("*").alias("pairs"), finite(F.try_divide(F.covar_samp("_rx", "_ry"), nonzero(F.stddev_samp("_rx")) * nonzero(F.stddev_samp("_ry")))).alias("spearman"), share("_tx", "_ty").alias("top_overlap"), share("_bx", "_by").alias("bottom_overlap"))
    return one.crossJoin(F.broadcast(rates)).withColumn("missing_delta", F.abs(C("missing_x") - C("missing_y")))  # a row each


def health(ic: DataFrame, months: int = 6, warning: float = 0.5) -> DataFrame:
    """(factor, recent_ic, past_ic, health_score, ic_trend, status, recommendation): the IC of the last months (21 dates each) against that of the dates before.

    With no more dates than that the first one stands for the time before.
    """
    dates = Window.partitionBy("factor")
    rows = ic.where(C("ic").isNotNull()).withColumns({"_rn": F.row_number().over(dates.orderBy(C("date").desc())), "_n": F.count("*").over(dates)})
    lookback = F.least(C("_n"), F.lit(months * 21))
    old = (C("_rn") > lookback) | (C("_rn") == C("_n"))
    one = rows.groupBy("factor").agg(F.avg(F.when(C("_rn") <= lookback, C("ic"))).alias("recent_ic"), F.avg(F.when(old, C("ic"))).alias("past_ic"))
    flat = F.abs("past_ic") < 1e-6
    one = one.withColumn("_r", F.when(flat, F.when(C("recent_ic") > 0, 1.0).otherwise(0.0)).otherwise(C("recent_ic") / nonzero(C("past_ic"))))
    one = one.withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), C("_r") * 100)))
    level = lambda *x: F.when(C("health_score") >= 70, x[0]).when(C("health_score") >= 40, x[1]).otherwise(x[2])
    trend = F.when(C("_r") >= 1, "improving").when(C("_r") >= warning, "stable").otherwise("declining")
    return one.withColumns({"ic_trend": trend, "status": level("healthy", "warning", "critical"), "recommendation": level("keep", "review", "consider_remove")}).drop("_r")


def admit(candidate: DataFrame, peers: DataFrame, most: float = 0.7) -> DataFrame:
    """(name, corr, admitted): absolute rank correlation of a signal with each accepted one (name, date, code, value), on the cells both have."""
    both = peers.join(candidate.select("date", "code", C("value").alias("x")), ["date", "code"]).where(C("x").isNotNull() & C("value").isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy("name").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("name", c)) - 1) / 2
    r = both.withColumns({"_a": rank("x"), "_b": rank("value")})
    one = r.groupBy("name").agg(F.abs(finite(F.try_divide(F.covar_samp("_a", "_b"), nonzero(F.stddev_samp("_a")) * nonzero(F.stddev_samp("_b"))))).alias("corr"))
    return one.withColumn("admitted", F.coalesce(C("corr") <= most, F.lit(True)))


def run_overlap(a: DataFrame, b: DataFrame, n: int, score: str = "score") -> DataFrame:
    """(name, in_a, in_b) of the n best of two runs."""
    top = lambda d, flag: d.orderBy(C(score).desc_nulls_last(), "name").limit(n).select("name", F.lit(True).alias(flag))
    return top(a, "in_a").join(top(b, "in_b"), "name", "full").select("name", F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def page(table: DataFrame, search: str = "", sort: str = "score", descending: bool = True, offset: int = 0, limit: int = 50, effective: bool = False) -> DataFrame:
    """A page of a factor list: a substring of name or expression, any sort column with NULLs last, then the name."""
    if search:
        table = table.where(F.lower("name").contains(search.lower()) | F.lower("expression").contains(search.lower()))
    if effective:
        table = table.where(F.coalesce(C("effective").cast("boolean"), F.lit(False)))
    return table.orderBy(C(sort).desc_nulls_last() if descending else C(sort).asc_nulls_last(), "name").offset(offset).limit(limit)
