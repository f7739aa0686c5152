"""Curation: raw vendor tables to typed ones.

The many tables differ in names, units and keys only, so they are specifications
of one pass: rename, coerce, scale, keep the last row of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.values import nonzero, number, ratio

C = F.col


@dataclass(frozen=True)
class Spec:
    """How a raw table becomes a curated one."""

    keys: Sequence[str]
    dates: Mapping[str, str] = field(default_factory=dict)  # new name: raw name, as YYYYMMDD or a date
    texts: Mapping[str, str] = field(default_factory=dict)
    numbers: Mapping[str, tuple[str, float]] = field(default_factory=dict)  # new name: (raw name, factor)


def day(x: Column) -> Column:
    """A date from YYYYMMDD or YYYY-MM-DD; anything else is NULL."""
    text = F.trim(x.cast("string"))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def code(x: Column) -> Column:
    """Codes in one spelling: upper case, no blanks, exchange suffixes SH, SZ, BJ."""
    text = F.upper(F.regexp_replace(x.cast("string"), r"\s+", ""))
    return F.regexp_replace(F.regexp_replace(text, r"\.XSHG$", ".SH"), r"\.XSHE$", ".SZ")


def has_code(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9]{6}\.(SZ|SH|BJ)$"), F.lit(False))


def curate(raw: DataFrame, spec: Spec, order: str) -> DataFrame:
    """Missing raw columns are typed NULLs; of rows of one key the last by ``order`` is kept; rows without a key are dropped."""
    have = set(raw.columns)
    cols = [(day(C(r)) if r in have else F.lit(None).cast("date")).alias(n) for n, r in spec.dates.items()]
    cols += [(F.trim(C(r).cast("string")) if r in have else F.lit(None).cast("string")).alias(n) for n, r in spec.texts.items()]
    cols += [((number(C(r)) * f) if r in have else F.lit(None).cast("double")).alias(n) for n, (r, f) in spec.numbers.items()]
    rows = raw.select(*cols, C(order).alias("_order")).dropna(subset=list(spec.keys))
    w = Window.partitionBy(*spec.keys).orderBy(C("_order").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_order")


#: Units of the curated tables.  Percent to shares of one, hands and thousands to single units, ten thousands to units.
SPECS = {
    "trade_calendar": Spec(["date", "exchange"], {"date": "cal_date", "previous": "pretrade_date"}, {"exchange": "exchange"}, {"is_open": ("is_open", 1)}),
    "stock_basic": Spec(["code"], {"list_date": "list_date", "delist_date": "delist_date"}, {"code": "ts_code", "name": "name", "industry": "industry", "market": "market", "list_status": "list_status"}),
    "index_daily": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"close": ("close", 1), "open": ("open", 1), "pct_chg": ("pct_chg", 0.01), "volume": ("vol", 100), "amount": ("amount", 1000)}),
    "index_weight": Spec(["date", "index_code", "code"], {"date": "trade_date"}, {"index_code": "index_code", "code": "con_code"}, {"weight": ("weight", 0.01)}),
    "daily_basic": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"turnover_rate": ("turnover_rate", 0.01), "pe": ("pe", 1), "pb": ("pb", 1), "total_mv": ("total_mv", 1e4), "circ_mv": ("circ_mv", 1e4)}),
    "stk_limit": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"up_limit": ("up_limit", 1), "down_limit": ("down_limit", 1)}),
    "suspend": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code", "kind": "suspend_type"}),
    "moneyflow": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"net_amount": ("net_mf_amount", 1e4), "buy_large": ("buy_lg_amount", 1e4), "sell_large": ("sell_lg_amount", 1e4)}),
    "chip_profile": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"winner_rate": ("winner_rate", 1), "weight_avg": ("weight_avg", 1)}),
    "chips": Spec(["date", "code", "price"], {"date": "trade_date"}, {"code": "ts_code"}, {"price": ("price", 1), "percent": ("percent", 1)}),
    "auction_open": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"auction_open_price": ("close", 1), "auction_open_volume": ("vol", 1), "auction_open_amount": ("amount", 1)}),
    "auction_close": Spec(["date", "code"], {"date": "trade_date"}, {"code": "ts_code"}, {"auction_close_price": ("close", 1), "auction_close_volume": ("vol", 1), "auction_close_amount": ("amount", 1)}),
    "theme_index": Spec(["code"], {"list_date": "list_date"}, {"code": "ts_code", "name": "name", "exchange": "exchange", "type": "type"}, {"count": ("count", 1)}),
    "theme_member": Spec(["theme_code", "code"], {}, {"theme_code": "ts_code", "code": "con_code", "name": "con_name"}),
}


def share_of_one(x: Column) -> Column:
    """A rate given in percent or as a share."""
    return F.when(x > 1, x / 100).otherwise(x)


def is_special(name: Column) -> Column:
    """A name with the prefix of special treatment."""
    clean = F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", ""))
    return clean.startswith("ST") | clean.startswith("*ST") | clean.startswith("S*ST")


def announced(df: DataFrame, names: Sequence[str] = ("f_ann_date", "ann_date", "end_date"), out: str = "ann_date") -> DataFrame:
    """The first announce date that is there."""
    return df.withColumn(out, F.coalesce(*[day(C(n)) for n in names if n in df.columns]))


def adjusted(df: DataFrame, prices: Sequence[str] = ("open", "high", "low", "close"), factor: str = "adj_factor") -> DataFrame:
    """Prices adjusted forward (by the code's greatest factor) and backward (by its least), and the return of the backward close.

    The return divides by the last close that was there.
    """
    w, run = Window.partitionBy("code"), Window.partitionBy("code").orderBy("date")
    df = df.withColumns({"_hi": F.max(factor).over(w), "_lo": F.min(factor).over(w)})
    df = df.withColumns({f"forward_{p}": ratio(C(p) * C(factor), nonzero(C("_hi"))) for p in prices} | {f"backward_{p}": ratio(C(p) * C(factor), nonzero(C("_lo"))) for p in prices})
    df = df.withColumn("_last", F.last("backward_close", True).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    filled = F.coalesce("backward_close", "_last")
    return df.withColumn("ret_1d", ratio(filled, nonzero(C("_last"))) - 1).drop("_hi", "_lo", "_last")


def hierarchy(members: DataFrame, tree: DataFrame) -> DataFrame:
    """Members of the lowest level with the codes and names of their three levels, by two look-ups of the parent.

    ``tree``: code, name, parent: a classification of some hundreds of rows.
    """
    t = lambda k: tree.select(C("code").alias(f"l{k}_code"), C("name").alias(f"l{k}_name"), C("parent").alias(f"_p{k}"))
    out = members.join(t(3), C("industry_code") == C("l3_code"), "left")
    out = out.join(t(2), C("_p3") == C("l2_code"), "left")
    return out.join(t(1), C("_p2") == C("l1_code"), "left").drop("_p1", "_p2", "_p3")


def weighted_distribution(df: DataFrame, by: Sequence[str], value: str, weight: str, shares: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Count, range, mode, weighted mean and deviation, weighted quantiles of each group."""
    w = Window.partitionBy(*by)
    rows = df.where(C(value).isNotNull() & (C(weight) > 0)).withColumn("_cdf", F.try_divide(F.sum(weight).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum(weight).over(w)))
    one = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, F.struct(C(weight), -C(value))).alias("mode"),
        F.try_divide(F.sum(C(value) * C(weight)), F.sum(weight)).alias("mean"), F.try_divide(F.sum(C(value) * C(value) * C(weight)), F.sum(weight)).alias("_sq"),
        *[F.min(F.when(C("_cdf") >= p - 1e-12, C(value))).alias(f"q{int(p * 100)}") for p in shares],
    )
    return one.withColumn("std", F.sqrt(F.greatest(C("_sq") - C("mean") * C("mean"), F.lit(0.0)))).drop("_sq")


#: What a rating's text contains, tried in this order, and its grade.
GRADES = [(5.0, ("买", "buy", "涔")), (4.0, ("增", "outperform", "澧")), (3.0, ("持有", "hold", "中性")), (2.0, ("减", "underperform")), (1.0, ("卖", "sell"))]


def grade(text: Column) -> Column:
    """The grade of the first token found in a rating, in any case; NULL if none is."""
    clean, out = F.lower(F.trim(text)), None
    for g, tokens in GRADES:
        hit = F.lit(False)
        for t in tokens:
            hit = hit | clean.contains(t)
        out = F.when(hit, F.lit(g)) if out is None else out.when(hit, F.lit(g))
    return out


def consensus(reports: DataFrame, day_col: str = "date") -> DataFrame:
    """Reports of a day and code: how many, from how many organisations and authors, mean, median, least and greatest grade and forecast."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return reports.groupBy(day_col, "code").agg(
        F.count("*").alias("reports"), F.count_distinct(some(C("org"))).alias("orgs"), F.count_distinct(some(C("author"))).alias("authors"),
        F.avg("grade").alias("grade_mean"), F.median("grade").alias("grade_median"), F.min("eps").alias("eps_min"), F.max("eps").alias("eps_max"), F.avg("eps").alias("eps_mean"),
    )
