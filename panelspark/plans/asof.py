"""As-of joins and the relational views built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: Sequence[Column] = (), strict: bool = False) -> DataFrame:
    """For each left row, the values of the latest right row at or before its time (before it, if strict).

    Both sides are put in one table, sorted by time within a key, and the last
    right row is carried forward: one shuffle, n log n, whatever the number of
    matches.  Right rows of one key and time are reduced to the first by ``tie``.
    A key may be as large as it likes for the sort, which spills.
    """
    if tie:
        right = right.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, right_time).orderBy(*tie))).where("_rn = 1")
    keys = [F.col(k) for k in by]
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_time"), F.lit(1 if strict else 0).alias("_side"), F.struct(*[F.col(v).alias(v) for v in values]).alias("_found"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_row"))
    found = r.schema["_found"].dataType
    m = left.select(*keys, F.col(left_time).alias("_time"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(found).alias("_found"), F.struct("*").alias("_row"))
    run = Window.partitionBy(*by).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(m).withColumn("_last", F.last("_found", True).over(run)).where(F.col("_row").isNotNull())
    null_key = F.lit(False)
    for k in by:
        null_key = null_key | F.col(k).isNull()
    return both.select("_row.*", *[F.when(~null_key, F.col(f"_last.{v}")).alias(v) for v in values])


def interval(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, start: str, end: str, values: Sequence[str], order: Sequence[Column], overlap: bool = True) -> DataFrame:
    """For each left row, the first by ``order`` of the right intervals [start, end] that hold its time (open end: NULL).

    Intervals that don't overlap take the backward join and a check of their end;
    overlapping ones an equi-join on the key, a range filter and a row number.
    """
    if not overlap:
        out = backward(left, right.select(*by, start, F.col(end).alias("_end"), *values), by, time, start, [*values, "_end"])
        ok = F.col("_end").isNull() | (F.col(time) <= F.col("_end"))
        return out.select(*left.columns, *[F.when(ok, F.col(v)).alias(v) for v in values])
    tagged = left.withColumn("_id", F.monotonically_increasing_id())
    hit = tagged.select("_id", *by, F.col(time).alias("_t")).join(right, list(by)).where((F.col(start) <= F.col("_t")) & (F.col(end).isNull() | (F.col("_t") <= F.col(end))))
    best = hit.withColumn("_rn", F.row_number().over(Window.partitionBy("_id").orderBy(*order))).where("_rn = 1").select("_id", *values)
    return tagged.join(best, "_id", "left").drop("_id")


def day_numbers(days: DataFrame, day: str) -> DataFrame:
    """Distinct days with their number from 1 (a calendar: some thousands of rows)."""
    return days.select(day).where(F.col(day).isNotNull()).distinct().withColumn("day_no", F.row_number().over(Window.orderBy(day)))


def days_between(df: DataFrame, calendar: DataFrame, day: str, from_: str, to: str, name: str) -> DataFrame:
    """Trading days from one date to another, both looked up in a calendar of numbered days."""
    a = calendar.select(F.col(day).alias(from_), F.col("day_no").alias("_from"))
    b = calendar.select(F.col(day).alias(to), F.col("day_no").alias("_to"))
    return df.join(F.broadcast(a), from_, "left").join(F.broadcast(b), to, "left").withColumn(name, F.col("_to") - F.col("_from")).drop("_from", "_to")


def near(a: Column, b: Column, share: float = 1e-4, least: float = 1e-4) -> Column:
    """Equal prices, but for rounding; false if either is missing."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.abs(b) * share, F.lit(least)), F.lit(False))


def tradability(df: DataFrame, require_close: bool = True, require_volume: bool = True, require_amount: bool = True) -> DataFrame:
    """Flags of a day from open, high, low, close, volume, amount, up_limit, down_limit and is_suspended.

    A day is tradable if it isn't suspended and has what is required; it can be
    bought unless the whole day stood at the upper limit, and sold unless it stood at the lower.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    live = ~yes(c("is_suspended").cast("boolean"))
    for wanted, ok in ((require_close, c("close").isNotNull()), (require_volume, yes(c("volume") > 0)), (require_amount, yes(c("amount") > 0))):
        live = live & ok if wanted else live
    at = lambda limit: near(c("close"), c(limit))
    one_price = lambda limit: at(limit) & near(c("open"), c(limit)) & near(c("high"), c(limit)) & near(c("low"), c(limit))
    up, down = one_price("up_limit"), one_price("down_limit")
    return df.withColumns({"is_limit_up_close": at("up_limit"), "is_limit_down_close": at("down_limit"), "is_one_price_up_limit": up, "is_one_price_down_limit": down, "tradable": live, "can_buy": live & ~up, "can_sell": live & ~down})


def members(df: DataFrame, membership: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in a universe."""
    return df.join(membership.select(*keys), list(keys), "left_semi")


def membership_asof(days: DataFrame, membership: DataFrame, day: str, asof: str, code: str) -> DataFrame:
    """(day, code) of the latest membership list at or before each day."""
    lists = membership.select(asof).distinct()
    used = backward(days.select(day).distinct().withColumn("_one", F.lit(1)), lists.withColumn("_one", F.lit(1)).withColumn("_list", F.col(asof)), ["_one"], day, asof, ["_list"])
    return used.where(F.col("_list").isNotNull()).join(membership, F.col("_list") == F.col(asof)).select(day, code)
