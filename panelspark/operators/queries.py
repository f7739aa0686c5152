"""Simulation, relational and research operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.values import nonzero, ratio
from panelspark.plans import asof

from panelspark.plans.queries import NUDGE, ewm_sql, panel_sql, rank_sql, read, supplier_panel, supplier_rows
from panelspark.sources import lake

from . import research as R
from . import simulate as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name; its doubles are rounded, and its SQL's must be named alike."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c) + NUDGE, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return add


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# Simulation


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, code, value = disc - 0.05, nation, region and a universe flag, dense."""
    p = supplier_panel(spark, sf_dir)
    return p.df.select("date", "code", (C("disc") - 0.05).alias("value"), C("region").alias("sector"), C("nation").alias("industry"), F.coalesce(C("volume") > 60, F.lit(False)).alias("member"))


SIG = panel_sql() + ", s AS (SELECT date, code, disc - 0.05 AS value, region AS sector, nation AS industry, coalesce(volume > 60, false) AS member FROM p)"


def simple(name: str, f: Callable, value: str, extra: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(signal(spark, sf_dir)).select("date", "code", "value")

    run.__name__ = name
    query(f"{SIG} {extra} SELECT date, code, {r6(value)} AS value FROM {'x' if extra else 's'}")(run)


simple("sim_delay", lambda d: S.delay(d, 2), "lag(value, 2) OVER (PARTITION BY code ORDER BY date)")
simple("sim_decay", lambda d: S.decay(d, 4), "v", f", x AS (SELECT date, code, {ewm_sql('value', '0.4')} AS v FROM s WINDOW a AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
simple("sim_universe", lambda d: S.universe(d, "member"), "CASE WHEN member THEN value END")
simple("sim_neutralize_market", lambda d: S.neutralize(d, "MARKET"), "value - avg(value) OVER (PARTITION BY date)")
simple("sim_neutralize_sector", lambda d: S.neutralize(d, "SECTOR"), "CASE WHEN sector IS NOT NULL THEN value - avg(value) OVER (PARTITION BY date, sector) END")
simple("sim_neutralize_group", lambda d: S.neutralize(d, "GROUP:industry"), "CASE WHEN industry IS NOT NULL THEN value - avg(value) OVER (PARTITION BY date, industry) END")
simple("sim_scale", lambda d: S.portfolio_scale(d, 2.0), "CASE WHEN value IS NOT NULL THEN coalesce(value / nullif(sum(abs(value)) OVER (PARTITION BY date), 0) * 2, 0) END")
simple("sim_scale_long_short", lambda d: S.portfolio_scale(d, 1.0, 0.6, 0.4), "CASE WHEN value > 0 THEN value / sum(CASE WHEN value > 0 THEN value END) OVER (PARTITION BY date) * 0.6 WHEN value < 0 THEN value / sum(CASE WHEN value < 0 THEN -value END) OVER (PARTITION BY date) * 0.4 WHEN value = 0 THEN 0 END")
simple("sim_truncate", lambda d: S.truncate(d, 0.01), "CASE WHEN value IS NOT NULL THEN least(greatest(value, -0.01), 0.01) END")

WATER = """, sized AS (SELECT date, code, {w} AS w, {x} AS x, {by} AS side FROM s WHERE value IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date, side ORDER BY w DESC, code) - 1 AS k, count(*) OVER (PARTITION BY date, side) AS n,
  sum(w) OVER (PARTITION BY date, side) AS total, sum(w) OVER (PARTITION BY date, side ORDER BY w DESC, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM sized),
rated AS (SELECT *, least(total, n * {cap}) AS t, (least(total, n * {cap}) - k * {cap}) / nullif(tail, 0) AS rate FROM ranked),
fit AS (SELECT date, side, min(k) AS k0, arg_min(rate, k) AS rate0 FROM rated WHERE rate * w <= {cap} + 1e-12 GROUP BY ALL),
x AS (SELECT r.date, r.code, sign(r.x) * CASE WHEN t <= 0 OR r.x = 0 THEN 0 WHEN k0 IS NULL THEN {cap} WHEN k < k0 THEN {cap} ELSE rate0 * w END AS v FROM rated r LEFT JOIN fit USING (date, side)
  UNION ALL SELECT date, code, NULL FROM s WHERE value IS NULL)"""
simple("sim_truncate_capped", lambda d: S.truncate_capped(d, 0.03), "v", WATER.format(w="abs(value)", x="value", by="0", cap=0.03))
simple("sim_truncate_long_short", lambda d: S.truncate_long_short(d, 0.03), "v", WATER.format(w="abs(value)", x="value", by="sign(value)", cap=0.03))


@query()
def sim_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: a property test holds its sums and caps."""
    return S.simulate(signal(spark, sf_dir), S.Settings(delay=1, decay=3, universe="member", neutralization="SECTOR", scale=1.0, truncation=0.1, truncation_mode="capped_rescale")).select("date", "code", "value")


# Relational layer


@query("""WITH f AS (SELECT user_id, ts AS fts, max(value) AS fv FROM events GROUP BY ALL)
SELECT e.event_id, e.user_id, round(f.fv, 6) + 0.0 AS last_value FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts > f.fts""")
def rel_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event, the value of the user's latest event before it."""
    ev = read(spark, sf_dir, "events")
    out = asof.backward(ev.select("event_id", "user_id", "ts"), ev.withColumn("last_value", C("value")), ["user_id"], "ts", "ts", ["last_value"], [C("value").desc_nulls_last()], strict=True)
    return out.select("event_id", "user_id", "last_value")


INTERVALS = "WITH iv AS (SELECT o_custkey, o_orderdate AS s, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - INTERVAL 1 DAY AS e, o_orderkey AS k FROM orders)"


def intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    iv = o.select("o_custkey", C("o_orderdate").alias("s"), (F.lead("o_orderdate").over(w) - F.expr("INTERVAL 1 DAY")).alias("e"), C("o_orderkey").alias("k"))
    left = o.select("o_orderkey", "o_custkey", (C("o_orderdate") + F.expr("INTERVAL 40 DAY")).alias("t"))
    return left, iv


@query(INTERVALS + ", h AS (SELECT o_orderkey, k, row_number() OVER (PARTITION BY o_orderkey ORDER BY s DESC, k DESC) AS rn FROM (SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 40 DAY AS t FROM orders) l JOIN iv USING (o_custkey) WHERE s <= t AND (e IS NULL OR t <= e)) SELECT o.o_orderkey, h.k FROM orders o LEFT JOIN h ON h.o_orderkey = o.o_orderkey AND rn = 1")
def rel_asof_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order interval of a customer that is open 40 days after each order."""
    left, iv = intervals(spark, sf_dir)
    return asof.interval(left, iv, ["o_custkey"], "t", "s", "e", ["k"], [C("s").desc(), C("k").desc()]).select("o_orderkey", "k")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY 1")
def rel_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.latest(read(spark, sf_dir, "orders"), ["o_custkey"], [C("o_orderdate").desc_nulls_last(), C("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("WITH c AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) SELECT o_orderkey, CAST(b.n - a.n AS BIGINT) AS days FROM orders JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1) USING (o_custkey) JOIN c a ON a.d = f JOIN c b ON b.d = CAST(o_orderdate AS DATE)")
def rel_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days between a customer's first order and each order."""
    o = read(spark, sf_dir, "orders").withColumn("d", C("o_orderdate").cast("date"))
    first = o.groupBy("o_custkey").agg(F.min("d").alias("f"))
    return asof.days_between(o.join(first, "o_custkey"), asof.day_numbers(o, "d"), "d", "f", "d", "days").select("o_orderkey", C("days").cast("long").alias("days"))


LIVE = "close IS NOT NULL AND NOT coalesce(disc > 0.06, false) AND coalesce(volume, 0) > 0 AND coalesce(am, 0) > 0"


def at_sql(x: str, limit: str) -> str:
    return f"coalesce(abs({x} - {limit}) <= greatest(abs({limit}) * 1e-4, 1e-4), false)"


def one_price_sql(limit: str) -> str:
    return " AND ".join(at_sql(x, limit) for x in ("close", "close", "hi", "close"))


@query(panel_sql() + f""", x AS (SELECT date, code, close, disc, volume, CASE WHEN code % 7 = 0 THEN 0 ELSE amount END AS am, CASE WHEN code % 3 = 0 THEN close ELSE close * 1.01 END AS hi, CASE WHEN code % 2 = 0 THEN close ELSE close * 1.1 END AS up, CASE WHEN code % 5 = 0 THEN close ELSE close * 0.9 END AS dn FROM p)
SELECT date, code, {at_sql('close', 'up')} AS is_limit_up_close, {at_sql('close', 'dn')} AS is_limit_down_close, {one_price_sql('up')} AS is_one_price_up_limit, {one_price_sql('dn')} AS is_one_price_down_limit, {LIVE} AS tradable, {LIVE} AND NOT ({one_price_sql('up')}) AS can_buy, {LIVE} AND NOT ({one_price_sql('dn')}) AS can_sell FROM x""")
def rel_tradability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at a limit at the close, whole days at it, days without trade."""
    d, c = supplier_panel(spark, sf_dir).df, C("close")
    every = lambda n, a, b: F.when(C("code") % n == 0, a).otherwise(b)
    d = d.withColumns({"up_limit": every(2, c, c * 1.1), "down_limit": every(5, c, c * 0.9), "is_suspended": C("disc") > 0.06, "open": c, "high": every(3, c, c * 1.01), "low": c, "amount": every(7, F.lit(0.0), C("amount"))})
    return asof.tradability(d).select("date", "code", "is_limit_up_close", "is_limit_down_close", "is_one_price_up_limit", "is_one_price_down_limit", "tradable", "can_buy", "can_sell")


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem SEMI JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) m ON l_suppkey = s_suppkey")
def rel_universe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "supplier").where("s_nationkey < 5").select(C("s_suppkey").alias("l_suppkey"))
    return asof.members(read(spark, sf_dir, "lineitem"), m, ["l_suppkey"]).agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s"))


@query("WITH m AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS q, o_custkey FROM orders WHERE o_totalprice > 300000), d AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders), u AS (SELECT d, max(q) AS q FROM d JOIN (SELECT DISTINCT q FROM m) ON q <= d GROUP BY d) SELECT CAST(d AS DATE) AS d, o_custkey FROM u JOIN m USING (q)")
def rel_membership_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on the latest quarterly list at or before each month."""
    o = read(spark, sf_dir, "orders")
    m = o.where("o_totalprice > 300000").select(F.date_trunc("quarter", "o_orderdate").alias("q"), "o_custkey").distinct()
    d = o.select(F.date_trunc("month", "o_orderdate").alias("d")).distinct()
    return asof.membership_asof(d, m, "d", "q", "o_custkey").select(C("d").cast("date").alias("d"), "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 5 = 0")
def rel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth order with a new price over the old table, the new row winning."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return lake.merged(o, o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.round(C("o_totalprice") * 2, 2)), ["o_orderkey"])


@query(panel_sql() + " SELECT f AS field, CAST(count(*) AS BIGINT) AS rows, CAST(count(v) AS BIGINT) AS present, CAST(count(v) AS BIGINT) AS finite, round(count(v) / CAST(count(*) AS DOUBLE), 6) AS rate, CASE WHEN count(v) >= 0.9 * count(*) THEN 'pass' WHEN count(v) >= 0.5 * count(*) THEN 'warn' ELSE 'fail' END AS status, CAST(count(DISTINCT date) AS BIGINT) AS dates, CAST(count(DISTINCT code) AS BIGINT) AS codes FROM (SELECT date, code, 'close' AS f, close AS v FROM p UNION ALL SELECT date, code, 'disc', disc FROM p UNION ALL SELECT date, code, 'parts1', v1 FROM p) GROUP BY f")
def rel_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = supplier_panel(spark, sf_dir).df.withColumn("parts1", C("parts")[1])
    return lake.quality(d, ["close", "disc", "parts1"], "date", "code")


@query("SELECT 'o_totalprice' AS field, CAST(max(o_orderdate) AS DATE) AS latest FROM orders UNION ALL SELECT 'big', CAST(max(CASE WHEN o_totalprice > 400000 THEN o_orderdate END) AS DATE) FROM orders")
def rel_last_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumns({"big": F.when(C("o_totalprice") > 400000, 1), "d": C("o_orderdate").cast("date")})
    return lake.last_present(o, ["o_totalprice", "big"], "d")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders LEFT JOIN (SELECT c_custkey FROM customer) ON c_custkey = o_custkey WHERE (o_orderpriority LIKE '1%' OR o_orderstatus IN ('F')) AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND c_custkey IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def rel_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a filtered, sorted list: the top-k is the feature."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey")
    hit = o.where((C("o_orderpriority").like("1%") | C("o_orderstatus").isin("F")) & C("o_orderdate").between("1996-01-01", "1997-06-30"))
    return hit.join(c, C("c_custkey") == C("o_custkey"), "left").where("c_custkey IS NOT NULL").orderBy(C("o_totalprice").desc(), "o_orderkey").offset(10).limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


# Research


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, code, close, pct, circ_mv and two factors, where there were shipments."""
    d = supplier_rows(spark, sf_dir)
    return d.select("date", "code", "close", ratio(C("close"), nonzero(F.lag("close").over(R.along()))).alias("_g"), C("amount").alias("circ_mv"), C("disc").alias("factor_a"), C("volume").alias("factor_b")).withColumn("pct", C("_g") - 1).drop("_g")


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpivot(R.future_return(base(spark, sf_dir), "pct"), ["factor_a", "factor_b"], "pct_1d")


BASE = panel_sql().split("p AS (")[0] + """b AS (SELECT date, code, close, amount AS circ_mv, disc AS factor_a, volume AS factor_b, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS pct FROM named),
br AS (SELECT *, lead(pct) OVER (PARTITION BY code ORDER BY date) AS ret FROM b),
l AS (SELECT date, code, 'factor_a' AS factor, factor_a AS value, ret FROM br UNION ALL SELECT date, code, 'factor_b', factor_b, ret FROM br)"""
IC = BASE + f""", rk AS (SELECT *, {rank_sql('value', 'factor, date')} AS rv, {rank_sql('ret', 'factor, date')} AS rr FROM l),
pr AS (SELECT factor, date, CASE WHEN rr IS NOT NULL THEN rv END AS a, CASE WHEN rv IS NOT NULL THEN rr END AS c, count(value) OVER (PARTITION BY factor, date) AS x FROM rk),
ic AS (SELECT factor, date, covar_samp(a, c) / (nullif(stddev_samp(a), 0) * nullif(stddev_samp(c), 0)) AS ic FROM pr GROUP BY ALL)"""


@query(BASE + f" SELECT date, code, {r6('ret')} AS pct_1d, {r6('r3')} AS pct_3d FROM (SELECT *, CASE WHEN count(pct) OVER w = 3 THEN product(1 + pct) OVER w - 1 END AS r3 FROM br WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))")
def res_future_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.future_return(R.future_return(base(spark, sf_dir), "pct", 1), "pct", 3).select("date", "code", "pct_1d", "pct_3d")


@query(BASE + f" SELECT date, code, {r6('x')} AS execution_2d FROM (SELECT *, lead(close, 3) OVER o / nullif(lead(close, 1) OVER o, 0) - 1 AS x FROM b WINDOW o AS (PARTITION BY code ORDER BY date))")
def res_execution_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.execution_return(base(spark, sf_dir), "close", 2).select("date", "code", "execution_2d")


@query(BASE + f""", c AS (SELECT *, quantile_cont(factor_b, 0.5) OVER (PARTITION BY date) AS m FROM b), d AS (SELECT *, quantile_cont(abs(factor_b - m), 0.5) OVER (PARTITION BY date) AS dv FROM c),
e AS (SELECT *, CASE WHEN factor_b IS NOT NULL THEN least(greatest(factor_b, m - 5 * dv), m + 5 * dv) END AS x FROM d), f AS (SELECT *, CASE WHEN circ_mv > 0 AND x IS NOT NULL THEN ln(circ_mv) END AS s FROM e), h AS (SELECT *, CASE WHEN s IS NOT NULL THEN x END AS y FROM f),
n AS (SELECT date, code, CASE WHEN count(y) OVER d = 1 THEN y ELSE y - avg(y) OVER d - coalesce(covar_samp(y, s) OVER d / nullif(var_samp(s) OVER d, 0), 0) * (s - avg(s) OVER d) END AS nz FROM h WINDOW d AS (PARTITION BY date))
SELECT date, code, {r6('nz')} AS neutralized, {r6("CASE WHEN sd = 0 THEN nz * 0 ELSE (nz - mu) / sd END")} AS standardized FROM (SELECT *, avg(nz) OVER d AS mu, stddev_samp(nz) OVER d AS sd FROM n WINDOW d AS (PARTITION BY date))""")
def res_process_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.process_factor(base(spark, sf_dir), "factor_b")
    return d.select("date", "code", C("factor_b_neutralized").alias("neutralized"), C("factor_b_standardized").alias("standardized"))


@query(BASE + " SELECT date, code FROM b WHERE date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM b)) WHERE k % 5 = 0 AND k < n - 5)")
def res_sampled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sampled_dates(base(spark, sf_dir), 5).select("date", "code")


LAYER = """, v AS (SELECT * FROM l WHERE value IS NOT NULL AND ret IS NOT NULL), qd AS (SELECT factor, date, quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e, count(*) AS n, min(value) AS lo, max(value) AS hi FROM v GROUP BY ALL),
la AS (SELECT v.*, CAST(CASE WHEN n = 1 THEN 3 WHEN n < 5 THEN greatest(1, ceil((row_number() OVER (PARTITION BY v.factor, v.date ORDER BY code) - 1) * 5 / CAST(n - 1 AS DOUBLE)))
 WHEN len(list_distinct(e)) = 6 THEN CASE WHEN value <= e[2] THEN 1 WHEN value <= e[3] THEN 2 WHEN value <= e[4] THEN 3 WHEN value <= e[5] THEN 4 ELSE 5 END
 WHEN lo = hi THEN 3 ELSE greatest(1, least(5, ceil((value - lo) / ((hi - lo) / 5)))) END AS INTEGER) AS layer FROM v JOIN qd USING (factor, date))"""


@query(BASE + LAYER + " SELECT factor, date, code, layer FROM la")
def res_quantile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.layers(long(spark, sf_dir), 5).select("factor", "date", "code", C("layer").cast("int").alias("layer"))


@query(BASE + f"{LAYER} SELECT factor, date, layer, {r6('avg(ret)')} AS ret FROM la GROUP BY ALL")
def res_layer_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.layer_returns(R.layers(long(spark, sf_dir), 5)).withColumn("layer", C("layer").cast("int"))


@query(IC + f" SELECT factor, date, {r6('ic')} AS ic FROM ic")
def res_daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_ic(long(spark, sf_dir))


NW = """, dd AS (SELECT factor, date, ic, ic - avg(ic) OVER (PARTITION BY factor) AS d FROM ic WHERE ic IS NOT NULL),
lg AS (SELECT factor, d, lag(d, 1) OVER o * d AS g1, lag(d, 2) OVER o * d AS g2, lag(d, 3) OVER o * d AS g3, lag(d, 4) OVER o * d AS g4, lag(d, 5) OVER o * d AS g5, ic FROM dd WINDOW o AS (PARTITION BY factor ORDER BY date)),
nw AS (SELECT factor, avg(ic) / (sqrt(sum(d * d) + 2 * (5/6.0 * sum(g1) + 4/6.0 * sum(g2) + 3/6.0 * sum(g3) + 2/6.0 * sum(g4) + 1/6.0 * sum(g5))) / count(*)) AS t FROM lg GROUP BY factor)"""


@query(IC + NW + f" SELECT factor, {r6('avg(ic)')} AS ic_mean, {r6('stddev_samp(ic)')} AS ic_std, {r6('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0 END)')} AS ic_positive, count(ic) AS ic_count, {r6('coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0)')} AS ir, {r6('max(t)')} AS nw_t FROM ic JOIN nw USING (factor) GROUP BY factor")
def res_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ic_summary(R.daily_ic(long(spark, sf_dir)))


DECAY = BASE + ", sh AS (" + " UNION ALL ".join(f"SELECT factor, {k} AS lag, date, value, {'ret' if k == 0 else f'lead(ret, {k}) OVER (PARTITION BY factor, code ORDER BY date)'} AS ret FROM l" for k in range(4)) + f"), rk AS (SELECT *, {rank_sql('value', 'factor, lag, date')} AS rv, {rank_sql('ret', 'factor, lag, date')} AS rr FROM sh), ic AS (SELECT factor, lag, date, covar_samp(a, c) / (nullif(stddev_samp(a), 0) * nullif(stddev_samp(c), 0)) AS ic FROM (SELECT factor, lag, date, CASE WHEN rr IS NOT NULL THEN rv END AS a, CASE WHEN rv IS NOT NULL THEN rr END AS c FROM rk) GROUP BY ALL)"


@query(DECAY + f" SELECT factor, CAST(lag AS INTEGER) AS lag, {r6('avg(ic)')} AS ic_mean, {r6('stddev_samp(ic)')} AS ic_std, {r6('coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0)')} AS ir FROM ic GROUP BY factor, lag")
def res_ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ic_decay(long(spark, sf_dir), 3)


@query(IC + f" SELECT factor, count(ic) AS n, {r6('avg(ic)')} AS mean, {r6('stddev_samp(ic)')} AS std, {r6('avg(ic) / nullif(stddev_samp(ic), 0)')} AS ir, {r6('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))')} AS t, {r6('skewness(ic)')} AS skew, {r6('kurtosis(ic)')} AS kurt FROM ic GROUP BY factor")
def res_ic_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ic_stability(R.daily_ic(long(spark, sf_dir)))


YEARS = ", yr AS (SELECT factor, strftime(date, '%Y') AS period, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic GROUP BY ALL)"


@query(IC + YEARS + f" SELECT factor, period, n, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mean / nullif(std, 0)')} AS ir FROM yr")
def res_ic_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ic_breakdown(R.daily_ic(long(spark, sf_dir)))


@query(IC + YEARS + f" SELECT factor, {r6('avg(CASE WHEN sign(mean) = s THEN 1.0 WHEN mean IS NOT NULL THEN 0 END)')} AS consistency, count(*) AS periods FROM yr JOIN (SELECT factor, sign(avg(ic)) AS s FROM ic GROUP BY factor) USING (factor) GROUP BY factor")
def res_sign_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = R.daily_ic(long(spark, sf_dir))
    return R.sign_consistency(R.ic_breakdown(ic), ic)


@query(BASE + f" SELECT factor, date, {r6('avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END)')} AS coverage, count(*) AS rows FROM l GROUP BY ALL")
def res_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coverage(long(spark, sf_dir), "date")


@query(IC + " SELECT factor, CASE WHEN coalesce(avg(CASE WHEN date < DATE '1998-01-01' THEN ic END), avg(ic)) < 0 THEN -1 ELSE 1 END AS direction FROM ic GROUP BY factor")
def res_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.directions(R.daily_ic(long(spark, sf_dir)), C("date") < F.lit("1998-01-01").cast("date"))


@query(BASE + ", ed AS (SELECT factor, min(value) AS lo, max(value) AS hi FROM l GROUP BY factor), ct AS (SELECT factor, CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM l JOIN ed USING (factor) WHERE value IS NOT NULL GROUP BY ALL) SELECT factor, CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) * g.bin / 50, 6) + 0.0 AS left_edge, coalesce(n, 0) AS n FROM ed CROSS JOIN (SELECT unnest(range(50)) AS bin) g LEFT JOIN ct USING (factor, bin)")
def res_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(long(spark, sf_dir), 50)


PNL = LAYER + ", lsr AS (SELECT factor, date, (avg(CASE WHEN layer = 5 THEN ret END) - avg(CASE WHEN layer = 1 THEN ret END)) / 2 AS ret FROM la GROUP BY ALL)"


@query(BASE + PNL + f" SELECT factor, date, {r6('ret')} AS ret FROM lsr")
def res_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.long_short(R.layers(long(spark, sf_dir), 5), 5)


def risk_sql(source: str, by: str, name: str) -> str:
    """Common table expressions that end in ``name``: the risk of each series of a table (by, date, ret)."""
    return f""", {name}1 AS (SELECT *, max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER (PARTITION BY {by}) AS bad FROM {source} WHERE ret IS NOT NULL),
{name}2 AS (SELECT *, CASE WHEN bad = 1 THEN 1 + sum(ret) OVER w ELSE product(1 + ret) OVER w END AS c FROM {name}1 WINDOW w AS (PARTITION BY {by} ORDER BY date)),
{name}3 AS (SELECT *, nullif(max(c) OVER (PARTITION BY {by} ORDER BY date), 0) AS p FROM {name}2),
{name}4 AS (SELECT {by}, count(*) AS days, max(bad) AS bad, arg_max(c, date) - 1 AS total, sum(CASE WHEN bad = 0 THEN ln(1 + ret) END) AS lg, coalesce(stddev_samp(ret) * sqrt(252), 0) AS vol, coalesce(abs(min((c - p) / p)), 0) AS max_drawdown, avg(ret) AS mean_ret, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM {name}3 GROUP BY {by}),
{name}5 AS (SELECT *, CASE WHEN days / 252.0 < 0.01 THEN 0 WHEN bad = 1 THEN total / (days / 252.0) ELSE exp(lg / (days / 252.0)) - 1 END AS annual FROM {name}4),
{name}6 AS (SELECT *, coalesce(annual / 2 / nullif(vol, 0), 0) AS sharpe FROM {name}5),
{name} AS (SELECT *, CASE WHEN max_drawdown <> 0 THEN sharpe * sqrt(abs(annual / 2) / greatest(max_drawdown, 0.125)) ELSE 0 END AS fitness FROM {name}6)"""


def slog(x: str) -> str:
    """What compounds to huge numbers, on a logarithmic scale: sign(x) ln(1 + |x|), to be compared to six places."""
    return r6(f"sign({x}) * ln(1 + abs({x}))")


def logarithmic(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.signum(c) * F.log1p(F.abs(c)) for c in names})


SERIES = PNL + ", se AS (SELECT factor, date, ret FROM lsr UNION ALL SELECT factor || '_broken', date, ret * 30 - 0.1 FROM lsr)"


@query(BASE + SERIES + risk_sql("se", "factor", "ri") + f" SELECT factor, days, {slog('total')} AS total, {r6('vol')} AS vol, {r6('max_drawdown')} AS max_drawdown, {r6('mean_ret')} AS mean_ret, {r6('win_rate')} AS win_rate, {slog('annual')} AS annual, {slog('sharpe')} AS sharpe, {slog('fitness')} AS fitness FROM ri")
def res_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of long and short returns, and of thirty times as large ones that fall below -1."""
    d = R.long_short(R.layers(long(spark, sf_dir), 5), 5)
    broken = d.select(F.concat("factor", F.lit("_broken")).alias("factor"), "date", (C("ret") * 30 - 0.1).alias("ret"))
    return logarithmic(R.risk(d.unionByName(broken)), "total", "annual", "sharpe", "fitness")


@query(BASE + LAYER + f""", ed AS (SELECT factor, date, code, layer = min(layer) OVER d AS lo, layer = max(layer) OVER d AS hi FROM la WINDOW d AS (PARTITION BY factor, date)), ex AS (SELECT * FROM ed WHERE lo OR hi), dy AS (SELECT factor, date, lead(date) OVER (PARTITION BY factor ORDER BY date) AS nd FROM (SELECT DISTINCT factor, date FROM la))
SELECT b.factor, nd AS date, {r6('count(*) FILTER (b.lo AND NOT coalesce(n.lo, false)) / nullif(CAST(count(*) FILTER (b.lo) AS DOUBLE), 0)')} AS min_layer_turnover, {r6('count(*) FILTER (b.hi AND NOT coalesce(n.hi, false)) / nullif(CAST(count(*) FILTER (b.hi) AS DOUBLE), 0)')} AS max_layer_turnover, count(*) FILTER (b.lo) AS min_layer_count, count(*) FILTER (b.hi) AS max_layer_count
FROM ex b JOIN dy USING (factor, date) LEFT JOIN ex n ON n.factor = b.factor AND n.date = nd AND n.code = b.code WHERE nd IS NOT NULL GROUP BY 1, 2""")
def res_membership_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.membership_turnover(R.layers(long(spark, sf_dir), 5))


BEST = LAYER + """, di AS (SELECT factor, CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS direction FROM ic GROUP BY factor), en AS (SELECT factor, min(layer) AS lo, max(layer) AS hi FROM la GROUP BY factor),
bl AS (SELECT factor, CASE WHEN coalesce(direction, 1) >= 0 THEN hi ELSE lo END AS best_layer, CASE WHEN coalesce(direction, 1) >= 0 OR lo = hi THEN 'top' ELSE 'bottom' END AS best_direction FROM en LEFT JOIN di USING (factor)),
bd AS (SELECT factor, date, avg(CASE WHEN layer = best_layer THEN ret END) AS best, avg(ret) AS universe FROM la JOIN bl USING (factor) GROUP BY ALL),
bs AS (SELECT factor, 'best' AS kind, date, best AS ret FROM bd UNION ALL SELECT factor, 'universe', date, universe FROM bd UNION ALL SELECT factor, 'excess', date, coalesce(best, 0) - coalesce(universe, 0) FROM bd)""" + risk_sql("bs", "factor, kind", "bri") + """,
bm AS (SELECT factor, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS positive_months FROM (SELECT factor, date_trunc('month', date) AS m, sum(best) AS s FROM bd WHERE best IS NOT NULL GROUP BY ALL) GROUP BY factor),
bk AS (SELECT factor, """ + ", ".join(f"max(CASE WHEN kind = 'best' THEN {c} END) AS best_{c}" for c in ("total", "annual", "vol", "sharpe", "max_drawdown", "fitness")) + """, max(CASE WHEN kind = 'universe' THEN annual END) AS universe_annual, max(CASE WHEN kind = 'excess' THEN annual END) AS excess_annual FROM bri GROUP BY factor)"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = long(spark, sf_dir)
    return R.best_layer(R.layers(d, 5), R.directions(R.daily_ic(d), C("date").isNotNull()))


@query(IC + BEST + f" SELECT factor, CAST(best_layer AS INTEGER) AS best_layer, best_direction, {slog('best_total')} AS best_total, {slog('best_annual')} AS best_annual, {r6('best_vol')} AS best_vol, {slog('best_sharpe')} AS best_sharpe, {r6('best_max_drawdown')} AS best_max_drawdown, {slog('best_fitness')} AS best_fitness, {slog('universe_annual')} AS universe_annual, {slog('excess_annual')} AS excess_annual, {r6('positive_months')} AS positive_months FROM bl JOIN bk USING (factor) JOIN bm USING (factor)")
def res_best_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-only metrics of the layer that the sign of the IC points to, against all rows in equal weights."""
    d = logarithmic(best(spark, sf_dir), "best_total", "best_annual", "best_sharpe", "best_fitness", "universe_annual", "excess_annual")
    return d.withColumn("best_layer", C("best_layer").cast("int"))


TOP = """, tp AS (SELECT factor, date, code, ret, 1.0 / count(*) OVER (PARTITION BY factor, date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, code) AS rn FROM l WHERE value IS NOT NULL) WHERE rn <= 10),
dy AS (SELECT factor, date, lead(date) OVER (PARTITION BY factor ORDER BY date) AS nd FROM (SELECT DISTINCT factor, date FROM tp)),
dr AS (SELECT factor, nd AS date, code, weight * (1 + coalesce(ret, 0)) / sum(weight * (1 + coalesce(ret, 0))) OVER (PARTITION BY factor, date) AS od FROM tp JOIN dy USING (factor, date) WHERE nd IS NOT NULL),
mv AS (SELECT factor, date, weight, coalesce(weight, 0) * coalesce(ret, 0) AS gr, CASE WHEN date = min(date) OVER (PARTITION BY factor) THEN 0 ELSE coalesce(weight, 0) - coalesce(od, 0) END AS m FROM tp FULL JOIN dr USING (factor, date, code)),
pf AS (SELECT factor, date, count(weight) AS holdings, sum(gr) AS gross, sum(greatest(m, 0)) AS buy, sum(greatest(-m, 0)) AS sell FROM mv GROUP BY ALL),
pn AS (SELECT *, (buy + sell) / 2 AS turnover, buy * 0.0005641 + sell * 0.0010641 AS cost, gross - buy * 0.0005641 - sell * 0.0010641 AS net FROM pf)"""


def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.portfolio(R.top_n(long(spark, sf_dir), 10))


@query(BASE + TOP + f" SELECT factor, date, holdings, {r6('gross')} AS gross, {r6('buy')} AS buy, {r6('sell')} AS sell, {r6('turnover')} AS turnover, {r6('cost')} AS cost, {r6('net')} AS net FROM pn")
def res_top_n_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top10(spark, sf_dir)


@query(BASE + TOP + f" SELECT factor, {r6('avg(turnover)')} AS mean, {r6('quantile_cont(turnover, 0.5)')} AS median, {r6('quantile_cont(turnover, 0.9)')} AS p90, {r6('sum(turnover)')} AS total, {r6('sum(cost)')} AS cost FROM pn GROUP BY factor")
def res_turnover_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.turnover_summary(top10(spark, sf_dir))


@query(BASE + TOP + f" SELECT factor, date, 'top10' AS portfolio, {r6('gross')} AS gross, {r6('net')} AS net, {slog('product(1 + gross) OVER w - 1')} AS cum_gross, {slog('product(1 + net) OVER w - 1')} AS cum_net FROM pn WINDOW w AS (PARTITION BY factor ORDER BY date)")
def res_pnl_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logarithmic(R.pnl_table({"top10": top10(spark, sf_dir)}), "cum_gross", "cum_net")


@query(BASE + TOP + f" SELECT factor, {r6('sum(gross) / sum(turnover)')} AS margin FROM pn GROUP BY factor")
def res_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.margin(top10(spark, sf_dir))


@query(BASE + LAYER + f", lr AS (SELECT factor, date, layer, avg(ret) AS ret FROM la GROUP BY ALL), mr AS (SELECT factor, date, {rank_sql('layer', 'factor, date')} AS a, {rank_sql('ret', 'factor, date')} AS c FROM lr) SELECT factor, date, {r6('covar_samp(a, c) / (nullif(stddev_samp(a), 0) * nullif(stddev_samp(c), 0))')} AS rho FROM mr GROUP BY ALL")
def res_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.monotonicity(R.layers(long(spark, sf_dir), 5))


@query()
def res_constrained_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried positions: a recursion; the tests hold it against a plain loop and, unconstrained, against the windowed form."""
    w = R.top_n(long(spark, sf_dir), 10)
    return R.constrained_portfolio(w.withColumns({"can_buy": C("code") % 7 != 0, "can_sell": C("code") % 5 != 0}))


LAYERS = BASE + LAYER + ", tp AS (SELECT factor || '|' || layer AS factor, date, code, ret, 1.0 / count(*) OVER (PARTITION BY factor, layer, date) AS weight FROM la)," + TOP[TOP.index("\ndy AS") :]


@query(LAYERS + f" SELECT split_part(factor, '|', 1) AS factor, CAST(split_part(factor, '|', 2) AS INTEGER) AS layer, date, holdings, {r6('gross')} AS gross, {r6('buy')} AS buy, {r6('sell')} AS sell, {r6('turnover')} AS turnover, {r6('cost')} AS cost, {r6('net')} AS net FROM pn")
def res_layer_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.layer_portfolios(R.layers(long(spark, sf_dir), 5)).withColumn("layer", C("layer").cast("int"))


@query(BASE + TOP + ", ts AS (SELECT factor, date, gross AS ret FROM pn)" + risk_sql("ts", "factor", "tr") + f" SELECT factor, {slog('total')} AS total, {slog('annual')} AS annual, {r6('vol')} AS vol, {slog('sharpe')} AS sharpe, {r6('max_drawdown')} AS max_drawdown, {slog('fitness')} AS fitness, {r6('return_sum')} AS return_sum, {r6('turnover_mean')} AS turnover_mean, {r6('holdings_mean')} AS holdings_mean FROM tr JOIN (SELECT factor, sum(gross) AS return_sum, avg(turnover) AS turnover_mean, avg(holdings) AS holdings_mean FROM pn GROUP BY factor) USING (factor)")
def res_portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logarithmic(R.portfolio_summary(top10(spark, sf_dir)), "total", "annual", "sharpe", "fitness")


def label_sql(out: str, source: str, value: str, by: list[str], name: str) -> str:
    """A common table expression ``out``: the rows of ``source`` with their quarter of the values in a group."""
    keys, mine = ", ".join(by), ", ".join(f"s.{x}" for x in by)
    return f""", {out}0 AS (SELECT {keys}, quantile_cont({value}, [0, 0.25, 0.5, 0.75, 1]) AS e, count(*) AS n, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY ALL),
{out} AS (SELECT s.*, CAST(CASE WHEN n = 1 THEN 2 WHEN n < 4 THEN greatest(1, ceil((row_number() OVER (PARTITION BY {mine} ORDER BY code) - 1) * 4 / CAST(n - 1 AS DOUBLE)))
 WHEN len(list_distinct(e)) = 5 THEN CASE WHEN {value} <= e[2] THEN 1 WHEN {value} <= e[3] THEN 2 WHEN {value} <= e[4] THEN 3 ELSE 4 END
 WHEN lo = hi THEN 2 ELSE greatest(1, least(4, ceil(({value} - lo) / ((hi - lo) / 4)))) END AS INTEGER) AS {name} FROM {source} s JOIN {out}0 USING ({keys}))"""


CELLS = BASE + ", d0 AS (SELECT * FROM br WHERE factor_a IS NOT NULL AND factor_b IS NOT NULL AND ret IS NOT NULL)" + label_sql("d1", "d0", "factor_a", ["date"], "control_group") + label_sql("d2", "d1", "factor_b", ["date", "control_group"], "factor_group") + ", ce AS (SELECT date, control_group, factor_group, avg(ret) AS ret, count(*) AS n FROM d2 GROUP BY ALL)"


def sorted_twice(spark: SparkSession, sf_dir: str) -> tuple:
    return R.future_return(base(spark, sf_dir), "pct"), "factor_a", "factor_b", "pct_1d", 4


@query(CELLS + f" SELECT control_group, factor_group, {r6('avg(ret)')} AS ret, CAST(sum(n) AS BIGINT) AS n FROM ce GROUP BY ALL")
def res_double_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.double_sort(*sorted_twice(spark, sf_dir)).withColumns({c: C(c).cast("int") for c in ("control_group", "factor_group")})


SPREAD = CELLS + f""", eg AS (SELECT date, min(factor_group) AS lo, max(factor_group) AS hi FROM ce GROUP BY date), ic AS (SELECT 'factor_b' AS factor, date, avg(CASE WHEN factor_group = hi THEN ret END) - avg(CASE WHEN factor_group = lo THEN ret END) AS ic FROM ce JOIN eg USING (date) GROUP BY date){NW},
gr AS (SELECT date, factor_group, avg(ret) AS ret FROM ce GROUP BY ALL), gk AS (SELECT date, {rank_sql('factor_group', 'date')} AS a, {rank_sql('ret', 'date')} AS c FROM gr), gm AS (SELECT date, covar_samp(a, c) / (nullif(stddev_samp(a), 0) * nullif(stddev_samp(c), 0)) AS rho FROM gk GROUP BY date)"""


@query(SPREAD + f" SELECT 'factor_b' AS factor, {r6('avg(ic)')} AS spread_mean, {r6('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0 END)')} AS positive, {r6('avg(ic) * 252')} AS annual, {r6('(SELECT max(t) FROM nw)')} AS nw_t, {r6('(SELECT avg(rho) FROM gm)')} AS monotonicity, (SELECT min(n) FROM ce) AS least_cell, (SELECT CAST(sum(n) AS BIGINT) FROM ce) AS rows, (SELECT count(DISTINCT date) FROM ce) AS dates FROM ic")
def res_double_sort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.double_sort_summary(*sorted_twice(spark, sf_dir))


LEGS = "CASE WHEN count(pct) OVER w = 5 THEN product(1 + pct) OVER w - 1 END AS r5"
ROBUST = BASE[: BASE.index("\nl AS (")] + f""" r AS (SELECT *, {LEGS} FROM br WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
l AS (""" + " UNION ALL ".join(f"SELECT date, code, '{f}|{p}' AS factor, {f} AS value, {x} AS ret FROM r" for f in ("factor_a", "factor_b") for p, x in ((1, "ret"), (5, "r5"))) + ")" + IC[len(BASE) :] + PNL + risk_sql("lsr", "factor", "rr") + """,
rb AS (SELECT split_part(factor, '|', 1) AS factor, CAST(split_part(factor, '|', 2) AS INTEGER) AS period, ic_mean, ir, total FROM (SELECT factor, avg(ic) AS ic_mean, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS ir FROM ic GROUP BY factor) LEFT JOIN rr USING (factor))"""


def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.robustness(base(spark, sf_dir), ["factor_a", "factor_b"], "pct", (1, 5))


@query(ROBUST + f" SELECT factor, period, {r6('ic_mean')} AS ic_mean, {r6('ir')} AS ir, {slog('total')} AS total FROM rb")
def res_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logarithmic(robust(spark, sf_dir), "total")


@query(ROBUST + f", rs AS (SELECT *, sign(avg(ic_mean) OVER (PARTITION BY factor)) AS s FROM rb) SELECT factor, {r6('avg(CASE WHEN total > 0 THEN 1.0 WHEN total IS NOT NULL THEN 0 END)')} AS positive_ratio, {r6('avg(CASE WHEN s <> 0 AND ic_mean <> 0 THEN CASE WHEN sign(ic_mean) = s THEN 1.0 ELSE 0 END END)')} AS sign_consistency, {r6('quantile_cont(ir, 0.5)')} AS ir_median, count(DISTINCT period) AS periods FROM rs GROUP BY factor")
def res_period_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.period_robustness(robust(spark, sf_dir))


PHASES = [("train", "1992-01-01", "1994-12-31"), ("val", "1995-01-01", "1996-12-31"), ("test", "1997-01-01", "2099-12-31")]
PHASED = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in PHASES) + " END"


@query(BASE.replace("\nl AS (", "\nl0 AS (") + f", l AS (SELECT date, code, factor || '|' || {PHASED} AS factor, value, ret FROM l0 WHERE {PHASED} IS NOT NULL)" + DECAY[len(BASE) :] + f", de AS (SELECT factor, lag, avg(ic) AS ic FROM ic GROUP BY ALL), dz AS (SELECT factor, abs(ic) AS z FROM de WHERE lag = 0), dh AS (SELECT factor, min(CASE WHEN lag > 0 AND abs(ic) < z / 2 THEN lag END) AS half_life FROM de JOIN dz USING (factor) GROUP BY factor), dk AS (SELECT factor, {rank_sql('lag', 'factor')} AS a, {rank_sql('ic', 'factor')} AS c FROM de WHERE ic IS NOT NULL), dt AS (SELECT factor, covar_samp(a, c) / (nullif(stddev_samp(a), 0) * nullif(stddev_samp(c), 0)) AS rank_corr FROM dk GROUP BY factor) SELECT split_part(factor, '|', 1) AS factor, split_part(factor, '|', 2) AS phase, CAST(lag AS INTEGER) AS lag, {r6('ic')} AS ic, CAST(half_life AS INTEGER) AS half_life, {r6('rank_corr')} AS rank_corr FROM de LEFT JOIN dh USING (factor) LEFT JOIN dt USING (factor)")
def res_phase_ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.phase_ic_decay(long(spark, sf_dir), PHASES, 3)


SPLIT = IC + ", st AS (SELECT factor, CASE WHEN date <= DATE '1994-12-31' THEN 'train' WHEN date <= DATE '1996-12-31' THEN 'validation' ELSE 'oos' END AS split, ic AS ic_mean FROM ic)"


@query(SPLIT + f", so AS (SELECT factor, " + ", ".join(f"count(*) FILTER (split = '{x}') AS {x}_obs, avg(ic_mean) FILTER (split = '{x}') AS {x}_score" for x in ("train", "validation", "oos")) + f" FROM st GROUP BY factor) SELECT factor, train_obs, validation_obs, oos_obs, {r6('train_score')} AS train_score, {r6('validation_score')} AS validation_score, {r6('oos_score')} AS oos_score, {r6('CASE WHEN train_score > 0 THEN validation_score / train_score END')} AS validation_decay_ratio, {r6('CASE WHEN train_score > 0 THEN oos_score / train_score END')} AS oos_decay_ratio, concat_ws('; ', CASE WHEN train_score IS NULL THEN 'missing_train_score' END, CASE WHEN validation_score IS NULL THEN 'missing_validation_score' END, CASE WHEN train_score * validation_score < 0 THEN 'validation_score_sign_flip' END) AS split_warning_reasons, coalesce(train_score * validation_score >= 0, false) AS split_pass FROM so")
def res_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(C("date") <= F.lit("1994-12-31").cast("date"), "train").when(C("date") <= F.lit("1996-12-31").cast("date"), "validation").otherwise("oos")
    t = R.daily_ic(long(spark, sf_dir)).select("factor", day.alias("split"), C("ic").alias("ic_mean"))
    return R.split_metrics(t).drop("train_ic_mean_mean", "validation_ic_mean_mean", "oos_ic_mean_mean")


@query(BASE + LAYER + f""", le AS (SELECT factor, min(layer) AS lo, max(layer) AS hi FROM la GROUP BY factor), ld AS (SELECT factor, date, avg(CASE WHEN layer = lo THEN ret END) AS x, avg(CASE WHEN layer = hi THEN ret END) AS y FROM la JOIN le USING (factor) GROUP BY ALL),
lt AS (SELECT factor, date, (y - x) * CASE WHEN product(1 + x) OVER w > product(1 + y) OVER w THEN -1 ELSE 1 END AS d FROM ld WINDOW w AS (PARTITION BY factor)) SELECT a.factor AS a, b.factor AS b, {r6('corr(a.d, b.d)')} AS corr FROM lt a JOIN lt b ON a.date = b.date AND a.factor < b.factor GROUP BY ALL""")
def res_long_short_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.long_short_correlations(R.layers(long(spark, sf_dir), 5))


@query(IC + f", mi AS (SELECT factor, strftime(date, '%Y-%m') AS period, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic GROUP BY ALL) SELECT factor, period, n, {r6('mean')} AS mean, {r6('std')} AS std, {r6('mean / nullif(std, 0)')} AS ir FROM mi")
def res_ic_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ic_breakdown(R.daily_ic(long(spark, sf_dir)), "yyyy-MM")


FR = ", fr AS (SELECT factor, date, covar_samp(CASE WHEN ret IS NOT NULL THEN value END, CASE WHEN value IS NOT NULL THEN ret END) / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN value END), 0) AS slope FROM l GROUP BY ALL)"


@query(BASE + FR + f" SELECT factor, date, {r6('slope')} AS slope FROM fr")
def res_factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.factor_returns(long(spark, sf_dir))


@query()
def res_factor_returns_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.factor_returns_joint(R.future_return(base(spark, sf_dir), "pct"), ["factor_a", "factor_b"], "pct_1d")


EW = FR + ", lw AS (SELECT factor, date, " + ", ".join(f"{'slope' if k == 0 else f'lag(slope, {k}) OVER o'} AS x{k}" for k in range(4)) + " FROM fr WINDOW o AS (PARTITION BY factor ORDER BY date)), ew AS (SELECT factor, date, (" + " + ".join(f"coalesce(x{k} * power(0.75, {k}), 0)" for k in range(4)) + ") / nullif(" + " + ".join(f"CASE WHEN x{k} IS NOT NULL THEN power(0.75, {k}) ELSE 0 END" for k in range(4)) + ", 0) AS ewma FROM lw)"


@query(BASE + EW + f" SELECT factor, date, {r6('ewma')} AS ewma FROM ew")
def res_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ewma(R.factor_returns(long(spark, sf_dir)), "slope", 4, 3.0).select("factor", "date", "ewma")


@query(BASE + EW + f", lt AS (SELECT factor, date, lag(ewma) OVER (PARTITION BY factor ORDER BY date) AS f FROM ew) SELECT date, code, {r6('sum(coalesce(value * f, 0))')} AS prediction FROM l JOIN lt USING (factor, date) GROUP BY ALL")
def res_predicted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = long(spark, sf_dir)
    return R.predicted(d, R.ewma(R.factor_returns(d), "slope", 4, 3.0))


@query(IC + f", ir AS (SELECT factor, avg(ic) / stddev_samp(ic) AS ir FROM ic GROUP BY factor), wt AS (SELECT factor, ir / sum(abs(ir)) OVER (PARTITION BY sign(ir)) AS weight FROM ir) SELECT date, code, {r6('CASE WHEN count(value) = count(*) THEN sum(value * weight) END')} AS value FROM l JOIN wt USING (factor) GROUP BY ALL")
def res_combined_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = long(spark, sf_dir)
    return R.combined(d, R.factor_weights(R.ic_summary(R.daily_ic(d)), "icir"))


@query(BASE + f" SELECT 'factor_a' AS a, 'factor_b' AS b, {r6('corr(factor_a, factor_b)')} AS corr FROM b")
def res_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correlations(base(spark, sf_dir), ["factor_a", "factor_b"])


MONTHS = ", mo AS (SELECT factor, strftime(date, '%Y-%m') AS period, avg(ic) AS mean FROM ic GROUP BY ALL), sg AS (SELECT factor, sign(avg(ic)) AS s FROM ic GROUP BY factor)"
SAME = "avg(CASE WHEN sign(mean) = s THEN 1.0 WHEN mean IS NOT NULL THEN 0 END)"
EFFECT = IC + YEARS + MONTHS + BEST + TOP + f""", mlr AS (SELECT factor, date, layer, avg(ret) AS ret FROM la GROUP BY ALL), mrk AS (SELECT factor, date, {rank_sql('layer', 'factor, date')} AS a, {rank_sql('ret', 'factor, date')} AS c FROM mlr),
mrh AS (SELECT factor, date, covar_samp(a, c) / (nullif(stddev_samp(a), 0) * nullif(stddev_samp(c), 0)) AS rho FROM mrk GROUP BY ALL),
et AS (SELECT factor, ic_mean, ir, ic_count, s * rho AS monotonicity, yc, mc, coverage, margin, turnover, best_annual, best_sharpe, best_max_drawdown, excess_annual, positive_months FROM
 (SELECT factor, avg(ic) AS ic_mean, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0) AS ir, count(ic) AS ic_count FROM ic GROUP BY factor) JOIN sg USING (factor) JOIN (SELECT factor, avg(rho) AS rho FROM mrh GROUP BY factor) USING (factor)
 JOIN (SELECT factor, {SAME} AS yc FROM yr JOIN sg USING (factor) GROUP BY factor) USING (factor) JOIN (SELECT factor, {SAME} AS mc FROM mo JOIN sg USING (factor) GROUP BY factor) USING (factor)
 JOIN (SELECT factor, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END) AS coverage FROM l GROUP BY factor) USING (factor)
 JOIN (SELECT factor, CASE WHEN sum(turnover) > 1e-8 THEN sum(gross) / sum(turnover) END AS margin, avg(turnover) AS turnover FROM pn GROUP BY factor) USING (factor) JOIN bk USING (factor) JOIN bm USING (factor))"""


def clip_sql(x: str, zero: float, one: float) -> str:
    return f"coalesce(greatest(0, least(1, ({x} - {zero}) / ({one} - {zero}))), 0)"


SCORES = f""", sc AS (SELECT *, 100 * ({clip_sql('abs(ic_mean)', 0.02, 0.08)} + {clip_sql('abs(ir)', 0.3, 0.8)} + {clip_sql('monotonicity', 0, 0.4)}) / 3 AS s1,
 100 * ({clip_sql('best_annual', 0.05, 0.5)} + {clip_sql('best_sharpe', 0.5, 2.5)} + {clip_sql('best_max_drawdown', 0.5, 0.05)} + {clip_sql('margin', 0.001, 0.03)} + {clip_sql('excess_annual', 0.03, 0.48)} + {clip_sql('positive_months', 0.48, 0.75)}) / 6 AS s2,
 100 * ({clip_sql('yc', 0.5, 0.9)} * 0.3 + {clip_sql('mc', 0.55, 0.9)} * 0.7) AS s3, 100 * ({clip_sql('turnover', 0.75, 0.15)} * 0.4 + {clip_sql('margin', 0.001, 0.02)} * 0.6) AS s4 FROM et), st AS (SELECT *, s1 * 0.3 + s2 * 0.45 + s3 * 0.05 + s4 * 0.2 AS score FROM sc)"""


@query(EFFECT + SCORES + f" SELECT factor, {r6('s1')} AS score_predictive_power, {r6('s2')} AS score_long_only_performance, {r6('s3')} AS score_stability, {r6('s4')} AS score_tradeability, {r6('score')} AS score, CASE WHEN score >= 80 THEN 'S' WHEN score >= 70 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'REJECT' END AS tier, false AS stage_a, false AS stage_b, ic_count >= 250 AS enough FROM st")
def res_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from all parts; without a p value no factor passes the first stage."""
    d = long(spark, sf_dir)
    ic = R.daily_ic(d)
    layered = R.layers(d, 5)
    sign = ic.groupBy("factor").agg(F.signum(F.avg("ic")).alias("_s"))
    mono = R.monotonicity(layered).groupBy("factor").agg(F.avg("rho").alias("_rho")).join(sign, "factor").select("factor", (C("_s") * C("_rho")).alias("monotonicity"))
    consistent = lambda pattern, name: R.sign_consistency(R.ic_breakdown(ic, pattern), ic).select("factor", C("consistency").alias(name))
    p = top10(spark, sf_dir)
    table = R.ic_summary(ic).select("factor", "ic_mean", "ir", "ic_count")
    for part in (mono, consistent("yyyy", "yearly_consistency"), consistent("yyyy-MM", "monthly_consistency"), R.coverage(d).select("factor", "coverage"), R.margin(p), R.turnover_summary(p).select("factor", C("mean").alias("turnover")), best(spark, sf_dir)):
        table = table.join(part, "factor", "left")
    out = R.effectiveness(table)
    return out.select("factor", *[f"score_{x}" for x in R.PARTS], "score", "tier", "stage_a", "stage_b", (C("ic_count") >= 250).alias("enough"))
