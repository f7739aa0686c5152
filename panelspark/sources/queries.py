"""Curation, stores and signals as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import research as R
from panelspark.operators.queries import BASE, IC, base, long
from panelspark.plans.queries import NUDGE, panel_sql, read, supplier_rows

from . import curate as K
from . import signals as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c) + NUDGE, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return add


# Curation


@query("SELECT CAST(o_orderdate AS DATE) AS date, o_custkey || '.sz' AS code, round(arg_max(o_totalprice, o_orderkey) * 0.01, 6) AS turnover_rate, round(arg_max(o_totalprice, o_orderkey) * 10000, 6) AS circ_mv, CAST(NULL AS DOUBLE) AS pe FROM orders GROUP BY 1, 2")
def cur_daily_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor strings and units to a typed table, the last row of a key kept, a missing column NULL."""
    o = read(spark, sf_dir, "orders")
    raw = o.select(F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.concat(C("o_custkey").cast("string"), F.lit(".sz ")).alias("ts_code"), C("o_totalprice").cast("string").alias("turnover_rate"), C("o_totalprice").alias("circ_mv"), "o_orderkey")
    return K.curate(raw, K.SPECS["daily_basic"], "o_orderkey").select("date", "code", "turnover_rate", "circ_mv", "pe")


ADJ = panel_sql().split("p AS (")[0] + "a AS (SELECT date, code, close, CAST(1 + (year(date) - 1990) / 7.0 AS DOUBLE) AS f FROM named), h AS (SELECT *, max(f) OVER (PARTITION BY code) AS hi, min(f) OVER (PARTITION BY code) AS lo FROM a)"


@query(ADJ + " SELECT date, code, round(close * f / hi, 6) + 0.0 AS forward_close, round(close * f / lo, 6) + 0.0 AS backward_close, round(close * f / lo / lag(close * f / lo) OVER (PARTITION BY code ORDER BY date) - 1, 6) + 0.0 AS ret_1d FROM h")
def cur_adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = supplier_rows(spark, sf_dir).select("date", "code", "close", (1 + (F.year("date") - 1990) / 7.0).cast("double").alias("adj_factor"))
    return K.adjusted(d, ["close"]).select("date", "code", "forward_close", "backward_close", "ret_1d")


@query("SELECT s_suppkey AS member, 'n' || n_nationkey AS l3_code, n_name AS l3_name, 'r' || r_regionkey AS l2_code, r_name AS l2_name, 'w' AS l1_code, 'WORLD' AS l1_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def cur_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    tree = n.select(F.concat(F.lit("n"), "n_nationkey").alias("code"), C("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    tree = tree.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("code"), C("r_name").alias("name"), F.lit("w").alias("parent"))).unionByName(spark.createDataFrame([("w", "WORLD", None)], "code string, name string, parent string"))
    s = read(spark, sf_dir, "supplier").select(C("s_suppkey").alias("member"), F.concat(F.lit("n"), "s_nationkey").alias("industry_code"))
    return K.hierarchy(s, tree).select("member", "l3_code", "l3_name", "l2_code", "l2_name", "l1_code", "l1_name")


@query("""WITH a AS (SELECT l_suppkey AS code, l_quantity AS price, CAST(sum(l_linenumber) AS DOUBLE) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY code ORDER BY price) / sum(w) OVER (PARTITION BY code) AS cdf FROM a)
SELECT code, count(*) AS n, min(price) AS low, max(price) AS high, arg_max(price, w * 1000 - price) AS mode, round(sum(price * w) / sum(w), 6) + 0.0 AS mean, min(CASE WHEN cdf >= 0.1 - 1e-12 THEN price END) AS q10, min(CASE WHEN cdf >= 0.5 - 1e-12 THEN price END) AS q50, min(CASE WHEN cdf >= 0.9 - 1e-12 THEN price END) AS q90,
round(sqrt(greatest(sum(price * price * w) / sum(w) - power(sum(price * w) / sum(w), 2), 0)), 6) + 0.0 AS std FROM c GROUP BY code""")
def cur_weighted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "lineitem").groupBy(C("l_suppkey").alias("code"), C("l_quantity").alias("price")).agg(F.sum("l_linenumber").cast("double").alias("w"))
    return K.weighted_distribution(d, ["code"], "price", "w")


@query("""WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey % 50 AS code, CASE o_orderstatus WHEN 'O' THEN '' ELSE o_orderstatus END AS org, CAST(o_custkey % 7 AS VARCHAR) AS author, CASE o_orderpriority[1] WHEN '1' THEN 5.0 WHEN '2' THEN 3.0 WHEN '3' THEN 1.0 WHEN '4' THEN 4.0 END AS grade, o_totalprice AS eps FROM orders)
SELECT date, code, count(*) AS reports, count(DISTINCT CASE WHEN org <> '' THEN org END) AS orgs, count(DISTINCT author) AS authors, round(avg(grade), 6) + 0.0 AS grade_mean, round(quantile_cont(CAST(grade AS DOUBLE), 0.5), 6) + 0.0 AS grade_median, round(min(eps), 6) AS eps_min, round(max(eps), 6) AS eps_max, round(avg(eps), 6) + 0.0 AS eps_mean FROM g GROUP BY ALL""")
def cur_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from tokens anywhere in a rating's text."""
    o = read(spark, sf_dir, "orders")
    text = F.lit(None).cast("string")
    for start, rating in (("1", " Strong BUY, again "), ("2", "评级: 中性"), ("3", "Sell now"), ("4", "may Outperform")):
        text = F.when(C("o_orderpriority").startswith(start), rating).otherwise(text)
    d = o.select(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), (C("o_custkey") % 50).alias("code"), F.when(C("o_orderstatus") == "O", "").otherwise(C("o_orderstatus")).alias("org"), (C("o_custkey") % 7).cast("string").alias("author"), K.grade(text).alias("grade"), C("o_totalprice").alias("eps"))
    return K.consensus(d)


@query("SELECT p_partkey, upper(replace(p_name, ' ', '')) || '.SH' AS code, starts_with(upper(replace(p_name, ' ', '')), 'ST') AS special, CASE WHEN p_size > 1 THEN p_size / 100.0 ELSE p_size END AS share FROM part")
def cur_codes_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", K.code(F.concat("p_name", F.lit(".xshg"))).alias("code"), K.is_special(C("p_name")).alias("special"), K.share_of_one(C("p_size").cast("double")).alias("share"))


# Stores and signals


@query("WITH o AS (SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_name AS expression, p_brand AS hash FROM part WHERE p_size >= 49), n AS (SELECT p_brand AS hash, min(p_partkey) AS seq, arg_min(p_name, p_partkey) AS expression FROM part WHERE p_brand NOT IN (SELECT hash FROM o) GROUP BY 1) SELECT id, printf('old_%d', id) AS name, expression, hash FROM o UNION ALL SELECT i, printf('alpha_%06d', i), expression, hash FROM (SELECT (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY seq) AS i, expression, hash FROM n)")
def sig_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts offered to a registry of the largest ones' expressions, by brand."""
    p = read(spark, sf_dir, "part")
    old = p.where("p_size >= 49").withColumn("id", F.row_number().over(Window.orderBy("p_partkey")).cast("long")).select("id", F.format_string("old_%d", "id").alias("name"), C("p_name").alias("expression"), C("p_brand").alias("hash"))
    return G.register_expressions(old, p.select(C("p_partkey").alias("seq"), C("p_name").alias("expression"), C("p_brand").alias("hash")))


METRICS = "WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM m)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(C("p_partkey").cast("string").alias("name"), C("p_size").cast("double").alias("a"), C("p_retailprice").alias("b"))


@query(METRICS + " SELECT name, round(0.7 * coalesce((a - ma) / nullif(sa, 0), 0) + 0.3 * coalesce((b - mb) / nullif(sb, 0), 0), 6) + 0.0 AS score, CAST(dense_rank() OVER (ORDER BY 0.7 * coalesce((a - ma) / nullif(sa, 0), 0) + 0.3 * coalesce((b - mb) / nullif(sb, 0), 0) DESC) AS INTEGER) AS rank FROM m CROSS JOIN s")
def sig_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scoreboard(metrics(spark, sf_dir), {"a": 0.7, "b": 0.3}).select("name", "score", "rank")


@query("SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_size <= 20")
def sig_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    return G.pending(m, m.where("a > 20")).select("name")


COMBO = BASE + """, z AS (SELECT factor, date, code, (sg * value - avg(sg * value) OVER w) / nullif(stddev_pop(sg * value) OVER w, 0) * wt AS v FROM (SELECT *, CASE factor WHEN 'factor_a' THEN -1 ELSE 1 END AS sg, CASE factor WHEN 'factor_a' THEN 0.6 / 1.0 ELSE 0.4 / 1.0 END AS wt FROM l) WINDOW w AS (PARTITION BY factor, date)),
c AS (SELECT date, code, sum(v) AS v FROM z WHERE v IS NOT NULL GROUP BY ALL) SELECT date, code, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) + 0.0 AS value FROM c WINDOW w AS (PARTITION BY date)"""


@query(COMBO)
def sig_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("factor_a", 0.6, -1), ("factor_b", 0.4, 1)], "name string, weight double, direction int")
    return G.combine(long(spark, sf_dir).withColumnRenamed("factor", "name").select("name", "date", "code", "value"), table)


FLAGS = {"is_st": 13, "is_suspended": 17, "is_limit_up_close": 19, "is_limit_down_close": 23}
DAY = BASE + ", dy AS (SELECT code, factor_b AS score, close, code % 7 <> 0 AS can_buy, code % 11 <> 0 AS can_sell, " + ", ".join(f"code % {n} = 0 AS {c}" for c, n in FLAGS.items()) + """ FROM b WHERE date = (SELECT max(date) FROM b)),
tg AS (SELECT code, score, close, row_number() OVER (ORDER BY score DESC, code) AS rn, count(*) OVER () AS n, 0.98 / count(*) OVER () AS target_weight FROM (SELECT * FROM dy WHERE score IS NOT NULL AND can_buy AND NOT is_st AND NOT is_suspended AND NOT is_limit_up_close ORDER BY score DESC, code LIMIT 20))"""


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    last = b.agg(F.max("date").alias("date"))
    return b.join(F.broadcast(last), "date").select("code", C("factor_b").alias("score"), "close", (C("code") % 7 != 0).alias("can_buy"), (C("code") % 11 != 0).alias("can_sell"), *[(C("code") % n == 0).alias(c) for c, n in FLAGS.items()])  # last is one row


@query(DAY + " SELECT code, round(score, 6) + 0.0 AS signal, CAST(rn AS INTEGER) AS signal_rank, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((rn - 1) * least(10, n) / CAST(n - 1 AS DOUBLE))) END AS INTEGER) AS layer, round(target_weight, 6) + 0.0 AS target_weight, round(close, 6) + 0.0 AS close FROM tg WHERE n >= 5")
def sig_target_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.target_holdings(day(spark, sf_dir), 20, 5, 0.2, 0.2)


ORDERS = DAY + """, ps AS (SELECT code, (code % 5 + 1) * 300 AS shares, CASE WHEN code % 6 = 0 THEN 0 ELSE (code % 5 + 1) * 300 END AS available, close AS last_price, can_sell, is_suspended, is_limit_down_close FROM dy WHERE code % 2 = 0),
bo AS (SELECT coalesce(tg.code, ps.code) AS code, CAST(coalesce(target_weight, 0) AS DOUBLE) AS w, CAST(coalesce(shares, 0) AS DOUBLE) AS sh, CAST(coalesce(available, 0) AS DOUBLE) AS av, coalesce(shares, 0) * coalesce(last_price, 0) AS val, CASE WHEN coalesce(tg.close, 0) > 0 THEN tg.close ELSE coalesce(last_price, 0) END AS price,
 concat_ws(',', CASE WHEN coalesce(available, 0) <= 0 THEN 'available_shares' END, CASE WHEN NOT ps.can_sell THEN 'can_sell' END, CASE WHEN ps.is_suspended THEN 'is_suspended' END, CASE WHEN ps.is_limit_down_close THEN 'is_limit_down_close' END) AS why FROM (SELECT * FROM tg WHERE n >= 5) tg FULL JOIN ps ON tg.code = ps.code),
bw AS (SELECT *, CASE WHEN sh > 0 AND (w <= 0 OR val > w * 5000000 * 0.98 + 1e-9) AND why <> '' THEN 'blocked_sell:' || why ELSE '' END AS blk FROM bo),
iv AS (SELECT *, greatest(0, 5000000 * 0.98 - sum(CASE WHEN blk <> '' THEN val ELSE 0 END) OVER ()) AS inv FROM bw), dl AS (SELECT *, w * inv AS want, w * inv - val AS delta FROM iv),
nd AS (SELECT *, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) OVER () AS need FROM dl), mv AS (SELECT *, CASE WHEN delta > 0 THEN delta * least(1, 200000 * 0.98 / need) ELSE delta END AS mo FROM nd),
sz AS (SELECT *, floor(abs(mo) / nullif(price, 0)) AS size FROM mv), os AS (SELECT *, CASE WHEN mo > 0 THEN floor(size / 100) * 100 ELSE floor(least(size, floor(av)) / 100) * 100 END AS n, price <= 0 OR mo = 0 AS idle FROM sz), fi AS (SELECT *, NOT idle AND n * price < 1000 AS small FROM os)"""


@query(ORDERS + " SELECT code, CASE WHEN blk <> '' THEN 'HOLD' WHEN mo > 0 THEN 'BUY' WHEN mo < 0 THEN 'SELL' ELSE 'HOLD' END AS side, round(want, 6) + 0.0 AS target_value, round(val, 6) + 0.0 AS current_value, CAST(CASE WHEN blk <> '' OR idle OR small THEN 0 ELSE n * sign(mo) END AS BIGINT) AS order_shares, round(CASE WHEN blk <> '' THEN 0 WHEN idle THEN mo WHEN small THEN 0 ELSE n * price * sign(mo) END, 6) + 0.0 AS order_value, CASE WHEN blk = '' AND small THEN 'small_order_filtered' ELSE blk END AS blocked_reason FROM fi")
def sig_rebalance_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = day(spark, sf_dir)
    lots = (C("code") % 5 + 1) * 300
    positions = d.where("code % 2 = 0").select("code", lots.alias("shares"), F.when(C("code") % 6 == 0, 0).otherwise(lots).alias("available"), C("close").alias("last_price"), "can_sell", "is_suspended", "is_limit_down_close")
    return G.rebalance(G.target_holdings(d, 20, 5, 0.2, 0.2), positions, 5_000_000, 200_000, least_value=1000)


@query(IC + """, rn AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY factor) AS n FROM ic WHERE ic IS NOT NULL), hp AS (SELECT factor, avg(CASE WHEN rn <= least(n, 42) THEN ic END) AS r, avg(CASE WHEN rn > least(n, 42) OR rn = n THEN ic END) AS p FROM rn GROUP BY factor),
hr AS (SELECT *, CASE WHEN abs(p) < 1e-6 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END ELSE r / p END AS q FROM hp), hs AS (SELECT *, greatest(0, least(100, q * 100)) AS h FROM hr)
SELECT factor, round(r, 6) + 0.0 AS recent_ic, round(p, 6) + 0.0 AS past_ic, round(h, 6) + 0.0 AS health_score, CASE WHEN q >= 1 THEN 'improving' WHEN q >= 0.5 THEN 'stable' ELSE 'declining' END AS ic_trend, CASE WHEN h >= 70 THEN 'healthy' WHEN h >= 40 THEN 'warning' ELSE 'critical' END AS status, CASE WHEN h >= 70 THEN 'keep' WHEN h >= 40 THEN 'review' ELSE 'consider_remove' END AS recommendation FROM hs""")
def sig_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.health(R.daily_ic(long(spark, sf_dir)), months=2)


@query(BASE + f", bo AS (SELECT factor_a AS x, factor_b AS y FROM b WHERE factor_a IS NOT NULL AND factor_b IS NOT NULL), rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS c FROM bo) SELECT 'factor_b' AS name, round(abs(corr(a, c)), 6) AS corr, abs(corr(a, c)) <= 0.7 AS admitted FROM rk")
def sig_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    return G.admit(b.select("date", "code", C("factor_a").alias("value")), b.select(F.lit("factor_b").alias("name"), "date", "code", C("factor_b").alias("value")))


@query(DAY + """, al AS (SELECT code, score AS x, CASE WHEN code % 3 <> 0 THEN close END AS y FROM dy), r AS (SELECT * FROM al WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, row_number() OVER (ORDER BY x DESC, code) AS tx, row_number() OVER (ORDER BY y DESC, code) AS ty, row_number() OVER (ORDER BY x, code) AS bx, row_number() OVER (ORDER BY y, code) AS bys, least(5, count(*) OVER ()) AS kk FROM r),
ms AS (SELECT avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END) AS mx, avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0 END) AS my FROM al)
SELECT count(*) AS pairs, round(corr(rx, ry), 6) + 0.0 AS spearman, count(*) FILTER (tx <= kk AND ty <= kk) / CAST(max(kk) AS DOUBLE) AS top_overlap, count(*) FILTER (bx <= kk AND bys <= kk) / CAST(max(kk) AS DOUBLE) AS bottom_overlap, round(max(mx), 6) + 0.0 AS missing_x, round(max(my), 6) + 0.0 AS missing_y, round(abs(max(mx) - max(my)), 6) + 0.0 AS missing_delta FROM k CROSS JOIN ms""")
def sig_compare_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = day(spark, sf_dir)
    return G.compare_sections(d.select("code", C("score").alias("value")), d.select("code", F.when(C("code") % 3 != 0, C("close")).alias("value")), 5)


@query("SELECT name, bool_or(a) AS in_a, bool_or(b) AS in_b FROM (SELECT * FROM (SELECT CAST(p_partkey AS VARCHAR) AS name, true AS a, false AS b FROM part ORDER BY p_size DESC, name LIMIT 20) UNION ALL SELECT * FROM (SELECT CAST(p_partkey AS VARCHAR) AS name, false, true FROM part ORDER BY p_retailprice DESC, name LIMIT 20)) GROUP BY name")
def sig_run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    return G.run_overlap(m.select("name", C("a").alias("score")), m.select("name", C("b").alias("score")), 20)


@query("SELECT p_name AS name, p_size AS size FROM part WHERE lower(p_name) LIKE '%a%' OR lower(p_brand) LIKE '%a%' ORDER BY p_size DESC, p_name LIMIT 15 OFFSET 5")
def sig_factor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a factor list: its limit is the feature."""
    p = read(spark, sf_dir, "part").select(C("p_name").alias("name"), C("p_brand").alias("expression"), C("p_size").alias("size"))
    return G.page(p, "a", "size", True, 5, 15).select("name", "size")


