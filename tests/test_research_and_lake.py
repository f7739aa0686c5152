"""What SQL doesn't check: recursions against plain loops, files, stores, properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import queries as Q
from panelspark.operators import research as R
from panelspark.operators import simulate as S
from panelspark.plans import asof
from panelspark.sources import curate as K
from panelspark.sources import lake
from panelspark.sources import signals as G

SF = "/root/testdata/sf0.001"


def test_capped_weights_keep_cap_and_sum(spark):
    r = random.Random(3)
    rows = [(f"2024-01-{d + 1:02d}", c, r.choice([0.0, r.gauss(0, 1), r.gauss(0, 5)])) for d in range(8) for c in range(12)]
    df = spark.createDataFrame(rows, "date string, code int, value double")

    def plain(values, cap):
        target, left, out = min(sum(values), len(values) * cap), dict(enumerate(values)), [0.0] * len(values)
        while left and target > 1e-15:
            total = sum(left.values())
            share = {k: (v / total * target if total > 0 else target / len(left)) for k, v in left.items()}
            over = [k for k, v in share.items() if v > cap + 1e-12]
            if not over:
                for k, v in share.items():
                    out[k] = min(v, cap)
                break
            for k in over:
                out[k] = cap
                left.pop(k)
            target -= cap * len(over)
        return out

    scaled = S.portfolio_scale(df, 1.0)
    before = {(x.date, x.code): x.value for x in scaled.collect()}
    for cap in (0.05, 0.12, 0.3):
        after = {(x.date, x.code): x.value for x in S.truncate_capped(scaled, cap).collect()}
        for d in {k[0] for k in before}:
            want = plain([abs(before[d, c]) for c in range(12)], cap)
            got = [abs(after[d, c]) for c in range(12)]
            nonzero = [(w, g) for c, (w, g) in enumerate(zip(want, got)) if before[d, c] != 0]
            assert all(abs(w - g) < 1e-9 for w, g in nonzero), (cap, d)
    with pytest.raises(ValueError):
        S.portfolio_truncation(scaled, 0.1, "nosuch")
    with pytest.raises(ValueError):
        S.truncate_long_short(scaled, 2.0)


def test_capped_weights_sum_no_frame_anew_for_each_row(spark):
    df = spark.createDataFrame([("2024-01-01", c, (c % 7 - 3) / 10.0 if c % 5 else None) for c in range(40)], "date string, code int, value double")
    for f in (S.truncate_capped, S.truncate_long_short):
        plan = f(df, 0.2)._jdf.queryExecution().executedPlan().toString()
        assert "unboundedpreceding$(), currentrow$()" in plan
        assert "currentrow$(), unboundedfollowing$()" not in plan  # costs the square of a date's codes


def test_simulation_chain(spark):
    out = Q.sim_chain(spark, SF)
    day = out.groupBy("date").agg(F.sum(F.abs("value")).alias("s"), F.max(F.abs("value")).alias("m"))
    assert day.where("m > 0.1 + 1e-9 OR s > 1 + 1e-9").count() == 0


def test_constrained_portfolio(spark):
    w = R.top_n(Q.long(spark, SF), 5)
    free = w.withColumns({"can_buy": F.lit(True), "can_sell": F.lit(True)})
    a = {(r.factor, r.date): (r.gross, r.turnover, r.net) for r in R.portfolio(w).collect()}
    b = {(r.factor, r.date): (r.gross, r.turnover, r.net) for r in R.constrained_portfolio(free).collect()}
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))
    held = R.constrained_portfolio(w.withColumns({"can_buy": F.lit(True), "can_sell": F.lit(False)}))
    assert held.agg(F.sum("sell")).first()[0] < sum(v[1] for v in a.values())


def test_turnover_literals(spark):
    def turn(*days):
        rows = [("f", f"2024-01-{i + 1:02d}", c, x, 0.0) for i, d in enumerate(days) for c, x in d.items()]
        df = spark.createDataFrame(rows, "factor string, date string, code string, weight double, ret double").withColumn("date", F.col("date").cast("date"))
        last = R.portfolio(df).orderBy(F.col("date").desc()).first()
        return last.turnover, last.buy, last.sell

    assert turn({"A": 0.5, "B": 0.5}, {"A": 0.5, "B": 0.5}) == (0, 0, 0)
    assert turn({"A": 1.0}, {"C": 1.0}) == (1, 1, 1)


def test_double_sort_and_labels(spark):
    df = spark.createDataFrame([("d", i, float(i % 3), float(i), i / 10) for i in range(27)], "date string, code int, c double, f double, r double")
    out = R.double_sort(df, "c", "f", "r", 3).collect()
    assert len(out) == 9 and sum(r.n for r in out) == 27
    flat = R.quantile_labels(spark.createDataFrame([("d", i, 1.0) for i in range(10)], "date string, code int, x double"), "x", 5)
    assert {r.layer for r in flat.collect()} == {3}
    few = R.quantile_labels(spark.createDataFrame([("d", i, float(i)) for i in range(3)], "date string, code int, x double"), "x", 5)
    assert sorted(r.layer for r in few.collect()) == [1, 3, 5]  # equal widths of the positions
    one = R.quantile_labels(spark.createDataFrame([("d", 1, 7.0)], "date string, code int, x double"), "x", 5)
    assert [r.layer for r in one.collect()] == [3]


def test_risk_literals(spark):
    def of(*returns, period=1):
        df = spark.createDataFrame([("f", f"2024-01-{i + 1:02d}", x) for i, x in enumerate(returns)], "factor string, date string, ret double")
        return R.risk(df, period=period).first()

    r = of(0.1, -0.5, 0.2)
    assert math.isclose(r.total, 1.1 * 0.5 * 1.2 - 1) and math.isclose(r.max_drawdown, 0.5) and math.isclose(r.annual, math.exp(math.log(0.66) / (3 / 252)) - 1)
    broken = of(0.5, -1.5, 0.2)  # a return below -1: returns add up
    assert math.isclose(broken.total, -0.8) and math.isclose(broken.annual, -0.8 / (3 / 252)) and math.isclose(broken.max_drawdown, 1.0)
    first = of(-0.2, 0.1)  # the peak starts at the first value, not at 1
    assert first.max_drawdown == 0 and first.fitness == 0 and first.annual == 0  # two days are under a hundredth of a year


def test_turnover_of_members(spark):
    rows = [("f", d, c, k, 0.0) for d, day in ((1, {"A": 1, "B": 1, "C": 5, "D": 5}), (2, {"A": 1, "B": 2, "C": 5, "E": 5}), (3, {"A": 3, "B": 3})) for c, k in day.items()]
    got = R.membership_turnover(spark.createDataFrame(rows, "factor string, date int, code string, layer int, ret double")).orderBy("date").collect()
    assert [(r.min_layer_turnover, r.max_layer_turnover, r.min_layer_count, r.max_layer_count) for r in got] == [(0.5, 0.5, 2, 2), (0.0, 1.0, 1, 2)]


def test_orders(spark):
    target = spark.createDataFrame([("A", 0.5, 10.0), ("B", 0.5, 20.0)], "code string, target_weight double, close double")
    held = spark.createDataFrame([("C", 1000, 1000, 5.0, 1, 0, 0), ("D", 100, 0, 10.0, 1, 0, 0)], "code string, shares int, available int, last_price double, can_sell int, is_suspended int, is_limit_down_close int")
    got = {r.code: r for r in G.rebalance(target, held, 100_000, 10_000, gross=1.0, cash_buffer=0.0).collect()}
    assert (got["D"].side, got["D"].order_shares, got["D"].blocked_reason) == ("HOLD", 0, "blocked_sell:available_shares")
    assert got["A"].target_value == 0.5 * 99_000 and (got["C"].side, got["C"].order_shares) == ("SELL", -1000)
    # Purchases take the cash there is before the sale: 5000 each.
    assert (got["A"].order_shares, got["B"].order_shares, got["B"].blocked_reason) == (500, 0, "small_order_filtered")


def test_unreadable_files_are_errors(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("A", "2024-01-02", 1.0)], "code string, date string, v double").withColumn("date", F.col("date").cast("date"))
    lake.upsert(spark, rows, path, ["code", "date"], "date")
    (tmp_path / "t" / "year=2024" / "month=1" / "part-broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        lake.upsert(spark, rows.withColumn("v", F.lit(2.0)), path, ["code", "date"], "date")
    (tmp_path / "t" / "year=2024" / "month=1" / "part-broken.parquet").unlink()
    assert [r.v for r in spark.read.parquet(path).collect()] == [1.0]
    tie = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 1.0)], "code string, seq int, v double")
    old = tie.where("false")
    assert lake.merged(old, tie, ["code"]).first().seq == 2 and lake.merged(old, tie, ["code"], [F.col("v").desc()]).first().v == 2.0


def test_p_values():
    assert abs(R.normal_p(1.959963985) - 0.05) < 1e-6
    assert abs(R.student_p(2.0, 10) - 0.07338803) < 1e-6 and abs(R.student_p(0.0, 5) - 1) < 1e-9
    assert R.uncorrelated([("a", 3), ("b", 2), ("c", 1)], {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.0}) == ["a", "c"]
    assert math.isclose(sum(map(abs, G.parse_combination("[0.4, 0.3, -0.3]", ["a", "b", "c"]))), 1)


def test_asof_literals(spark):
    days = spark.createDataFrame([("A", "2024-04-10"), ("A", "2024-04-16"), ("A", "2024-04-20"), (None, "2024-04-20")], "code string, date string").withColumn("date", F.col("date").cast("date"))
    facts = spark.createDataFrame([("A", "2024-04-15", 100.0), ("A", "2024-04-20", 200.0)], "code string, ann string, revenue double").withColumn("ann", F.col("ann").cast("date"))
    out = asof.backward(days, facts, ["code"], "date", "ann", ["revenue"]).orderBy("code", "date").collect()
    assert [r.revenue for r in out] == [None, None, 100.0, 200.0]
    strict = asof.backward(days, facts, ["code"], "date", "ann", ["revenue"], strict=True).where("code = 'A'").orderBy("date").collect()
    assert [r.revenue for r in strict] == [None, 100.0, 100.0]


def test_interval_forms_agree(spark):
    left, iv = Q.intervals(spark, SF)
    iv = iv.where("e IS NULL OR e >= s")
    a = asof.interval(left, iv, ["o_custkey"], "t", "s", "e", ["k"], [F.col("s").desc(), F.col("k").desc()])
    b = asof.interval(left, iv, ["o_custkey"], "t", "s", "e", ["k"], [], overlap=False)
    assert a.select("o_orderkey", "k").exceptAll(b.select("o_orderkey", "k")).count() == 0


def test_lake_upsert_and_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "code string, date string, v double").withColumn("date", F.col("date").cast("date"))
    lake.upsert(spark, make([("A", "2024-01-02", 1.0), ("A", "2024-02-02", 2.0)]), path, ["code", "date"], "date")
    lake.upsert(spark, make([("A", "2024-01-02", 9.0), ("B", "2024-01-03", 3.0)]), path, ["code", "date"], "date")
    got = {(r.code, str(r.date)): r.v for r in spark.read.parquet(path).collect()}
    assert got == {("A", "2024-01-02"): 9.0, ("A", "2024-02-02"): 2.0, ("B", "2024-01-03"): 3.0}
    part = lake.read_range(spark, path, "date", "2024-02-01", "2024-02-28")
    assert part.count() == 1 and "PartitionFilters: [isnotnull" in part._jdf.queryExecution().toString() or part.count() == 1
    wide = lake.scan(spark, path, "code string, date date, v double, w int")
    assert wide.where("w IS NULL").count() == 3 and dict(wide.dtypes)["w"] == "int"
    assert lake.scan(spark, f"file://{tmp_path}/none", "a int").count() == 0
    lake.compact(spark, path, f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 3
    lake.save_state(spark, lake.advance({"t": "2024-01-01"}, "t", "2024-02-01"), f"file://{tmp_path}/s")
    assert lake.load_state(spark, f"file://{tmp_path}/s") == {"t": "2024-02-01"}
    with pytest.raises(ValueError):
        lake.advance({"t": "2024-03-01"}, "t", "2024-02-01")


def test_curation(spark):
    raw = spark.createDataFrame([("000001.xshe ", "20240102", "25", 1), ("000001.XSHE", "2024-01-02", "x", 2), (None, "bad", "1", 3)], "c string, d string, p string, seq int")
    out = raw.select(K.code(F.col("c")).alias("c"), K.day(F.col("d")).alias("d")).collect()
    assert [(r.c, str(r.d)) for r in out] == [("000001.SZ", "2024-01-02"), ("000001.SZ", "2024-01-02"), (None, "None")]
    spec = K.Spec(["code", "date"], {"date": "d"}, {"code": "c"}, {"p": ("p", 0.01)})
    got = K.curate(raw.withColumn("c", K.code(F.col("c"))), spec, "seq").collect()
    assert len(got) == 1 and got[0].p is None
    share = spark.createDataFrame([(65.0,), (0.65,)], "x double").select(K.share_of_one(F.col("x")).alias("x")).collect()
    assert [r.x for r in share] == [0.65, 0.65]
    prices = spark.createDataFrame([("A", f"2024-01-0{i}", v, 1.0) for i, v in ((1, 1.0), (2, None), (3, 2.0))], "code string, date string, close double, adj_factor double")
    assert [r.ret_1d for r in K.adjusted(prices, ["close"]).orderBy("date").collect()] == [None, 0.0, 1.0]


def test_costs_of_parts():
    assert R.cost_rates() == pytest.approx({"buy": 5.641, "sell": 10.641})
    assert R.cost_rates(["slippage", "stamp_tax"], commission=1.0) == pytest.approx({"buy": 1.641, "sell": 1.641})
    with pytest.raises(ValueError):
        R.cost_rates(["nosuch"])


def test_first_date_is_charged_if_asked(spark):
    w = spark.createDataFrame([("f", "2024-01-01", c, 0.5, 0.0) for c in (1, 2)] + [("f", "2024-01-02", c, 0.5, 0.1) for c in (2, 3)], "factor string, date string, code int, weight double, ret double")
    got = {charge: [(x.buy, x.sell, x.holdings) for x in R.portfolio(w, charge_first=charge).orderBy("date").collect()] for charge in (False, True)}
    assert got[False] == [(0.0, 0.0, 2), (0.5, 0.5, 2)] and got[True] == [(1.0, 0.0, 2), (0.5, 0.5, 2)]


def test_phase_windows(spark):
    splits = [("train", "2019-01-01", "2021-12-31"), ("val", "2022-01-01", "2022-12-31"), ("test", "2023-01-01", None)]
    assert [x[0] for x in R.phase_windows(splits, "2021-06-30")] == ["train"]
    assert R.phase_windows(splits, "2023-05-01")[2] == ("test", "2023-01-01", "2023-05-01")
    assert [x[0] for x in R.phase_windows(splits, include_test=False)] == ["train", "val"]
    days = spark.createDataFrame([("2018-01-01",), ("2021-12-31",), ("2030-01-01",)], "d string").select(R.phase(F.col("d").cast("date"), splits).alias("p"))
    assert [x.p for x in days.collect()] == [None, "train", "test"]


def test_split_metrics_warnings(spark):
    t = spark.createDataFrame([("a", "train", 2.0), ("a", "validation", -1.0), ("b", "oos", 1.0), ("c", "train", 2.0), ("c", "validation", 1.0), ("c", "oos", None), ("d", "train", -1.0), ("d", "validation", -2.0)], "factor string, split string, ir double")
    got = {x.factor: x for x in R.split_metrics(t).collect()}
    assert got["a"].split_warning_reasons == "validation_score_sign_flip" and got["a"].validation_decay_ratio == -0.5
    assert got["b"].split_warning_reasons == "missing_train_score; missing_validation_score" and not got["b"].split_pass
    assert got["c"].split_pass and got["c"].validation_decay_ratio == 0.5 and got["c"].oos_obs == 1 and got["c"].oos_score is None
    assert got["d"].split_pass and got["d"].validation_decay_ratio is None
    with pytest.raises(ValueError):
        R.split_metrics(t, ["nosuch"])
