"""Operators against literal values, the planner's plans, and all SQL at the smallest size."""

import math
import re

import duckdb
import pytest

from panelspark.operators import queries as operators
from panelspark.operators.registry import REGISTRY
from panelspark.plans import language as L
from panelspark.plans import queries as plans
from panelspark.plans.panel import Panel, evaluate
from panelspark.sources import queries as sources

SF = "/root/testdata/sf0.001"
N = None


def series(spark, expression, **columns):
    n = len(next(iter(columns.values())))
    names = list(columns)
    rows = [(f"2024-01-{i + 1:02d}", "A", *(columns[c][i] for c in names)) for i in range(n)]
    kinds = ", ".join(f"{c} {'string' if any(isinstance(v, str) for v in columns[c]) else 'double'}" for c in names)
    out = evaluate(Panel.of(spark.createDataFrame(rows, f"date string, code string, {kinds}")), {"v": expression}).orderBy("date").collect()
    return [r.v for r in out]


def section(spark, expression, **columns):
    """One date, one code a value."""
    names = list(columns)
    rows = [("2024-01-01", f"{i:02d}", *(columns[c][i] for c in names)) for i in range(len(columns[names[0]]))]
    kinds = ", ".join(f"{c} {'string' if any(isinstance(v, str) for v in columns[c]) else 'double'}" for c in names)
    out = evaluate(Panel.of(spark.createDataFrame(rows, f"date string, code string, {kinds}")), {"v": expression}).orderBy("code").collect()
    return [r.v for r in out]


def same(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-9) for x, y in zip(a, b))


X = [1.0, 3.0, N, 2.0, 4.0]


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("ts_min(x, 3)", [1, 1, 1, 2, 2]),
        ("ts_max(x, 3)", [1, 3, 3, 3, 4]),
        ("ts_median(x, 3)", [1, 2, 2, 2.5, 3]),
        ("ts_count_nans(x, 3)", [0, 0, 1, 1, 1]),
        ("ts_product(x, 3)", [1, 7, N, N, N]),
        ("ts_backfill(x, 1)", [1, 3, 3, 2, 4]),
        ("ts_backfill(x, 0)", X),
        ("_ewm(x, 0.5)", [1, 2, 2, 2, 3]),
        ("ts_covariance(x, x + 0, 3)", [N, 2, 2, 0.5, 2]),
        ("x > 0", [True, True, False, True, True]),
        ("x != 1", [False, True, True, True, True]),
        ("days_from_last_change(sign(x))", [0, 1, 0, 0, 1]),
        ("power(x, 0)", [1, 1, 1, 1, 1]),
        ("ts_delta(x, 1)", [N, 2, N, N, 2]),
    ],
)
def test_series(spark, expression, expected):
    assert same(series(spark, expression, x=X), expected)


def test_recursions_and_events(spark):
    assert same(series(spark, "hump(x, 0.2)", x=[0.0, 0.1, 0.4, 0.35, N, 0.9]), [0, 0, 0.2, 0.2, 0.2, 0.4])
    entry, exit_, alpha = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0, 1.0], [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    assert same(series(spark, "trade_when_hold(e > 0, a, x > 0)", e=entry, x=exit_, a=alpha), [10, 10, N, 40, 40, N])
    assert series(spark, "ts_arg_max(x, 6)", x=[4.0, 9.0, 5.0, 8.0, 2.0, 6.0])[-1] == 4
    assert series(spark, "ts_arg_min(x, 6)", x=[4.0, 9.0, 5.0, 8.0, 2.0, 6.0])[-1] == 1
    assert same(series(spark, "x % 3", x=[-5.0, 5.0]), [1, 2])


def test_sections(spark):
    assert same(section(spark, "rank(x)", x=[1.0, 2.0, 2.0, N]), [1 / 3, 2.5 / 3, 2.5 / 3, N])
    assert same(section(spark, "quantile(x, 'uniform')", x=[-2.0, -1.0, 1.0, 2.0]), [0.25, 0.5, 0.75, 1])
    assert same(section(spark, "group_median(x, g)", x=[1.0, 3.0, 2.0, 6.0], g=["a", "a", "b", "b"]), [2, 2, 4, 4])
    assert same(section(spark, "group_scale(x, g)", x=[1.0, 3.0, 2.0, 6.0], g=["a", "a", "b", "b"]), [0.25, 0.75, 0.25, 0.75])
    assert section(spark, "bucket(x, '0,1,0.2')", x=[0.0, 0.2, 0.20001, 0.99, 1.0, 1.1, -0.1, N]) == ["0", "0", "1", "4", "4", N, N, N]
    for bad in ("bad", "0,1,0", "1,0,0.2", "0,1"):
        assert section(spark, f"bucket(x, '{bad}')", x=[0.5, 1.0]) == [N, N]
    assert section(spark, "group_cartesian_product(g, h)", g=["bank", N, "tech"], h=["0", "1", N]) == ["bank__0", N, N]
    assert same(section(spark, "truncate(x, 1.5)", x=[-2.0, N, 2.0]), [-1.5, N, 1.5])
    assert same(section(spark, "divide(x, y)", x=[1.0, 1.0], y=[0.0, 1e-14]), [N, N])
    assert same(section(spark, "log(x)", x=[-1.0, 0.0, 4.0]), [N, N, math.log(4)])
    assert same(section(spark, "max(x, y)", x=[1.0, N], y=[N, 2.0]), [N, N])
    assert same(section(spark, "zscore(x)", x=[3.0, 3.0, 3.0]), [N, N, N])


def test_vectors_and_repeats(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 1.0, 3.0, 1), ("2024-01-01", "A", 5.0, N, 2), ("2024-01-02", "B", 2.0, N, 1)], "date string, code string, e__0 double, e__1 double, seq int")
    out = evaluate(Panel.of(df, order="seq"), {"a": "vec_avg(e)", "n": "vec_count(e)", "s": "vec_sum(e)"}).orderBy("date", "code").collect()
    assert [(r.code, r.a, r.n, r.s) for r in out] == [("A", 4.0, 2.0, 8.0), ("B", N, 0.0, N), ("A", N, 0.0, N), ("B", 2.0, 1.0, 2.0)]


def test_property_neutral_groups_sum_to_zero(spark):
    p = plans.supplier_panel(spark, SF)
    out = evaluate(p, {"v": "group_neutralize(close, nation)", "r": "rank(close)"}).join(p.df.select("date", "code", "nation"), ["date", "code"])
    assert out.groupBy("date", "nation").sum("v").where("abs(`sum(v)`) > 1e-6").count() == 0
    assert out.where("r <= 0 OR r > 1").count() == 0


def test_language():
    assert L.text_of(L.canonical(L.parse("add(b, subtract(a, c))"))) == "add(b, sub(a, c))"
    assert L.structural_hash(L.parse("add(a,b)")) == L.structural_hash(L.parse("add( b, a )"))
    assert L.canonical(L.parse("ts_delay(mul(x, 1), 0)")) == L.Field("x")
    assert L.degenerate(L.parse("sub(x, x)")) and not L.degenerate(L.parse("sub(x, y)"))
    assert L.lookback(L.parse("ts_mean(ts_delay(x, 3), 5)")) == 7 and L.lookback(L.parse("hump(x)")) is None
    assert L.statistics(L.parse("rank(ts_mean(close, 4)) + volume"))["operators"] == 3
    for bad in ("a and b", "x[0]", "a.b", "lambda: 1", "1 < x < 2", "f(**k)", "(", "a if b else c"):
        with pytest.raises(L.ExpressionError):
            L.parse(bad)


def test_errors(spark):
    p = Panel.of(spark.createDataFrame([("2024-01-01", "A", 1.0)], "date string, code string, x double"))
    for text, kind in (("nosuch(x)", KeyError), ("nofield + 1", KeyError), ("ts_mean(x)", TypeError), ("ts_mean(x, x)", TypeError), ("quantile(x, 'cubic')", ValueError)):
        with pytest.raises(kind):
            evaluate(p, [text]).collect()


def test_registry_has_all_names():
    names = {n for n in REGISTRY if n.isidentifier() and not n.startswith("_") and n != "neg"}
    assert len(names) == 84


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_siblings_share_a_shuffle(spark):
    p = Panel.of(spark.range(100).selectExpr("date_add(DATE'2024-01-01', CAST(id % 10 AS INT)) AS date", "id % 7 AS code", "rand(1) AS x", "rand(2) AS y"), dense=False)
    one = exchanges(evaluate(p, {"a": "ts_mean(x, 3)"}))
    many = exchanges(evaluate(p, {"a": "ts_mean(x, 3)", "b": "ts_sum(y, 5)", "c": "ts_corr(x, y, 4)", "d": "ts_delta(x, 2)"}))
    assert many == one
    assert exchanges(evaluate(p, {"a": "rank(ts_mean(x, 3))", "b": "zscore(ts_sum(y, 3))"})) <= one + 2


def rows(cursor, names):
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    return sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


PARTS = {**plans.SQL, **operators.SQL, **sources.SQL}
RUNS = {**plans.QUERIES, **operators.QUERIES, **sources.QUERIES}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_against_sql(spark, db, name):
    df = RUNS[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == rows(db.execute(PARTS[name]), names)
