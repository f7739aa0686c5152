import random

from pyspark.sql import functions as F

from panelspark.plans import generate as G
from panelspark.plans.language import parse, text_of
from panelspark.plans.panel import evaluate
from panelspark.plans.queries import supplier_panel
from panelspark.streaming.ingest import upsert_stream

KINDS = {"close": "s", "volume": "s", "disc": "s", "nation": "g", "parts": "v"}


def test_templates():
    assert G.search_space(["rank({f})", "ts_mean({f}, {w})", "x({none})"], {"f": ["a", "b"], "w": [5]}) == ["rank(a)", "rank(b)", "ts_mean(a, 5)", "ts_mean(b, 5)"]


def test_random_expressions_run(spark):
    r = random.Random(5)
    made = [text_of(G.random_expression(r, KINDS, 2)) for _ in range(12)]
    kept = G.Prefilter(KINDS).keep(made)
    assert kept and evaluate(supplier_panel(spark, "/root/testdata/sf0.001"), kept).count() > 0


def test_prefilter():
    f = G.Prefilter(KINDS)
    assert f.keep(["rank(close)", "rank( close )", "sub(close, close)", "rank(next_ret)", "rank(", "ts_mean(close, volume)", "rank(nation)", "rank(nosuch)"]) == ["rank(close)"]
    assert f.rejected == {"seen": 1, "degenerate": 1, "leakage": 1, "parse": 1, "type": 2, "field": 1}


def test_mutation_and_choice():
    near = {text_of(x) for x in G.mutations(parse("rank(ts_mean(close, 10))"), {"price": ["close", "volume"]})}
    assert {"rank(ts_mean(close, 5))", "rank(ts_mean(volume, 10))", "zscore(ts_mean(close, 10))", "rank(ts_median(close, 10))"} <= near
    child = G.crossover(parse("rank(ts_mean(close, 10))"), parse("zscore(ts_std_dev(volume, 5))"), random.Random(1), KINDS)
    assert child is not None and G.result_type(child, KINDS) == "s"
    assert G.fragments(["rank(ts_mean(close, 5))", "zscore(ts_mean(close, 5))"])[0] == ("ts_mean(close, 5)", 2)
    chosen = G.rank_candidates([("a", 3, "x"), ("b", 2, "x"), ("c", 1, "y")], 2, explore=0.0)
    assert chosen == ["a", "c"]


def test_feedback(spark):
    df = spark.createDataFrame([("rank(close)", 3.0), ("rank(volume)", 1.0), ("zscore(close)", 2.0), ("zscore(volume)", 0.0)], "expression string, score double")
    w = {r.token: r.weight for r in G.feedback_weights(df, 0.5).collect()}
    assert w["close"] == 2.0 and w["volume"] == 0.0


def test_stream_upserts(spark, tmp_path):
    src, lake, seen = tmp_path / "in", f"file://{tmp_path}/lake", []
    make = lambda rows: spark.createDataFrame(rows, "code string, date string, v double").withColumn("date", F.col("date").cast("date"))
    for k, rows in enumerate(([("A", "2024-01-02", 1.0)], [("A", "2024-01-02", 5.0), ("B", "2024-02-02", 2.0)])):
        make(rows).coalesce(1).write.mode("append").parquet(str(src))
        q = upsert_stream(spark.readStream.schema("code string, date date, v double").parquet(str(src)), lake, ["code", "date"], "date", f"{tmp_path}/cp", lambda d: seen.append(d.count()), 3)
        q.awaitTermination(120)
    assert sorted((r.code, r.v) for r in spark.read.parquet(lake).collect()) == [("A", 5.0), ("B", 2.0)]
    assert seen == [1, 2]
