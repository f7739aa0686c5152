"""A lake of partitioned Parquet tables: scans, upserts, snapshots, coverage and quality."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, expected: T.StructType | str | None = None) -> DataFrame:
    """All files below a path by column name; expected columns that are missing are typed NULLs, a path that isn't there is an empty table.

    A file that cannot be read is an error: an upsert that left it out would erase its rows.
    """
    from pyspark.errors import AnalysisException

    wanted = spark.createDataFrame([], expected).schema if expected is not None else T.StructType([])
    try:
        df = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", False).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA") or expected is None or any_file(spark, path):
            raise
        return spark.createDataFrame([], wanted)
    have = {c.lower(): c for c in df.columns}
    extra = [c for c in df.columns if c not in wanted.fieldNames()]
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted], *[F.col(f"`{c}`") for c in extra])


def any_file(spark: SparkSession, path: str) -> bool:
    """Whether there is a data file below a path, on whatever file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_snapshot(df: DataFrame, keys: Sequence[str], snapshot: str = "snapshot_date") -> DataFrame:
    return latest(df, keys, [F.col(snapshot).desc_nulls_last()])


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Old and new rows, the new ones winning; a key may be NULL.

    Among new rows of one key the first by ``order`` wins, then the greatest of their
    other columns, so the result doesn't depend on how rows arrive.
    """
    kinds = dict(new.dtypes)
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c not in keys and not kinds[c].startswith(("map", "variant"))]
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_age").desc(), *order, *rest]).drop("_age")


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], date: str, mode: str = "upsert", order: Sequence[Column] = ()) -> None:
    """Write rows into month partitions; only months that ``new`` touches are read and replaced."""
    parts = {"year": F.year(date), "month": F.month(date)}
    new = new.withColumns(parts)
    touched = new.select("year", "month").distinct()
    if mode == "upsert":
        old = scan(spark, path, new.schema)
        # A month partition is small; the list of touched months is smaller still.
        new = merged(old.join(F.broadcast(touched), ["year", "month"], "left_semi"), new, keys, order)
    # The result is written aside first: it reads what it replaces.
    aside = f"{path.rstrip('/')}__staged"
    new.write.mode("overwrite").partitionBy("year", "month").parquet(aside)
    spark.read.schema(new.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_range(spark: SparkSession, path: str, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A date range; whole months outside it aren't opened."""
    df = spark.read.parquet(path)
    month = F.col("year") * 12 + F.col("month")
    for bound, op in ((start, "ge"), (end, "le")):
        if bound:
            y, m = (int(x) for x in bound.split("-")[:2])
            df = df.where((month >= y * 12 + m) if op == "ge" else (month <= y * 12 + m)).where((F.col(date) >= bound) if op == "ge" else (F.col(date) <= F.lit(bound).cast("date")))
    return df


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    df.withColumn("snapshot_date", F.lit(day).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def compact(spark: SparkSession, path: str, out: str, files: int = 1) -> None:
    """One file (or a few) a partition."""
    df = spark.read.parquet(path)
    df.withColumn("_deal", (F.rand(7) * files).cast("int")).repartition("year", "month", "_deal").drop("_deal").write.mode("overwrite").partitionBy("year", "month").parquet(out)


def advance(state: Mapping[str, str], table: str, day: str, rewind: bool = False) -> dict[str, str]:
    """The ingestion state after a table has been read up to a day; it only moves forward unless told so."""
    if table in state and state[table] > day and not rewind:
        raise ValueError(f"{table} is at {state[table]}, past {day}")
    return {**state, table: day}


def save_state(spark: SparkSession, state: Mapping[str, str], path: str) -> None:
    spark.createDataFrame([(json.dumps(dict(state), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads(spark.read.text(path).first()[0])


def coverage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(field, rows, present, finite, rate) in one pass over all fields."""
    kinds = dict(df.dtypes)
    numeric = lambda c: F.abs(F.col(c).cast("double")) < float("inf") if kinds[c] not in ("string", "date", "timestamp", "boolean") else F.col(c).isNotNull()
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"p_{c}") for c in names], *[F.count_if(numeric(c)).alias(f"f_{c}") for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("_n").alias("rows"), F.col(f"p_{c}").alias("present"), F.col(f"f_{c}").alias("finite"), F.try_divide(f"f_{c}", "_n").alias("rate")) for c in names])).alias("x")).select("x.*")


def quality(df: DataFrame, names: Sequence[str], date: str, code: str, least_rate: float = 0.9, warn_rate: float = 0.5) -> DataFrame:
    """Coverage with pass, warn or fail, and the panel's dates and codes."""
    size = df.agg(F.count_distinct(date).alias("dates"), F.count_distinct(code).alias("codes"))
    status = F.when(F.col("rate") >= least_rate, "pass").when(F.col("rate") >= warn_rate, "warn").otherwise("fail")
    return coverage(df, names).withColumn("status", status).crossJoin(F.broadcast(size))  # size is one row


def last_present(df: DataFrame, names: Sequence[str], date: str) -> DataFrame:
    """(field, latest): the latest date on which each field has a value."""
    one = df.agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("latest")) for c in names])).alias("x")).select("x.*")


def field_catalog(df: DataFrame, roles: Mapping[str, str] | None = None, leaky: Sequence[str] = ("future", "next_", "target", "label")) -> DataFrame:
    """One row a column: type, role, category, whether expressions may use it."""
    rows = []
    for f in df.schema.fields:
        kind = "group" if isinstance(f.dataType, T.StringType) else "vector" if isinstance(f.dataType, T.ArrayType) else "scalar" if isinstance(f.dataType, T.NumericType) else "other"
        safe = not any(x in f.name.lower() for x in leaky)
        rows.append((f.name, f.dataType.simpleString(), kind, (roles or {}).get(f.name, "feature"), safe, safe and kind != "other"))
    return df.sparkSession.createDataFrame(rows, "field string, type string, category string, role string, leakage_safe boolean, searchable boolean")
