"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='panelspark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str = "table", fmt: str = "parquet", **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there,
    so a lost executor costs no more than the tasks it was running."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def small_table(spark: SparkSession, rows: Iterable[Sequence], columns: Sequence[tuple[str, pa.DataType]]) -> DataFrame:
    """A few rows of the driver as a local relation: from a list Spark would start Python workers on the executors."""
    values = list(zip(*rows)) or [()] * len(columns)
    return spark.createDataFrame(pa.table({name: pa.array(v, t) for (name, t), v in zip(columns, values)}))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/panelspark/{name}-{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def short_batches(spark: SparkSession, rows: int = 1000, most: int = 4 << 20) -> None:
    """Send texts to Python a thousand at a time, or so many bytes: documents may be long, and several tasks share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
