"""Incremental ingest as a stream: each micro-batch is upserted into the lake, and what depends on the last dates is computed again.

An extension: the batch functions do the work, so a batch and a stream agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark.sources import lake


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], date: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None, lookback: int = 0) -> StreamingQuery:
    """Write a stream into month partitions, the newest row of a key winning.

    Within a micro-batch the last of equal keys by ``date`` is kept; a batch that is
    tried again gives the same table.  ``after`` gets the rows from ``lookback``
    days before the first date of the batch on.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        rows = lake.latest(batch, keys, [F.col(date).desc()])
        lake.upsert(spark, rows, path, keys, date)
        if after is not None:
            first = rows.agg(F.date_sub(F.min(F.col(date).cast("date")), lookback)).first()[0]
            after(lake.read_range(spark, path, date, str(first)))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
