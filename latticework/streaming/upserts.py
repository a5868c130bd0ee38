"""Streaming form of the work queue and of upserts (an extension: the procedures modelled here run in batches)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.panel import last_wins
from ..sources.sinks import replace_slices


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str, by: Sequence[str], read: Callable[[], DataFrame | None]) -> StreamingQuery:
    """Merge each micro-batch into a partitioned table: the last row of a key wins, touched partitions are replaced.

    Replacing partitions is idempotent, so a batch that is run again after a failure leaves the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        old = read()
        touched = batch.select(*by).distinct()
        rows = batch if old is None else batch.unionByName(old.join(touched, list(by), "left_semi"))
        settled = last_wins(rows, keys, order)
        settled.sparkSession.sparkContext.setCheckpointDir(f"{checkpoint}/rdd")
        replace_slices(settled.checkpoint(), path, by)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sum of a value per window and key; state is dropped once the watermark has passed a window."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Stream without repeated keys, as far back as the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
