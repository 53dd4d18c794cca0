"""Incremental quality of plates.  A plate's statistics need only that plate, so it is the natural batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def per_batch(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``analyse`` on each micro-batch and writes its rows under the batch's number, so a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes", keys: tuple[str, ...] = ("plate",)) -> DataFrame:
    """Objects and mean value per window and key, with a watermark for late rows."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")
