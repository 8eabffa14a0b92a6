"""Streams: event lines as they are written, and snapshots kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from ..sources.landed import read_events


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Agent events from a folder of JSON-lines files, as a stream; a line that does not parse is dropped."""
    return read_events(spark.readStream.text(folder))


def live_counts(events: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out and the state behind it is freed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "type").agg(F.count("*").alias("events"))


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark, however often a source delivers it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: list[str], order: list[Column], checkpoint: str):
    """Merge every micro-batch into a snapshot: read() gives the current one, write(df, epoch) puts the next in place.

    write must leave an epoch that was written before as it is; then a batch that is replayed changes nothing.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        write(upsert(read(), batch, keys, order), epoch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
