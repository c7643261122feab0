"""Replay of landed events as a stream, into the raw or the cleaned layer."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.layers import clean_events, user_items
from ..sources.files import EVENTS
from ..sources.storage import Storage

BATCH = 5_000
LONGEST_PAUSE = 1.0


def pause(previous_ms: int | None, first_ms: int, speed: float) -> float:
    """Seconds to wait before a batch: the gap in event time over the speed, a second at most; none at speed 0 or before the first."""
    if not speed or previous_ms is None:
        return 0.0
    return min(max(first_ms - previous_ms, 0) / 1000 / speed, LONGEST_PAUSE)


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("header", True).option("nullValue", "").option("maxFilesPerTrigger", files_per_batch).csv(folder)


def land_in_order(events: DataFrame, folder: str, rows: int = BATCH) -> None:
    """CSV files of at most so many events in time order: ranges of time are sorted in parallel, and the files' times follow their names, by which a stream takes them."""
    events.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.option("maxRecordsPerFile", rows).csv(folder, header=True)
    storage = Storage(events.sparkSession)
    for i, name in enumerate(storage.listed(folder, ".csv")):
        storage.set_time(f"{folder}/{name}", 1_000_000_000_000 + 1000 * i)


def replay(spark: SparkSession, folder: str, table: str, checkpoint: str, speed: float = 0.0, clean: bool = True) -> StreamingQuery:
    """Runs through all files of a folder in micro-batches, in the order of their times.

    Each batch is written under its number, cleaned or as it came, so a repeated batch replaces itself.
    """
    last: dict[str, int | None] = {"ms": None}

    def write(batch: DataFrame, number: int) -> None:
        if speed:
            low, high = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
            if low is not None:
                time.sleep(pause(last["ms"], low, speed))
                last["ms"] = high
        (clean_events(batch) if clean else batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return event_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed_user_items(spark: SparkSession, table: str) -> DataFrame:
    """The aggregate of what has been replayed; it equals the batch aggregate of the same events."""
    return user_items(spark.read.parquet(table).drop("batch"))
