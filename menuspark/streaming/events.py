"""An optional streaming front for the event funnel and for landed pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_events(events: DataFrame, key: str = "event_id", time_col: str = "ts", late: str = "7 days") -> DataFrame:
    """Each client event once. State is kept as long as a repeat may arrive."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time_col: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window, final once the watermark has passed."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what has arrived, batch by batch, and stop. ``each`` gets the batch id, by which it can
    make its writes idempotent: after a failure the same batch comes again under the same id."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that overwrites its own batch folder, so a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
