"""Structured Streaming forms: ordered folds, windowed counts with watermarks, stateful latest values.

Each has a batch form elsewhere with which its results agree once the stream is drained.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, with event time as `ts`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts by event type in tumbling or sliding windows; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, late: str, key: str) -> DataFrame:
    """Each event id once, remembered for as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest_by_user(events: DataFrame) -> DataFrame:
    """The running fold as streaming aggregates: last value by (ts, event_id), version count."""
    return events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count(F.lit(1)).alias("version"))


def locked_fold(events: DataFrame) -> DataFrame:
    """Custom state by user: the last value until an event of type 'purchase' locks it; then only 'signup' unlocks.

    Events of a micro-batch are folded in (ts, event_id) order.
    """
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, locked, version = state.get if state.exists else (None, False, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, new in zip(rows["event_type"], rows["value"], strict=True):
            if kind == "signup":
                locked = False
            if not locked:
                value, version = float(new), version + 1
            if kind == "purchase":
                locked = True
        state.update((value, locked, version))
        yield pd.DataFrame({"user_id": [key[0]], "last_value": [value], "version": [version]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_value double, version long", "value double, locked boolean, version long", "update", "NoTimeout")


def drained(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream to the end of what is there and returns its result table.

    Every micro-batch is written below `checkpoint`, a folder that all executors share, by its number, so that
    one that is run again replaces itself; in complete mode the last one is the result.
    """
    path = f"{checkpoint}/drained_{uuid.uuid4().hex}"
    last = -1

    def keep(rows: DataFrame, batch: int) -> None:
        nonlocal last
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        last = max(last, batch)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if last < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={last}" if mode == "complete" else f"{path}/rows/batch=*")
