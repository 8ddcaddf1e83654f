"""Structured Streaming: side-cars written as rows arrive, event-time windows, statistics that go on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import sidecar


def write_sidecar_stream(rows: DataFrame, folder: str, checkpoint: str, metadata: str = "metadata"):
    """SNK17: each micro-batch adds its side-car records once, whatever is replayed; conflicts stop the stream.

    A batch's file carries its number, so a batch that runs again replaces its own file.
    """

    def add(df: DataFrame, number: int) -> None:
        new = sidecar.build(df, metadata)
        done = [f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("batch=") and n != f"batch={number}"] if os.path.isdir(folder) else []
        every = new if not done else new.union(df.sparkSession.read.schema(sidecar.SCHEMA).parquet(*done)).distinct()
        sidecar.assert_consistent(every)
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, *, time: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows; rows later than ``late`` are left out of closed windows."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def running_stats(rows: DataFrame, feature: str, by: str) -> DataFrame:
    """AGG01 over an unbounded source: moments of each group's elements so far."""
    x = rows.select(by, F.explode(feature).alias("_x"))
    return x.groupBy(by).agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))
