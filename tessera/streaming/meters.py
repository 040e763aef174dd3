"""Streams of events: distinct values in event time, windowed statistics, and a meter of each key's last n values."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name_glob: str = "events*.parquet", files_a_batch: int = 1) -> DataFrame:
    """Events as their files arrive; ts as a timestamp, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", name_glob).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_within(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark; state older than that goes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, by: str, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Count and mean by window and key; a window is given out when the watermark has passed it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "mean")


def last_n(events: DataFrame, key: str = "user_id", n: int = 30) -> DataFrame:
    """For each key with new events: how many it had, and median, mean and largest of its last n. State is n values a key."""

    def update(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        held = [*held, *rows["value"].tolist()][-n:]
        count += len(rows)
        state.update((count, held))
        yield pd.DataFrame({key: [k[0]], "n": [count], "median": [median(held)], "mean": [sum(held) / len(held)], "most": [max(held)]})

    return events.select(key, "ts", "event_id", "value").groupBy(key).applyInPandasWithState(
        update, f"{key} long, n long, median double, mean double, most double", "n long, held array<double>", "update", GroupStateTimeout.NoTimeout
    )
