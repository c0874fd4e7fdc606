"""Streaming extensions: running ensembles of arriving tile predictions, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_ensemble(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Sums and counts per point over all tiles that have arrived; means follow by division. For output mode complete or update."""
    return stream.groupBy("point_id").agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over what is there and returns its result table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
