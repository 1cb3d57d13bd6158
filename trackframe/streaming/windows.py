"""Grouping of signals by time, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def signals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of signals (ts, det_id, value)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(stream: DataFrame, width: str, start: str = "0 seconds", late: str = "1 hour") -> DataFrame:
    """(window_start, window_end, n, total) of tumbling windows; signals later than ``late`` are left out."""
    w = F.window("ts", width, startTime=start)
    found = stream.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet files, each once; ends when all that is there is read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
