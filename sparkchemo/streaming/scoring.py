"""Scoring streams: every fitted model is column expressions, so it scores a stream as it scores a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def outlier_rates(scored: DataFrame, time: str, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """(window, n, inliers) over event time; rows later than ``late`` are dropped by the watermark."""
    return scored.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inlier").cast("long")).alias("inliers"))


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the result as a table; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
