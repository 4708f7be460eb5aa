"""The lookup log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.history import clean_log

SCHEMA = "epoch_second long, mode string, query string"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder as a stream of log rows with an event time."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return clean_log(rows).withColumn("at", F.timestamp_seconds("epoch_second"))


def first_lookups(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each row of the log once, though it was delivered several times; state older than the
    watermark is dropped."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["mode", "query", "epoch_second"])


def latest_lookups(stream: DataFrame) -> DataFrame:
    """The last time of each (mode, query), for a sink that updates rows by key."""
    return stream.groupBy("mode", "query").agg(F.max("epoch_second").alias("epoch_second"), F.count("*").alias("times"))


def lookups_per_window(stream: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Number of lookups by mode and window, final once the watermark has passed."""
    grouped = stream.withWatermark("at", late).groupBy(F.window("at", window), "mode")
    return grouped.agg(F.count("*").alias("lookups")).select(F.col("window.start").alias("start"), "mode", "lookups")
