"""Documents that arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.sources import documents


def arriving(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """(name, data, arrived): new files of a folder, a bounded number a trigger."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"), F.col("modificationTime").alias("arrived"))


def distinct_content(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Files whose bytes did not arrive within ``late`` before; state is dropped after that time."""
    return files.withColumn("digest", F.sha2("data", 256)).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["digest"])


def pages(files: DataFrame) -> DataFrame:
    return documents.pages(files)


def counts(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows a window and kind, dropping rows later than ``late``."""
    typed = events.withColumn(time, F.col(time).cast("timestamp"))
    return typed.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n")
