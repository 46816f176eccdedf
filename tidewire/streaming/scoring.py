"""Structured Streaming: scoring of arriving annotations, and counts of arriving documents. Extensions - batch jobs have the same parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def scored(annotations: DataFrame, weights: DataFrame, time: str = "loaded_at", late: str = "1 day") -> DataFrame:
    """(article_id, category, margin, window): naive Bayes margins without prior of streamed annotations (article_id, term, mc, time), summed within a day. weights: (category, term, gain), static.

    Rows later than the watermark are left out; the state is one number for each article and category of the days that are open.
    """
    rows = annotations.withWatermark(time, late).join(weights, "term")
    return rows.groupBy(F.window(time, "1 day"), "article_id", "category").agg(F.sum(F.col("mc") * F.col("gain")).alias("margin"))


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n) of tumbling windows, late rows up to the watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and give the result as a table in memory; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def write_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
