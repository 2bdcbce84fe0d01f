"""Streaming extensions: a keyed registry and windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from simloom.operators.registry import write_upserted


def parquet_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files under path, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and sums of value in tumbling or sliding windows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in the Parquet table at path; a batch that is done again gives the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        write_upserted(batch.sparkSession, path, batch, keys, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_stream(stream: DataFrame, score: Column) -> DataFrame:
    return stream.withColumn("score", score)
