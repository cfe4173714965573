"""Structured Streaming forms: read counts, first-seen rows, windows and running operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """New Parquet files under a path, ``files`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten behind the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, at: str, width: str, keys: list[str], slide: str | None = None, late: str = "10 minutes", **sums) -> DataFrame:
    """Tumbling or sliding counts and sums in event time."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = rows.withWatermark(at, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "n", *sums)


def sessions(rows: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    out = rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def running(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch to ``sink``; the checkpoint makes it exactly once for idempotent sinks."""
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there; for tests and small results."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
