"""Bars, new-bar events and append sinks on tick and journal streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebar.sources.ingest import BAR_WIDTH


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A parquet table of a folder as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(sf_dir)


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table_stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"),
        F.col("value").alias("price"), F.col("event_id").alias("tick_id"))


def stream_bars(ticks: DataFrame, timeframe: str = "H4", delay: str = "1 hour") -> DataFrame:
    """Closed OHLC bars; a bar is emitted once the watermark passes its end, later ticks are dropped.

    The state holds a few numbers per open (symbol, bar), combined per task before the shuffle.
    """
    order = F.struct("time", "tick_id")
    return (ticks.withWatermark("time", delay)
            .groupBy("symbol", F.window("time", BAR_WIDTH[timeframe]).alias("_w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.count(F.lit(1)).alias("tick_volume"))
            .select("symbol", F.col("_w.start").alias("time"), "open", "high", "low", "close",
                    "tick_volume"))


def new_bars(ticks: DataFrame, timeframe: str = "H4", delay: str = "5 hours") -> DataFrame:
    """The first tick of every (symbol, bar): each bar is handled once.

    `delay` must not be shorter than a bar, or a late tick could open its bar again.
    """
    start = F.window("time", BAR_WIDTH[timeframe]).start
    return (ticks.withColumn("bar_time", start).withWatermark("time", delay)
            .dropDuplicatesWithinWatermark(["symbol", "bar_time"]).select("symbol", "bar_time"))


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once parquet sink that takes what is there and stops."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over the data that is there and read the sink back."""
    append_sink(stream, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
