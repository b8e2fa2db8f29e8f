"""Daily feeds kept current with Structured Streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reliefgrid.operators.capacity import diagnose
from reliefgrid.session import ensure_checkpoint_dir, shared_folder


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def daily_mean(events: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Tumbling daily mean per key; rows later than ``late`` are ignored. Also runs on a batch table."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    bounded = timed.withWatermark(ts, late) if events.isStreaming else timed
    grouped = bounded.groupBy(F.window(ts, "1 day"), *keys).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("row_count"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "mean_value", "row_count")


def rolling_mean(
    events: DataFrame, keys: list[str], value: str = "value", ts: str = "ts", late: str = "1 day", days: int = 30
) -> DataFrame:
    """Mean over the last ``days`` days, moving by one day.

    Rows are added up by day first, so only daily sums go into ``days`` windows each.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    bounded = timed.withWatermark(ts, late) if events.isStreaming else timed
    daily = bounded.groupBy(F.window(ts, "1 day").alias("day"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("filled"), F.count(F.lit(1)).alias("many"))
    moving = daily.groupBy(F.window(F.window_time("day"), f"{days} days", "1 day"), *keys).agg(
        (F.sum("total") / F.sum("filled")).alias("mean_value"), F.sum("many").alias("row_count")
    )
    return moving.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "mean_value", "row_count")


def live_status(
    demand: DataFrame, capacities: DataFrame, key: str = "destination_id", ts: str = "ts", late: str = "1 day", length: str = "1 day"
) -> DataFrame:
    """Latest demand of each place per window, the larger of two at one time, joined to its static capacities and diagnosed."""
    timed = demand.withColumn(ts, F.col(ts).cast("timestamp"))
    bounded = timed.withWatermark(ts, late) if demand.isStreaming else timed
    latest = bounded.groupBy(F.window(ts, length), key).agg(F.max_by("demand", F.struct(ts, "demand")).alias("daily_demand_peak"))
    return diagnose(latest.join(capacities, key)).withColumn("window_start", F.col("window.start")).drop("window")


def run_available(stream: DataFrame, folder: str, output_mode: str = "append") -> StreamingQuery:
    """Write everything available to parquet and stop.

    State and progress live under the shared checkpoint folder in a place that depends on the output only, so the next
    application goes on where this one stopped.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = shared_folder(spark) or spark.sparkContext.getCheckpointDir()
    progress = f"{base}/stream-{hashlib.sha256(folder.encode()).hexdigest()}"
    return (
        stream.writeStream.format("parquet").outputMode(output_mode).option("path", folder)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def run_batches(stream: DataFrame, checkpoint: str, handle) -> StreamingQuery:
    """``foreachBatch`` sink for outputs that replace rows (complete or update mode)."""
    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(handle).trigger(availableNow=True).start()
    )
