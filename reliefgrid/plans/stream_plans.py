"""Streaming feeds driven to completion over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import rnd
from reliefgrid.plans.mapping import place_base, table
from reliefgrid.plans.registry import query
from reliefgrid.plans.sqltext import PLACES, r
from reliefgrid.session import ensure_checkpoint_dir
from reliefgrid.streaming.feeds import daily_mean, live_status, rolling_mean, run_available


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file source. A pattern that fits its name alone may be one file or a folder of part files; a plain path must be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def _finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run to the end of the available data into a fresh folder beside the checkpoints, and read the result."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/feed-{uuid.uuid4().hex}"
    run_available(stream, f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# append mode emits a window once the watermark, one day behind the newest event, has passed its end
_CLOSED = "win_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(
    "stream_daily_mean",
    f"""WITH w AS (SELECT event_type, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS win_end, avg(value) AS m, count(*) AS n FROM events GROUP BY 1,2,3)
    SELECT event_type, strftime(s,'%Y-%m-%d') AS day, {r('m',6)} AS mean_value, n AS row_count FROM w WHERE {_CLOSED}""",
)
def stream_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(spark, daily_mean(_event_stream(spark, sf_dir), ["event_type"]))
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), rnd("mean_value", 6).alias("mean_value"), "row_count")


@query(
    "rolling_mean_batch",
    f"""WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), s AS (SELECT unnest(generate_series(min(day) - INTERVAL 29 DAY, max(day), INTERVAL 1 DAY)) AS s FROM d)
    SELECT event_type, strftime(s,'%Y-%m-%d') AS window_start, {r('avg(value)',6)} AS mean_value, count(*) AS row_count FROM events JOIN s ON ts>=s AND ts<s + INTERVAL 30 DAY GROUP BY 1,2""",
)
def rolling_mean_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rolling_mean(table(spark, sf_dir, "events"), ["event_type"])
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), rnd("mean_value", 6).alias("mean_value"), "row_count")


@query(
    "live_status",
    f"""WITH {PLACES}, e AS (SELECT user_id AS destination_id, date_trunc('day', ts) AS s, arg_max(value*100e0, {{'ts': ts, 'v': value}}) AS dem FROM events GROUP BY 1,2),
    j AS (SELECT e.*, place_low.low FROM e JOIN place_low USING (destination_id))
    SELECT destination_id, strftime(s,'%Y-%m-%d') AS day, dem AS daily_demand_peak, {r('low',1)} AS sustainable_capacity, {r('dem/low',3)} AS continuous_pressure, dem>low AS is_overcapacity FROM j""",
)
def live_status_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = table(spark, sf_dir, "events").select(F.col("user_id").alias("destination_id"), "ts", (F.col("value") * 100.0).alias("demand"))
    caps = place_base(spark, sf_dir).select("destination_id", "cc_accommodation", "cc_transport", "cc_attraction", "cc_water_waste", "cc_ecology", "cc_social")
    out = live_status(demand, caps)
    return out.select(
        "destination_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "daily_demand_peak", "sustainable_capacity", "continuous_pressure", "is_overcapacity"
    )


@query(
    "stream_live_status",
    f"""WITH {PLACES}, e AS (SELECT user_id AS destination_id, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS win_end, arg_max(value*100e0, {{'ts': ts, 'v': value}}) AS dem FROM events GROUP BY 1,2,3),
    j AS (SELECT e.*, place_low.low FROM e JOIN place_low USING (destination_id) WHERE {_CLOSED})
    SELECT destination_id, strftime(s,'%Y-%m-%d') AS day, {r('dem/low',3)} AS continuous_pressure, dem>low AS is_overcapacity FROM j""",
)
def stream_live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = _event_stream(spark, sf_dir).select(F.col("user_id").alias("destination_id"), "ts", (F.col("value") * 100.0).alias("demand"))
    caps = place_base(spark, sf_dir).select("destination_id", "cc_accommodation", "cc_transport", "cc_attraction", "cc_water_waste", "cc_ecology", "cc_social")
    out = _finished(spark, live_status(demand, caps))
    return out.select("destination_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "continuous_pressure", "is_overcapacity")
