"""Search-interest proxy index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.numeric import rnd
from reliefgrid.functions.similarity import leading_tags
from reliefgrid.operators.rollup import month_means

# Month names, list size and the method note.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
               "November", "December"]
TOP_N = 50
METHOD = "proxy: demand-normalized index; peak month from national demand calendar"


def peak_months(calendar: DataFrame) -> DataFrame:
    """One row: the two calendar months with the highest mean demand multiplier."""
    name = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.col("month_no") - 1)
    ranked = month_means(calendar)
    return ranked.agg(
        F.max(F.when(F.col("month_rank") == 1, name)).alias("hotspot_peak"),
        F.max(F.when(F.col("month_rank") == 2, name)).alias("alternative_peak"),
    )


def search_interest(places: DataFrame, calendar: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Top places by demand with an index to the largest, class, peak month and leading tags."""
    peaks = peak_months(calendar).select(F.struct("hotspot_peak", "alternative_peak")).scalar()
    head = places.orderBy(F.desc("daily_demand_peak"), "state_name", "destination_name").limit(top_n)
    listed = Window.partitionBy(F.lit(1))  # over the short list only
    hot = F.col("continuous_pressure") >= 1.0
    tags = leading_tags("poi_tags")
    return head.withColumn("_peak", F.max("daily_demand_peak").over(listed)).select(
        F.col("destination_name").alias("destination"),
        F.col("state_name").alias("state"),
        F.when(hot, "Hotspot").otherwise("Alternative").alias("category"),
        rnd(F.col("daily_demand_peak") * 100.0 / F.col("_peak"), 1).alias("relative_search_index"),
        F.when(hot, peaks["hotspot_peak"]).otherwise(peaks["alternative_peak"]).alias("peak_month"),
        F.when(tags != "", tags).otherwise(F.lower("destination_name")).alias("dominant_query"),
        F.lit(METHOD).alias("method"),
    )
