"""Sinks of curated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_routes(routes: DataFrame, path: str) -> None:
    """Route rows as JSON lines, waypoints as [lat, lon] pairs."""
    pairs = F.transform("waypoints", lambda p: F.array(p["lat"], p["lon"]))
    routes.withColumn("waypoints", pairs).write.mode("overwrite").json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested documents (column ``value``), one a line."""
    documents.select("value").write.mode("overwrite").text(path)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write, then read back under the same schema."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
