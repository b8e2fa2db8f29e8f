"""Readers of landed files, all with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reliefgrid import schemas

BOM = "﻿"


def csv_table(spark: SparkSession, path: str, schema: str | StructType, null_value: str = "") -> DataFrame:
    """Typed CSV with a header."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null_value).option("quote", '"').option(
        "escape", '"'
    ).csv(path)


def csv_text(spark: SparkSession, path: str, null_value: str = "N/A") -> DataFrame:
    """CSV as strings; a byte-order mark before the first header name is removed."""
    df = spark.read.option("header", True).option("nullValue", null_value).option("inferSchema", False).csv(path)
    return df.toDF(*[c.replace(BOM, "") for c in df.columns])


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Landed JSON: one file holds a list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a fetched table once and hand back the landed copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_available(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Open a snapshot list; a source that cannot be opened is reported instead of failing the rest."""
    tables, failures = {}, {}
    for name, reader in readers.items():
        try:
            tables[name] = reader()
        except AnalysisException as error:
            failures[name] = str(error).splitlines()[0]
    return tables, failures


def report_texts(spark: SparkSession, path: str, name: str = "_metadata.file_name") -> DataFrame:
    """(file_name, text): one row per report file, read whole. ``name``: the column that names a report kept in a folder of its own."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col(name).alias("file_name"), F.col("value").alias("text"))


def cell_table(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, schemas.CELLS)


def multiplier_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``tables``: map(year -> struct(composite_tourism, sectors)), a row for each file, or for each line of files of documents."""
    text = spark.read.text(path, wholetext=not lines)
    tables = F.from_json("value", schemas.MULTIPLIER_TABLES)
    return text.select(F.map_filter(tables, lambda k, v: k != "metadata").alias("tables"))


def route_json(spark: SparkSession, path: str) -> DataFrame:
    """(route, corridor_name, mode, travel_time_mins, fare_rm, waypoints)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schemas.ROUTES)).alias("route", "r")).select(
        "route", "r.corridor_name", "r.mode", "r.travel_time_mins", "r.fare_rm",
        F.transform("r.waypoints", lambda p: F.struct(F.get(p, F.lit(0)).alias("lat"), F.get(p, F.lit(1)).alias("lon"))).alias("waypoints"),
    )


def hotel_series(df: DataFrame) -> DataFrame:
    """Hotel time series under the display names."""
    return df.withColumnsRenamed({"state": "state_name", "period": "quarter"})
