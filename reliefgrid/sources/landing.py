"""Landed snapshots with commit marks: what a broken landing leaves behind is never read."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "snapshot long, row_count long"


def land_snapshot(df: DataFrame, folder: str) -> int:
    """Write a snapshot, count what was written, and only then mark it as committed; its number."""
    spark, number = df.sparkSession, time.time_ns()
    path = f"{folder}/snapshot-{number}"
    df.write.parquet(path)
    count = spark.read.schema(df.schema).parquet(path).count()
    spark.createDataFrame([(number, count)], COMMITS).coalesce(1).write.mode("append").json(f"{folder}/commits")
    return number


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """snapshot, row_count of all that were committed; none where nothing was landed."""
    try:
        return spark.read.schema(COMMITS).json(f"{folder}/commits")
    except PySparkException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def last_snapshot(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the last committed snapshot; none at all is an error."""
    number = commits(spark, folder).agg(F.max("snapshot")).first()[0]
    if number is None:
        raise FileNotFoundError(f"no committed snapshot in {folder}")
    return spark.read.schema(schema).parquet(f"{folder}/snapshot-{number}")


def fetch_or_last(spark: SparkSession, folder: str, fetch: Callable[[], DataFrame], schema) -> tuple[DataFrame, str | None]:
    """(the snapshot just landed, None), or the last good one and what broke the landing, at its start or half way."""
    try:
        land_snapshot(fetch(), folder)
        broken = None
    except PySparkException as error:
        broken = error.getCondition() or str(error).splitlines()[0]
    return last_snapshot(spark, folder, schema), broken
