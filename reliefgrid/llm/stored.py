"""Tables between the steps of an operator, kept in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.session import ensure_checkpoint_dir

BROADCAST_ROWS = 500_000  # a side is broadcast only after it was counted and has at most so many narrow rows
SALTS = 16
ARROW_ROWS = 1_000  # handed to Python at once: a batch of whole texts is held by Spark and by Python, in each task
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder; the file system removes it when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The rows written once as Parquet and read back: they outlive any executor, and later steps read only what they need.

    ``free`` lets Spark delete the shuffle files of the write when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    settings = {BATCHES: str(ARROW_ROWS)} | ({FREE_SHUFFLES: "true"} if free else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later step reads."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def join_counted(
    large: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, spread: Column, salts: int = SALTS
) -> DataFrame:
    """Join with a side of ``rows`` counted rows, unique by ``on``: broadcast up to a bound, else an equi-join dealt over salts.

    ``spread`` is a hash that differs between rows of one key, so that a hot key is split over ``salts`` tasks.
    """
    if rows <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")
