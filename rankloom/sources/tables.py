"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal out the rows of a table that has less than one full split per core.

    Splits are not row groups: a file of one row group is read by one task,
    however many splits it is offered in, and everything up to the first
    exchange would run there. The size is what the plan's statistics say, so
    nothing is read and no plan is made for it. Layout only; a table of at
    least one full split per core is left alone, so large ones pay nothing.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(cores) if size < cores * split else rows
