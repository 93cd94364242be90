"""Shared folder, reliable checkpoints and global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.shared import fresh_dir, shared_dir


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: they outlive executors and their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Spark's own setting that a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a compressed table in the shared folder, for those that are many.

    The table is all that is read from then on, so the shuffle files behind it need not stay.
    """
    spark = df.sparkSession
    folder = fresh_dir(spark, what)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def tasks(files: DataFrame, size: str, each: int) -> int:
    """How many tasks read files of these sizes, some `each` bytes a task.

    A count that is stated is kept: adaptive execution would else put all rows that name files
    into one task, as the rows themselves are small.
    """
    total = files.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-total // each))


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds row numbers from 0 in the given total order: a range sort, written once, then a prefix
    sum over one small row a partition; no window over all rows."""
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # The generated number is the partition's, shifted, and the row's within it.
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(ends), "_part").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))


def join_small(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Broadcasts `right` if it has at most `most` rows, else leaves it to a shuffled join."""
    few = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right, on, how)
