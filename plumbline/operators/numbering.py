"""Ranks and positions over all rows without one task that sorts them all.

Rows are range-partitioned by the order, numbered inside each partition, and
offset by the rows of the partitions before: two passes, sorted in parallel.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows whenever they are read: a Parquet table in the checkpoint
    folder where one is set, else the cached frame. Such a table is a fraction of
    a checkpoint's rows, and joins know its size."""
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        return df.persist()
    path = f"{folder.get().rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a plan's estimated size (Parquet's, so packed) that one task takes.
PART_BYTES = 4 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its size asks for, and to no
    fewer than a shuffle has, so that a task's rows do not grow with the input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(max(least, -(-size // PART_BYTES)), 20_000), *keys)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` = 0, 1, 2 ... along ``order``, which must not tie."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # a row a partition
    own = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1)
    return own.join(F.broadcast(firsts), "_pid").withColumn(name, F.col("_first") + F.col("_row")).drop("_pid", "_first", "_row")


def running_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each one
    along ``order``, which must not tie."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sums = ranged.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    up_to = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("_pid", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_first"))  # a row a partition
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_row", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(F.broadcast(firsts), "_pid").withColumn(name, F.col("_first") + F.col("_row")).drop("_pid", "_first", "_row")


def average_ranks(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, ``name``): the share of rows up to each value within its
    keys, ties at their average: (rows below + (equal rows + 1) / 2) / rows."""
    return ranks_of_counts(values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, value, name)


def ranks_of_counts(counted: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """:func:`average_ranks` of values of which each has one row and its count ``_n``."""
    ranged = settled(counted.repartitionByRange(*keys, value).withColumn("_pid", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_pid").agg(F.sum("_n").alias("_part"))
    total = Window.partitionBy(*keys)
    before = total.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_pid", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_first"), F.sum("_part").over(total).alias("_all"))
    own = Window.partitionBy(*keys, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_below", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    rank = (F.col("_first") + F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_all")
    return within.join(F.broadcast(offsets), [*keys, "_pid"]).select(*keys, value, rank.alias(name))
