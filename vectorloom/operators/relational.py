"""Joins by position and order-preserving distinct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.operators.prep import first_per


def ordinals(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds 1, 2, … along an order, without gathering the rows.

    Rows are range-partitioned and sorted; each partition counts its own rows, and
    only the counts meet to give every partition its start.
    """
    from pyspark.sql import Window

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        from vectorloom.plans.storage import shared_dir

        context.setCheckpointDir(shared_dir(df.sparkSession))
    placed = placed.checkpoint().withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")  # a row per partition


def zip_rows(a: DataFrame, b: DataFrame, order_a: str, order_b: str, out: str) -> DataFrame:
    """Rows of two tables side by side, by position in their orders."""
    return ordinals(a, order_a, out).join(ordinals(b, order_b, out), out)


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return first_per(df, [key], [order])
