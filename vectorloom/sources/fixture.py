"""A controlled workload whose number of mistakes is known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators.checks import check_settings


def template(spark: SparkSession, classes: int, dims: int, rows: int, wrong: int) -> DataFrame:
    """Samples of unit anchors: sample, y, h, expect_wrong.

    A wrong row of class k is the next class's anchor; a right one is twice its own
    anchor less the next, so that the class mean is the anchor if halves are equal.
    """
    check_settings(classes, dims, [1], wrong, rows - wrong)
    s = spark.range(rows).withColumns({"y": (F.col("id") % classes).cast("int"), "expect_wrong": F.col("id") < wrong})
    after = (F.col("y") + 1) % classes
    axes = F.sequence(F.lit(0), F.lit(dims - 1))
    right = F.transform(axes, lambda d: F.when(d == F.col("y"), 2.0).when(d == after, -1.0).otherwise(0.0))
    off = F.transform(axes, lambda d: F.when(d == after, 1.0).otherwise(0.0))
    return s.select(F.col("id").alias("sample"), "y", F.when(F.col("expect_wrong"), off).otherwise(right).alias("h"), "expect_wrong")


def clients(rows: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """Every client holds the same template, which is sent to the clients if it has ``most`` rows or fewer."""
    small = rows.limit(most + 1).count() <= most
    ids = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("client"))
    return ids.crossJoin(F.broadcast(rows) if small else rows)
