"""Sources in nested JSON: users with arrays of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "users array<string>, user_data map<string, struct<x: array<array<double>>, y: array<double>>>"


def users(spark: SparkSession, path: str, split: str, only: DataFrame | None = None) -> DataFrame:
    """Samples of all users of JSON shards: client, split, sample, y, x.

    ``only`` (column client) keeps some users; they are joined before their samples
    are unpacked.
    """
    shards = spark.read.schema(SCHEMA).json(path, multiLine=True)
    per = shards.select(F.explode("user_data").alias("client", "data"))
    if only is not None:
        per = per.join(only, "client", "left_semi")
    cells = per.select("client", F.posexplode(F.arrays_zip(F.col("data.x").alias("x"), F.col("data.y").alias("y"))).alias("at", "c"))
    return cells.select("client", F.lit(split).alias("split"), F.col("at").cast("bigint").alias("sample"), F.col("c.y").cast("int").alias("y"), F.col("c.x").alias("x"))


def federation(spark: SparkSession, root: str, limit: int | None = None, seed: int = 0) -> DataFrame:
    """Users that have both train and test samples, or ``limit`` random ones of them."""
    from vectorloom.operators.prep import sample_rows

    train, test = users(spark, f"{root}/train/*.json", "train"), users(spark, f"{root}/test/*.json", "test")
    both = train.select("client").distinct().intersect(test.select("client").distinct())
    if limit is not None:
        both = sample_rows(both, "client", limit, seed)
    return train.unionByName(test).join(both, "client", "left_semi")
