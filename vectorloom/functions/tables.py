"""Tables in the folder that driver and executors share, where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a session of one machine uses a temporary folder; on a
    cluster that is an error, since every machine would have its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/vectorloom-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, what: str, replaces: DataFrame | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there.

    ``replaces`` names an earlier settled table that nothing needs from now on; it
    is deleted once the new one is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        drop(replaces)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a settled table; other tables stay."""
    if path := getattr(df, "_settled", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Log:
    """A table that grows by a few rows at a time; reading it runs nothing again."""

    def __init__(self, spark: SparkSession, what: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
