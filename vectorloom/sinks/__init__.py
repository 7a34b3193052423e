"""Writers of results: unions of unlike rows, reports, tables that must not exist yet."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.plans.reports import markdown


def write_csv(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Rows of all frames under the union of their columns, in the order they first appear."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_state(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """A table in folders by key."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_fixture(df: DataFrame, path: str, **settings: object) -> None:
    """A workload as Parquet beside a manifest: settings, rows, columns and a digest of the rows in any order."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    held = df.sparkSession.read.parquet(f"{path}/data")
    facts = held.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*held.columns).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    manifest = {"settings": settings, "columns": dict(held.dtypes), **facts.asDict()}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """The workload of write_fixture; an error if its rows aren't those of the manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    held = spark.read.parquet(f"{path}/data")
    facts = held.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*held.columns).cast("decimal(38,0)")).cast("string").alias("digest")).first().asDict()
    if facts != {k: manifest[k] for k in facts}:
        raise ValueError(f"the rows in {path} are not those of its manifest")
    return held


def aligned(df: DataFrame, most: int = 1000) -> str:
    """A small table as text in aligned columns, numbers to the right; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no console table")
    cells = [df.columns, *[[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    right = [kind in ("int", "bigint", "double", "float") for _, kind in df.dtypes]
    return "\n".join("  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(line, widths, right, strict=True)).rstrip() for line in cells)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as JSON rows and as Markdown text, replacing what was there."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.sparkSession.createDataFrame([(markdown(df),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
