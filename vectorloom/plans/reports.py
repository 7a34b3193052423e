"""Reports on runs: summaries, pivots, diagnostics, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators import slices


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """q1, median, q3 by linear interpolation, and their range; picked by rank, so a group may be of any size."""
    q = slices.quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation, 0 for nothing."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Shares of equal bins of [0, 1], values clipped, empty bins included: bin, share, edge."""
    clipped = F.greatest(F.least(F.col(value), F.lit(1.0)), F.lit(0.0))
    counts = df.groupBy(F.least(F.floor(clipped * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (F.col("bin") / F.lit(float(bins))).alias("edge"))


def floor_share(value: str, floor: float) -> Column:
    """Aggregate: share of values at the floor or above."""
    return F.avg((F.col(value) >= floor - 1e-12).cast("double"))


def payload_bytes(x: str, width: int = 4) -> Column:
    """Aggregate: bytes of the arrays of a group."""
    return (F.sum(F.size(x)) * width).cast("bigint")


def amortise(df: DataFrame, total: str, keys: list[str], out: str) -> DataFrame:
    """Adds the total over the number of rows of its key; counts are joined, rows don't meet."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(counts, keys).withColumn(out, F.col(total) / F.col("_n")).drop("_n")


def collapsed(accuracy: Column, classes: int, factor: float) -> Column:
    """Whether an accuracy is no better than ``factor`` times chance."""
    return accuracy <= factor / classes


def pivot_rounds(df: DataFrame, rounds: list[int]) -> DataFrame:
    """Mean value per method with one column per round."""
    wide = df.groupBy("method").pivot("round", rounds).agg(F.avg("value"))
    return wide.select("method", *[F.col(str(r)).alias(f"round_{r}") for r in rounds])


def suite_mean(df: DataFrame, last: int) -> DataFrame:
    """Unweighted mean over datasets in percent, and whether each dataset is there."""
    finals = df.where(F.col("round") == last).groupBy("method", "dataset").agg(F.avg("value").alias("a"))
    every = df.agg(F.count_distinct("dataset").alias("all"))
    out = finals.groupBy("method").agg((F.avg("a") * 100).alias("mean"), F.count("*").alias("datasets"))
    return out.crossJoin(F.broadcast(every)).withColumn("complete", F.col("datasets") == F.col("all")).drop("all")  # one row


def energy_shares(df: DataFrame, keys: list[str], branch: str, value: str) -> DataFrame:
    """Share of each branch in the sum of the branches' norms."""
    e = df.groupBy(*keys, branch).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("e"))
    return e.withColumn("share", F.col("e") / F.sum("e").over(Window.partitionBy(*keys))).drop("e")


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entropy of values taken as shares of their key's sum."""
    p = df.withColumn("p", F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.ln(F.greatest("p", F.lit(1e-12))))).alias("entropy"))


def first_metric(metrics: str, names: list[str]) -> tuple[Column, Column]:
    """Value and name of the first metric of the list that a map has."""
    value = F.coalesce(*[F.col(metrics)[n] for n in names])
    return value, F.coalesce(*[F.when(F.col(metrics)[n].isNotNull(), F.lit(n)) for n in names])


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown; reports are small, and more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def violations(df: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows that one side lacks or whose values differ: none, if a contract holds."""
    a, b = df.select(*keys, F.col(value).alias("got")), expected.select(*keys, F.col(value).alias("wanted"))
    near = F.abs(F.col("got") - F.col("wanted")) <= tolerance
    return a.join(b, keys, "full_outer").where(~F.coalesce(near, F.lit(False)))
