"""Connected components of a graph of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import materialise


def connect(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Smallest node that every linked node reaches: node, root.

    ``edges`` has columns a and b of one ordered type, in either direction.  Each
    round hangs the larger neighbours of a node below its smallest one, then the
    smaller ones too (large star, small star), until every edge points to a root.
    Minima combine before they are shuffled and the joins split skewed keys, so no
    task gathers the neighbours of a node.  Nodes without a link don't appear;
    loops are ignored; an empty table gives an empty result.
    """
    now = materialise(_down(edges).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _down(large).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialise(_down(small).distinct(), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _down(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
