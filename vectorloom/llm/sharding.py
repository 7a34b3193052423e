"""Shards along a Hilbert curve over several metadata dimensions.

DataFrame functions only.  Rows are ordered by the curve index of their
quantised dimensions and the order is cut into runs of equal row counts, so a
shard covers a compact region of every dimension and readers can skip shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import checkpoint

BITS = 4


def level(value: Column, bits: int = BITS) -> Column:
    """Quantises a count by its power of two; null is the lowest level."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return F.least(F.lit(2**bits - 1), F.floor(F.log2(F.greatest(v, F.lit(0.0)) + 1))).cast("bigint")


def label_cell(value: Column, bits: int = BITS) -> Column:
    """Quantises a label by its MD5; null is one label of its own."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("\x00"))), 1, 8), 16, 10).cast("bigint"), F.lit(2**bits))


def hilbert_index(n: int, bits: int = BITS, cells: str = "cells") -> Column:
    """Index along the Hilbert curve of the array column ``cells``: n axes of ``bits`` bits.

    The curve is walked from the top bit: where an axis has the bit set, the
    lower bits of the first axis are inverted, else they are exchanged with
    those of that axis; a Gray code over the axes follows, and the bits
    interleave into the index.
    """
    bit, axis = f"shiftleft(1L, {bits - 1} - cast(s div {n} as int))", f"s % {n}"
    turn = f"""transform(x, (v, j) -> CASE
        WHEN (get(x, {axis}) & {bit}) != 0 THEN IF(j = 0, v ^ ({bit} - 1), v)
        WHEN j = 0 OR j = {axis} THEN v ^ ((get(x, 0) ^ get(x, {axis})) & ({bit} - 1))
        ELSE v END)"""
    walked = f"aggregate(transform(sequence(0, {(bits - 1) * n - 1}), s -> cast(s as int)), {cells}, (x, s) -> {turn})"
    gray = f"transform(array({walked}), w -> transform(w, (v, j) -> aggregate(slice(w, 1, j + 1), 0L, (a, b) -> a ^ b)))[0]"
    flip = f"aggregate(sequence(1, {bits - 1}), 0L, (t, b) -> IF((get(g, {n - 1}) & shiftleft(1L, b)) != 0, t ^ (shiftleft(1L, b) - 1), t))"
    final = f"transform(array({gray}), g -> transform(array({flip}), t -> transform(g, v -> v ^ t))[0])[0]"
    digit = f"shiftright(get(y, k % {n}), {bits - 1} - cast(k div {n} as int)) & 1L"
    return F.expr(f"transform(array({final}), y -> aggregate(transform(sequence(0, {bits * n - 1}), k -> cast(k as int)), 0L, (a, k) -> a * 2 + ({digit})))[0]")


def shard_by_curve(rows: DataFrame, dims: list[Column], keys: list[str], shards: int) -> DataFrame:
    """Adds curve (index), shard and slot to every row.

    Rows sort by curve index, then by ``keys``; shard k takes the k-th run.  Run
    lengths differ by one at most; slots count from 0 inside a run.  Ranks come
    from a range partitioning whose bounds fall inside runs of equal keys too, so
    one crowded cell spreads over tasks; each partition counts its rows, and only
    the counts meet.  Rows equal in every key share a fate up to their order.
    An empty table gives an empty result; nulls sort first.  Columns of rows named
    curve, shard or slot, or with two leading underscores, give way to the result's.
    """
    cells = F.array(*[c.cast("bigint") for c in dims])
    curve = rows.withColumn("__cells", cells).withColumn("curve", hilbert_index(len(dims), cells="__cells")).drop("__cells")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", *keys]
    ranged = checkpoint(curve.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(every).alias("__total"))
    ranks = placed.join(F.broadcast(starts), "__part").withColumn("__rank", F.col("__start") + F.col("__at"))  # one row per partition
    low, extra = F.floor(F.col("__total") / shards), F.col("__total") % shards
    edge = extra * (low + 1)
    shard = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (low + 1))).otherwise(extra + F.floor((F.col("__rank") - edge) / F.greatest(low, F.lit(1))))
    ranks = ranks.withColumn("shard", shard.cast("int"))
    first = F.col("shard") * low + F.least(F.col("shard"), extra)
    return ranks.withColumn("slot", (F.col("__rank") - first).cast("bigint")).drop("__part", "__at", "__start", "__total", "__rank")
