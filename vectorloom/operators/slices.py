"""Ordered work on keys of any size: a key's rows are cut into slices that tasks share.

Rows are dealt by ranges of (key, order), so a key with half of all rows is in half
of the tasks.  Places follow from counts per slice; windows work on blocks of places
with the rows they need from a neighbour; running values are carried from block to
block by a scan of one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions.tables import settle

#: Places of a block, at least.
BLOCK = 8192
#: Dimensions whose moments are columns of one row.
NARROW = 16


def ordinals(df: DataFrame, key: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Adds the place of every row among those of its key, from 0, in order; rows that are equal in order may swap.

    The rows are written once in ranges of key and order, which fixes the slices.
    Nulls come first.  The result has one row per row of df.
    """
    slice_, number, count, before = fresh(df, "slice", "number", "count", "before")
    dealt = settle(df.repartitionByRange(*key, *order).withColumn(slice_, F.spark_partition_id()), "slices")
    counts = dealt.groupBy(*key, slice_).agg(F.count("*").alias(count))
    earlier = Window.partitionBy(*key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice of a key
    starts = counts.select(*[F.col(k).alias(f"{before}_{i}") for i, k in enumerate(key)], F.col(slice_).alias(f"{before}_s"), F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    same = F.col(slice_) == F.col(f"{before}_s")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"{before}_{i}"))
    numbered = dealt.withColumn(number, F.row_number().over(Window.partitionBy(*key, slice_).orderBy(*order)) - 1)
    return numbered.join(starts, same).select(*df.columns, (F.col(number) + F.col(before)).cast("bigint").alias(out))


def blocks(placed: DataFrame, place: str, size: int, ahead: int = 0, behind: int = 0, out: str = "block", own: str = "own") -> DataFrame:
    """Rows by blocks of ``size`` places, with copies of rows that neighbours need.

    A block also has the first ``ahead`` rows of the next one and the last ``behind``
    of the one before; ``own`` is true for a row's own block.
    """
    if max(ahead, behind) > size:
        raise ValueError("a block must be as long as what it needs of a neighbour")
    at = F.floor(F.col(place) / size)
    inner = F.col(place) - at * size
    homes = [F.struct(at.alias("b"), F.lit(True).alias("o"))]
    if ahead:
        homes.append(F.when((inner < ahead) & (at > 0), F.struct((at - 1).alias("b"), F.lit(False).alias("o"))))
    if behind:
        homes.append(F.when(inner >= size - behind, F.struct((at + 1).alias("b"), F.lit(False).alias("o"))))
    (home,) = fresh(placed, "home")
    each = placed.withColumn(home, F.explode(F.array_compact(F.array(*homes))))
    return each.select(*placed.columns, F.col(f"{home}.b").alias(out), F.col(f"{home}.o").alias(own))


def carried(df: DataFrame, key: list[str], order: list[str], value: str, last: str, first: str, size: int = BLOCK) -> DataFrame:
    """Adds the last value at or before each row in order and the first at or after it, nulls passed over.

    Inside a block both come from windows; what lies beyond comes from the blocks'
    own first and last values, one row per block.
    """
    place, block, own, low, high = fresh(df, "place", "block", "own", "low", "high")
    rows = settle(blocks(ordinals(df, key, order, place), place, size, out=block, own=own).drop(own), "blocks")
    inside = Window.partitionBy(*key, block).orderBy(place)
    ends = rows.groupBy(*key, block).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(place))).alias(high), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(place))).alias(low))
    by = Window.partitionBy(*key).orderBy(block)
    names = [f"{block}_{i}" for i in range(len(key) + 1)]
    beyond = ends.select(
        *[F.col(k).alias(n) for k, n in zip([*key, block], names, strict=True)],
        F.last(high, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{high}_"),
        F.first(low, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias(f"{low}_"),
    )
    near = rows.withColumns({
        high: F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        low: F.first(value, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    })
    same = F.lit(True)
    for k, n in zip([*key, block], names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return near.join(beyond, same).select(*df.columns, F.coalesce(high, f"{high}_").alias(last), F.coalesce(low, f"{low}_").alias(first))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles by linear interpolation between the rows at two places: keys, q (an array, in the order of shares).

    Null and NaN values are passed over; a key without a value has no row.  No
    group's values meet in one task.
    """
    place, count, low = fresh(df.select(*keys, value), "place", "count", "low")
    real = df.select(*keys, F.col(value).cast("double").alias(low)).where(F.col(low).isNotNull() & ~F.isnan(low))
    placed = ordinals(real, keys, [low], place)
    sizes = settle(placed.groupBy(*keys).agg(F.count("*").alias(count)), "sizes") if keys else placed.agg(F.count("*").alias(count)).where(F.col(count) > 0)
    names = [f"{count}_{i}" for i in range(len(keys))]
    renamed = sizes.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], count)
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    joined = placed.join(renamed, same) if keys else placed.crossJoin(F.broadcast(renamed))  # one row
    parts = []
    for i, share in enumerate(shares):
        exact = (F.col(count) - 1) * F.lit(float(share))
        weight = 1 - F.abs(F.col(place) - exact)
        parts.append(F.when(weight > 0, F.struct(F.lit(i).alias("i"), (F.col(low) * weight).alias("v"))))
    hits = joined.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("h")).select(*keys, "h.i", "h.v")
    each = hits.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("q"))


def moments(df: DataFrame, keys: list[str], x: str, skip_nan: bool = False) -> DataFrame:
    """Count, mean and population variance of every dimension: keys, n, mean, variance (arrays).

    Tasks add up their own rows.  Up to NARROW dimensions the shuffle has one row per key
    and task; more are taken in long form, with one row per key, dimension and task.
    Null cells count nothing; so do NaN cells if ``skip_nan``.  Rows may differ in
    length; how long the longest is takes a pass of its own.  A dimension without a cell
    has mean and variance null.
    """
    vector, size = fresh(df.select(*keys), "vector", "size")
    rows = df.select(*keys, F.col(x).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    real = lambda v: F.when(~F.isnan(v), v) if skip_nan else v
    measures = {"n": F.count, "mean": F.avg, "variance": F.var_pop}
    if width > NARROW:
        return _long_moments(rows, keys, vector, real, measures)
    each = rows.select(*keys, F.size(vector).alias(size), *[real(F.get(vector, F.lit(i))).alias(f"{vector}_{i}") for i in range(width)])
    sums = each.groupBy(*keys).agg(F.max(size).alias(size), *[f(f"{vector}_{i}").alias(f"{vector}_{m}_{i}") for m, f in measures.items() for i in range(width)])
    none = {m: F.array().cast("array<bigint>" if m == "n" else "array<double>") for m in measures}
    arrays = {m: F.slice(F.array(*[F.col(f"{vector}_{m}_{i}") for i in range(width)]), F.lit(1), F.col(size)) if width else none[m] for m in measures}
    return sums.select(*keys, *[a.alias(m) for m, a in arrays.items()])


def _long_moments(rows: DataFrame, keys: list[str], vector: str, real: Callable[[Column], Column], measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    at, cell, cells = fresh(rows, "at", "cell", "cells")
    # an empty row gives one place that is null
    long = rows.select(*keys, F.posexplode_outer(vector).alias(at, cell)).withColumn(cell, real(F.col(cell)))
    per = long.groupBy(*keys, at).agg(*[f(F.col(cell)).alias(m) for m, f in measures.items()])
    held = F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(at, *measures))))
    packed = per.groupBy(*keys).agg(held.alias(cells))
    return packed.select(*keys, *[F.col(f"{cells}.{m}").alias(m) for m in measures])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def lagged(df: DataFrame, key: list[str], order: list[str], value: Column, out: str, place: str, size: int = BLOCK) -> DataFrame:
    """Adds each row's place and the value of the row before it of its key, null for the first."""
    at, block, own = fresh(df, "at", "block", "own")
    cut = blocks(ordinals(df, key, order, at), at, size, behind=1, out=block, own=own)
    before = F.lag(value).over(Window.partitionBy(*key, block).orderBy(at))
    return cut.withColumn(out, before).where(own).select(*df.columns, F.col(at).alias(place), out)
