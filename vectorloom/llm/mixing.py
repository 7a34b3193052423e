"""Mixes sources to target sizes by subset-sum budget fitting over exact lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import WORD, materialise

#: Documents of one source and length above which the choice among them is salted.
SALT_ROWS = 1000
#: Budget left to the dynamic program: so many times the longest length, and a least number of words.
DP_SPAN, DP_LEAST = 4, 1 << 14


def count_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: columns source, source_size in, target added.

    Sources by code point, null last, take the weights in turn.  A target above
    ``most`` times its source is cut there and the excess reshared by weight: the
    water level at which sources with the least size per weight are full.  One row
    per source meets in one task, nothing more.
    """
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("_k") % len(weights))
    cap = F.col("source_size") * most
    by_level = Window.orderBy("_level", "_k")
    upto, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = ranked.withColumns({"_w": weight, "_cap": cap}).withColumn("_level", F.col("_cap") / F.col("_w"))
    levels = levels.withColumns({
        "_open": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)),
        "_left": share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)),
    })
    levels = levels.withColumn("_water", F.min(F.when(F.col("_left") / F.col("_open") <= F.col("_level"), F.struct("_level", (F.col("_left") / F.col("_open")).alias("water")))).over(every)["water"])
    return levels.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_water"), F.col("_cap"))).alias("target"))


def _pieces(lengths: np.ndarray, counts: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(length's place, documents, words): counts in binary pieces, whose choices make up every number of documents."""
    out = []
    for i in np.argsort(lengths, kind="stable").tolist():
        length, part = int(lengths[i]), 1
        n = min(int(counts[i]), most // length) if length else 0
        while n > 0:
            take = min(part, n)
            n, part = n - take, part * 2
            if take * length <= most:
                out.append((i, take, take * length))
    return out


def _sums(pieces: list[tuple[int, int, int]], most: int) -> int:
    """Bits of all sums up to ``most`` that choices among the pieces make."""
    reach, mask = 1, (1 << most + 1) - 1
    for _, _, words in pieces:
        reach |= reach << words & mask
    return reach


def _choice(pieces: list[tuple[int, int, int]], total: int) -> list[tuple[int, int, int]]:
    """Pieces that sum to ``total``, which some do: halves of the pieces meet at a sum that both sides reach."""
    while total and len(pieces) > 1:
        half = len(pieces) // 2
        left, right = pieces[:half], pieces[half:]
        down = 1 << total  # bits of what the right half can leave
        for _, _, words in right:
            down |= down >> words
        meet = (_sums(left, total) & down).bit_length() - 1
        if 0 < meet < total:
            return _choice(left, meet) + _choice(right, total - meet)
        pieces = left if meet else right
    return pieces if total else []


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum comes nearest below budget.

    Takes the budget's share of every length first, then long lengths while much
    is left, and solves the rest exactly by bounded-knapsack dynamic programming: up
    to DP_SPAN times the longest length is left to it, whatever that length is.  The
    program holds one bit for every sum, so a text of a million words takes half a
    megabyte; choices are found again by halving the lengths, not by a table.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    span = max(DP_SPAN * int(lengths.max(initial=1)), DP_LEAST)
    free = max(0, budget - span // 2)
    taken = (counts * (free / max(total, 1))).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= span:
            break
        more = min(int(counts[i] - taken[i]), max(0, (left - span // 2) // max(int(lengths[i]), 1)))
        taken[i] += more
        left -= more * int(lengths[i])
    pieces, reach, used = _pieces(lengths, counts - taken, left), 1, 0
    mask = (1 << left + 1) - 1
    for used, (_, _, words) in enumerate(pieces, 1):
        reach |= reach << words & mask
        if reach.bit_length() == left + 1:
            break
    for i, n, _ in _choice(pieces[:used], reach.bit_length() - 1):
        taken[i] += n
    return taken


def _plan(cells: pd.DataFrame) -> pd.DataFrame:
    """Takes of every length of one source; cells has one row per length."""
    target, whole = cells["target"].iloc[0], int(cells["source_size"].iloc[0])
    copies = 1 if target >= whole else 0
    budget = int(round(target)) - copies * whole
    lengths, counts = cells["size"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    return cells[["source", "size", "n", "source_size", "target"]].assign(copies=copies, extra=fit(lengths, counts, budget))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, carry: list[str] | None = None) -> DataFrame:
    """Chooses how often every document is taken: doc_id, source, size, source_size, target, copies, taken.

    Documents are counted by (source, size); each source's counts are fitted to
    its target; then so many documents of every length are chosen by a seeded
    hash of the document.  ``copies`` is 0, 1 or 2 and ``taken`` is copies times
    size.  The choice among many documents of one source and length is salted: a
    count per salt decides up to which salt all are taken, and only inside a salt
    are documents ranked.

    Null texts have size 0; a null source is a source of its own, last in order.
    Repeated rows count as often as they stand; which of two equal rows is taken
    makes no difference to the result.  An empty table gives an empty result.
    ``carry`` names columns, such as a key of the row, to put after the result.
    """
    carried = carry or []
    fields = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), *carried)
    sized = materialise(fields.withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    cells = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    fitted = cells.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    kind = docs.schema["source"].dataType.simpleString()
    plan = materialise(fitted.groupBy("source").applyInPandas(_plan, f"source {kind}, size bigint, n bigint, source_size bigint, target double, copies int, extra bigint"), "mix-plan")
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "source_size", "target", "copies", "extra")
    joined = sized.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    salt = F.pmod(F.col("_h"), F.ceil(F.col("n") / SALT_ROWS)).cast("int")
    some = joined.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).withColumn("_salt", salt)
    cell = ["source", "size", "_salt"]
    salts = some.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_salt").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = some.join(salts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_salt") == F.col("_t"))).drop("_s", "_z", "_t")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_h", "doc_id", *carried)) + F.col("_before")
    chosen = ranked.withColumn("copies", F.col("copies") + (rank <= F.col("extra")).cast("int"))
    whole = joined.where((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).withColumn("copies", F.col("copies") + (F.col("extra") > 0).cast("int"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    both = whole.select(*columns, *carried).unionByName(chosen.select(*columns, *carried))
    return both.select(*columns, (F.col("copies") * F.col("size")).alias("taken"), *carried)
