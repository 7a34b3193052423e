"""Class prototypes: building, scoring, predicting and one-step learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.tables import settle
from vectorloom.functions.vectors import axpy, cosine, norm, normalise, vector_mean, vector_sum
from vectorloom.operators import slices, streams
from vectorloom.operators.training import scores


def class_means(df: DataFrame, keys: list[str], x: str = "x", mode: str | None = None) -> DataFrame:
    """Mean vector per key as w, normalised if a mode is given."""
    out = vector_mean(df, keys, x).withColumnRenamed(x, "w")
    return out.withColumn("w", normalise("w", mode)) if mode else out


def class_sums(df: DataFrame, keys: list[str], x: str = "x", mode: str | None = None) -> DataFrame:
    """Sum vector per key as w, normalised if a mode is given."""
    out = vector_sum(df, keys, x).withColumnRenamed(x, "w")
    return out.withColumn("w", normalise("w", mode)) if mode else out


def class_counts(df: DataFrame, clients: DataFrame, classes: DataFrame, client: str = "client", label: str = "y") -> DataFrame:
    """Rows per client and class, classes without rows included."""
    grid = clients.crossJoin(F.broadcast(classes))  # a few classes for each client
    return grid.join(df.groupBy(client, label).agg(F.count("*").alias("n")), [client, label], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


class Prototypes:
    """Class vectors of one key: labels in order, one row each."""

    def __init__(self, held: pa.RecordBatch, label: str, skip_zero: bool):
        rows = streams.wide(held.column("w"))
        k = held.column(label).to_numpy()
        keep = np.flatnonzero(np.linalg.norm(rows, axis=1) > 0) if skip_zero else np.arange(len(k))
        order = keep[np.argsort(k[keep], kind="stable")]
        self.k, self.w = k[order], rows[order]

    def judge(self, x: pa.Array, metric: str) -> tuple[pa.Array, pa.Array]:
        """Class and score of every vector, the smallest class on a tie; null for a null vector or without prototypes."""
        real = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) if len(self.k) else np.zeros(0, np.int64)
        at = np.full(len(x), -1, np.int64)
        top = np.zeros(len(x))
        if len(real):
            s = scores(streams.wide(x.drop_null()), self.w, metric)
            at[real], top[real] = s.argmax(axis=1), s.max(axis=1)
        none = pa.array(at < 0)
        return pa.array(self.k).take(pa.array(at, mask=at < 0)), pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(top))


def predict(df: DataFrame, protos: DataFrame, by: list[str], x: str = "x", label: str = "y", metric: str = "cos", skip_zero: bool = True, buckets: int | None = None) -> DataFrame:
    """Adds pred, the class of the most similar prototype of the row's key, and its score, in place of columns of those names.

    A key's prototypes come first in its group and its rows stream past them, so no
    row carries them; rows of keys without prototypes go.  ``buckets``: rows are
    stored in so many buckets of the key and stay where they are.  Without keys all
    rows have the same prototypes, model-sized, which travel with the job.  The
    smallest class wins a tie.  Zero prototypes never win if skip_zero is set.
    """
    if metric not in ("dot", "cos"):
        raise ValueError(f"unknown metric {metric!r}")
    kept = [c for c in df.columns if c not in ("pred", "score")]
    kind = protos.schema[label].dataType
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("pred", kind), T.StructField("score", T.DoubleType())])
    rows, state = df.select(*kept), protos.select(*by, label, F.col("w").cast("array<double>").alias("w"))
    if not by:
        whole = state.toArrow().combine_chunks().to_batches()
        if not whole:
            return rows.where(F.lit(False)).select(*kept, F.lit(None).cast(kind).alias("pred"), F.lit(None).cast("double").alias("score"))
        given = Prototypes(whole[0], label, skip_zero)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                yield pa.RecordBatch.from_arrays([*part.columns, *given.judge(part.column(x), metric)], [*kept, "pred", "score"])

        return rows.mapInArrow(run, schema)

    def work(key: tuple, held: pa.RecordBatch | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        own = Prototypes(held, label, skip_zero)
        for part in batches:
            cells = dict(zip(by, streams.repeated(key, part.num_rows), strict=True)) | {c: part.column(c) for c in kept if c not in by}
            yield pa.RecordBatch.from_arrays([*(cells[c] for c in kept), *own.judge(part.column(x), metric)], [*kept, "pred", "score"])

    return streams.beside(rows, state, by, work, schema, buckets=buckets)


def push_pull(rows: DataFrame, keys: list[str], x: str = "x", label: str = "y") -> DataFrame:
    """Update per key and class: wrong rows push their class and pull the predicted one.

    Columns keys, label, u.  The two signed copies of a wrong row are summed per
    dimension before they are shuffled.
    """
    wrong = rows.where(F.col("pred") != F.col(label))
    signed = F.explode(F.array(F.struct(F.col(label).alias("k"), F.lit(1.0).alias("g")), F.struct(F.col("pred").alias("k"), F.lit(-1.0).alias("g"))))
    moved = wrong.select(*keys, x, signed.alias("m")).select(*keys, F.col("m.k").alias(label), F.transform(x, lambda v: v * F.col("m.g")).alias("u"))
    return vector_sum(moved, [*keys, label], "u")


def push_pull_matmul(rows: DataFrame, keys: list[str], classes: int, x: str = "x", label: str = "y") -> DataFrame:
    """push_pull as a product of one-hot differences and rows: keys, label, u for each of so many classes.

    Each task multiplies its own rows; the shuffle carries classes x dimensions per
    key and task.
    """
    signs = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (F.col(label) == k).cast("double") - (F.col("pred") == k).cast("double"))
    wrong = rows.where(F.col("pred") != F.col(label)).select(*keys, x, F.posexplode(signs).alias(label, "_sign"))
    return vector_sum(wrong.select(*keys, label, F.transform(x, lambda v: v * F.col("_sign")).alias("u")), [*keys, label], "u")


def step(protos: DataFrame, updates: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Prototypes moved by rate times their update; those without one stay."""
    joined = protos.join(updates, keys, "left")
    return joined.withColumn("w", F.when(F.col("u").isNull(), F.col("w")).otherwise(axpy("w", "u", F.lit(rate)))).withColumn("changed", F.col("u").isNotNull()).drop("u")


def stale_step(df: DataFrame, protos: DataFrame, client: list[str], rate: float, metric: str = "cos", x: str = "x") -> DataFrame:
    """One batch on fixed prototypes: predict, push and pull, move."""
    rows = predict(df, protos, client, x, metric=metric)
    return step(protos, push_pull(rows, client, x), [*client, "y"], rate)


def error_ratio(rows: DataFrame, keys: list[str], label: str = "y") -> DataFrame:
    """Wrong rows over rows, per key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("pred") != F.col(label)).alias("wrong")).withColumn("ratio", F.col("wrong") / F.greatest("n", F.lit(1)))


def macro_accuracy(rows: DataFrame, client: str = "client", label: str = "y") -> DataFrame:
    per = rows.groupBy(client).agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("a"))
    return per.agg(F.avg("a").alias("accuracy"), F.count("*").alias("clients"))


def micro_accuracy(rows: DataFrame, label: str = "y") -> DataFrame:
    return rows.agg((F.count_if(F.col("pred") == F.col(label)) / F.count("*")).alias("accuracy"), F.count("*").alias("rows"))


def consensus(state: DataFrame, label: str, value: str, count: str | None = "n", mode: str | None = None) -> DataFrame:
    """Mean of the clients' vectors per class, weighted by counts if a column is named; 0 where they sum to 0."""
    out = vector_mean(state, [label], value, count)
    return out.withColumn(value, normalise(value, mode)) if mode else out


def memory_sum(state: DataFrame, label: str = "y", value: str = "w", mode: str | None = "plus") -> DataFrame:
    out = vector_sum(state, [label], value)
    return out.withColumn(value, normalise(value, mode)) if mode else out


def follow_ratio(n: Column, wrong: Column, alpha: float = 1.0, low: float = 0.1, high: float = 0.9) -> Column:
    """Share of the consensus that a class follows: more the more it errs, 0 without rows."""
    gate = 1 - F.greatest(F.least(1 - alpha * wrong / F.greatest(n, F.lit(1)), F.lit(high)), F.lit(low))
    return F.when(n > 0, gate).otherwise(0.0)


def gated_merge(local: Column | str, common: Column | str, rate: float, gate: Column) -> Column:
    """local + rate * gate * (common - local)."""
    return F.zip_with(local, common, lambda a, b: a + rate * gate * (b - a))


def nearest(df: DataFrame, centres: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Adds near_centre, near_x and near_distance of the nearest centre of the row's key, the first on a tie."""
    packed = centres.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("centre", F.col("c").alias("_x")))).alias("_centres"))
    away = lambda c: F.round(norm(F.zip_with(x, c["_x"], lambda a, b: a - b)), 9)
    best = F.array_min(F.transform("_centres", lambda c: F.struct(away(c).alias("distance"), c["centre"].alias("centre"), c["_x"].alias("x"))))
    kept = [c for c in df.columns if c not in ("near_centre", "near_x", "near_distance")]
    return df.select(*kept).join(packed, by).withColumn("_near", best).select(*kept, F.col("_near.centre").alias("near_centre"), F.col("_near.x").alias("near_x"), F.col("_near.distance").alias("near_distance"))


def kmeans(df: DataFrame, by: list[str], order: str, k: int, rounds: int, x: str = "x", least: float = 1e-6) -> DataFrame:
    """Lloyd's rounds from evenly spaced rows in order; an empty centre stays where it is.

    Columns by, centre, c.  The state is k centres per key, written after each round;
    rows never leave their partition but for sums per centre and dimension.  It ends
    early when no centre moves by more than ``least`` in any dimension.  A key with
    fewer rows than k has centres that coincide.
    """
    placed = settle(slices.ordinals(df.select(*by, order, F.col(x).alias("c")), by, [order], "at"), "ordered")
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("centre"), F.floor(i * (F.col("n") - 1) / max(k - 1, 1)).alias("at")))
    wanted = sizes.select(*by, F.explode(picks).alias("p")).select(*by, "p.centre", "p.at")  # k rows per key
    hits = placed.join(F.broadcast(wanted) if not by else wanted, [*by, "at"])
    centres = settle(hits.select(*by, "centre", "c"), "centres")
    for _ in range(rounds):
        means = vector_mean(nearest(df, centres, by, x).select(*by, F.col("near_centre").alias("centre"), F.col(x).alias("m")), [*by, "centre"], "m")
        moved = centres.join(means, [*by, "centre"], "left").select(*by, "centre", F.coalesce("m", "c").alias("c"), F.array_max(F.zip_with("c", F.coalesce("m", "c"), lambda a, b: F.abs(a - b))).alias("_step"))
        centres = settle(moved, "centres", replaces=centres)
        if (centres.agg(F.max("_step")).first()[0] or 0.0) <= least:
            break
    return centres.drop("_step")


def squared_error(df: DataFrame, centres: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Sum of squared distances of the rows to their nearest centres, per key: by, sse."""
    return nearest(df, centres, by, x).groupBy(*by).agg(F.sum(F.pow("near_distance", 2)).alias("sse"))


def pull(df: DataFrame, centres: DataFrame, by: list[str], beta: float, x: str = "x") -> DataFrame:
    """Moves vectors by beta towards the nearest centre of their key and keeps their norm."""
    near = nearest(df.withColumn("_unit", normalise(x, "clamp")), centres, by, "_unit")
    moved = normalise(axpy(F.transform("_unit", lambda v: v * (1 - beta)), "near_x", F.lit(beta)), "clamp")
    sized = F.zip_with(moved, F.array_repeat(norm(x), F.size(x)), lambda a, b: a * b)
    return near.withColumn(x, sized).withColumnRenamed("near_centre", "centre").drop("_unit", "near_x", "near_distance")


def alpha_grid(df: DataFrame, shared: DataFrame, personal: DataFrame, by: list[str], alphas: list[float], x: str = "x") -> DataFrame:
    """The mixing weight of two prototype sets that predicts best per key, the first on a tie."""
    both = shared.join(personal.withColumnRenamed("w", "p"), [*by, "y"])
    packed = both.groupBy(*by).agg(F.collect_list(F.struct(F.col("y").alias("k"), "w", "p")).alias("_ps"))
    pairs = df.join(packed, by).withColumn("_s", F.transform("_ps", lambda p: F.struct(p["k"].alias("k"), cosine(x, p["w"]).alias("a"), cosine(x, p["p"]).alias("b"))))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha")) for i, a in enumerate(alphas)]))
    tried = pairs.select(*by, "y", "_s", grid.alias("g"))
    pred = -F.array_max(F.transform("_s", lambda s: F.struct(F.round(F.col("g.alpha") * s["a"] + (1 - F.col("g.alpha")) * s["b"], 9).alias("s"), (-s["k"]).alias("k"))))["k"]
    acc = tried.withColumn("pred", pred).groupBy(*by, "g.i", "g.alpha").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"))
    return acc.groupBy(*by).agg(F.max_by("alpha", F.struct(F.round("accuracy", 9), -F.col("i"))).alias("alpha"), F.max("accuracy").alias("accuracy"))


