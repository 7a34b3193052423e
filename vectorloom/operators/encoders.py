"""Encoders of samples into hypervectors: projections, masks, packings.

A projection is a table of one row per input feature with the weights of all
output dimensions.  Its size is features x dimensions, fixed by the model and
not by the data, so it is sent to every task; rows are encoded where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions import rng
from vectorloom.functions.vectors import EPS, normalise

TWO_PI = 6.283185307179586


def projection(spark: SparkSession, features: int, dims: int, seed: int, binary: bool = False) -> DataFrame:
    """Rows f, w: normal weights (or signs) that any engine can draw again."""
    cells = spark.range(features).select(F.col("id").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("d"))
    w = rng.normal(seed, F.col("f"), F.col("d"))
    w = F.when(w < 0, -1.0).otherwise(1.0) if binary else w
    return cells.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", w.alias("w")))), lambda c: c["w"]).alias("w"))


def weights(table: DataFrame) -> np.ndarray:
    """A projection as a matrix, features x dimensions; model-sized."""
    rows = table.orderBy("f").toPandas()
    return np.array(rows["w"].tolist(), dtype=np.float64)


def phases(dims: int, seed: int) -> Column:
    """Random phases of the output dimensions as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: TWO_PI * rng.uniform(seed, F.lit("phase"), d))


def rowwise(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], x: str, out: str) -> DataFrame:
    """Adds out, the rows of f(matrix of x), one call per Arrow batch; a null x gives null.

    It is an operator of its own in the plan, so that nothing of it can be inlined
    into an expression that Python can't run in.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.DoubleType(), True), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(x)
            real = column.drop_null()
            flat = real.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = f(flat.reshape(len(real), -1)) if len(real) else np.zeros((0, 0))
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), rows.shape[1], 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            result = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()), mask=column.is_null() if column.null_count else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), result], [*kept, out])

    return df.select(*kept, *([x] if x not in kept else [])).mapInArrow(run, schema)


def multiply(df: DataFrame, w: np.ndarray, x: str = "x", out: str = "z") -> DataFrame:
    """Adds x times w: one matrix product per Arrow batch."""
    return rowwise(df, lambda rows: rows @ w, x, out)


def unit_cosines(z: np.ndarray) -> np.ndarray:
    c = np.cos(z)
    return c / (np.linalg.norm(c, axis=1, keepdims=True) + EPS)


def encode_cosine(df: DataFrame, w: np.ndarray, x: str = "x", out: str = "h", phase: Column | None = None, mode: str = "plus") -> DataFrame:
    """Adds rownorm(cos(x w + phase))."""
    if phase is None and mode == "plus":
        return rowwise(df, lambda rows: unit_cosines(rows @ w), x, out)
    z = multiply(df, w, x, "_z")
    turned = F.transform("_z", F.cos) if phase is None else F.transform(F.zip_with("_z", phase, lambda a, b: a + b), F.cos)
    return z.withColumn(out, normalise(turned, mode)).drop("_z")


def encode_sign(df: DataFrame, w: np.ndarray, x: str = "x", out: str = "h") -> DataFrame:
    """Adds sign(x w), with +1 for zero."""
    return multiply(df, w, x, "_z").withColumn(out, F.transform("_z", lambda v: F.when(v < 0, -1.0).otherwise(1.0))).drop("_z")


def masks(spark: SparkSession, features: int, dims: int, size: int, seed: int) -> DataFrame:
    """Rows f, d: the ``size`` random features that each output dimension sees."""
    cells = spark.range(features).select(F.col("id").cast("int").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("d"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("d").orderBy(rng.digest(seed, F.lit("mask"), F.col("f"), F.col("d")), "f"))
    return cells.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r")


def masked(w: np.ndarray, table: DataFrame) -> np.ndarray:
    """Weights outside the mask set to zero."""
    kept = table.toPandas()
    out = np.zeros_like(w)
    out[kept["f"], kept["d"]] = w[kept["f"], kept["d"]]
    return out


def contiguous_groups(features: int, groups: int) -> list[np.ndarray]:
    """Features cut into runs of nearly equal length."""
    return np.array_split(np.arange(features), groups)


def block_weights(w: np.ndarray, groups: list[np.ndarray], shares: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Output dimensions dealt to groups in runs: each sees its group's features only.

    Returns the weights and the factor of each dimension, the root of its group's share.
    """
    shares = shares or [1 / len(groups)] * len(groups)
    out, factor = np.zeros_like(w), np.zeros(w.shape[1])
    for features, dims, share in zip(groups, np.array_split(np.arange(w.shape[1]), len(groups)), shares, strict=True):
        out[np.ix_(features, dims)] = w[np.ix_(features, dims)]
        factor[dims] = np.sqrt(share)
    return out, factor


def encode_block(df: DataFrame, w: np.ndarray, groups: list[np.ndarray], x: str = "x", out: str = "h", shares: list[float] | None = None) -> DataFrame:
    """Block packing: each group fills its own output dimensions, scaled by the root of its share (equal shares if none are given)."""
    blocks, factor = block_weights(w, groups, shares)

    def pack(rows: np.ndarray) -> np.ndarray:
        h = np.cos(rows @ blocks) * factor
        return h / (np.linalg.norm(h, axis=1, keepdims=True) + EPS)

    return rowwise(df, pack, x, out)


def encode_groups(df: DataFrame, w: np.ndarray, groups: list[np.ndarray], x: str = "x") -> DataFrame:
    """Adds h0, h1, …: every group's own cosine features over all output dimensions."""
    for g, features in enumerate(groups):
        own = np.zeros_like(w)
        own[features] = w[features]
        df = encode_cosine(df, own, x, f"h{g}")
    return df


def encode_superposition(df: DataFrame, w: np.ndarray, groups: list[np.ndarray], keys: np.ndarray, x: str = "x", out: str = "h") -> DataFrame:
    """Superposition packing: group features, bound to the groups' sign keys, add up."""
    bound = keys * np.sqrt(1 / len(groups))

    def pack(rows: np.ndarray) -> np.ndarray:
        total = sum(unit_cosines(rows[:, features] @ w[features]) * bound[g] for g, features in enumerate(groups))
        return total / (np.linalg.norm(total, axis=1, keepdims=True) + EPS)

    return rowwise(df, pack, x, out)


def encode_hashed(df: DataFrame, w: np.ndarray, groups: list[np.ndarray], slots: np.ndarray, signs: np.ndarray, dims: int, x: str = "x", out: str = "h") -> DataFrame:
    """Hash packing: group features are scattered with signs into ``dims`` slots."""
    spread = np.zeros((len(slots), dims))
    spread[np.arange(len(slots)), slots] = signs * np.sqrt(1 / len(groups))

    def pack(rows: np.ndarray) -> np.ndarray:
        packed = np.hstack([unit_cosines(rows[:, g] @ w[g]) for g in groups]) @ spread
        return packed / (np.linalg.norm(packed, axis=1, keepdims=True) + EPS)

    return rowwise(df, pack, x, out)


def encode_residual(df: DataFrame, full: np.ndarray, packed: np.ndarray, groups: list[np.ndarray], eta: float, x: str = "x", out: str = "h") -> DataFrame:
    """A full and a packed branch side by side, weighted by 1 - eta and eta."""
    two = encode_block(encode_cosine(df, full, x, "_full"), packed, groups, x, "_packed")
    joined = F.concat(F.transform("_full", lambda v: v * float(np.sqrt(1 - eta))), F.transform("_packed", lambda v: v * float(np.sqrt(eta))))
    return two.withColumn(out, normalise(joined, "plus")).drop("_full", "_packed")


def learn_groups(df: DataFrame, classes: int, groups: int, topk: int, hidden: int = 16, epochs: int = 60, rate: float = 0.01, seed: int = 0, rows: int = 20_000) -> tuple[list[np.ndarray], list[float]]:
    """Features per group, and the groups' shares, as a small network finds them relevant.

    A bounded sample of ``rows`` rows (by hash of x) trains one hidden layer by Adam;
    group_relevance() reads its weights.
    """
    total = df.count()
    part = df.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int(min(1.0, rows / max(total, 1)) * (1 << 20)) + 1).select("x", "y").toPandas()
    x, y = np.stack(part["x"].to_numpy()).astype(np.float64), part["y"].to_numpy(np.int64)
    draw = np.random.default_rng(seed)
    p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), (hidden, classes)), np.zeros(classes)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    target = np.eye(classes)[y]
    for step in range(1, epochs + 1):
        pre = x @ p[0] + p[1]
        act = np.maximum(pre, 0)
        out = act @ p[2] + p[3]
        soft = np.exp(out - out.max(axis=1, keepdims=True))
        slope = (soft / soft.sum(axis=1, keepdims=True) - target) / len(x)
        back = (slope @ p[2].T) * (pre > 0)
        for i, g in enumerate((x.T @ back, back.sum(axis=0), act.T @ slope, slope.sum(axis=0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return group_relevance(p[0], p[2], groups, topk)


def group_relevance(first: np.ndarray, second: np.ndarray, groups: int, topk: int) -> tuple[list[np.ndarray], list[float]]:
    """Features of each group and the groups' shares, from the weights of a network with one hidden layer.

    Hidden units are dealt to groups in turn.  A unit passes its mean absolute
    weight over the classes on to the features, by its absolute weights from them; a
    group takes the ``topk`` features of most relevance, the first on a tie, and
    weighs its share of all relevance.  first is features x hidden, second hidden x classes.
    """
    unit = np.abs(second).mean(axis=1)
    relevance = np.stack([np.abs(first[:, g::groups]) @ unit[g::groups] for g in range(groups)])
    total = np.maximum(relevance.sum(axis=1), 1e-8)
    return [np.sort(np.argsort(-r, kind="stable")[:topk]) for r in np.round(relevance, 12)], (total / total.sum()).tolist()


def group_masks(mode: str, features: int, groups: int, seed: int = 0, topk: int | None = None) -> list[np.ndarray]:
    """Features of each group without labels: contiguous or random parts of all, or random choices of ``topk`` each."""
    draw = np.random.default_rng(seed)
    if mode == "contiguous_partition":
        return np.array_split(np.arange(features), groups)
    if mode == "random_partition":
        return [np.sort(part) for part in np.array_split(draw.permutation(features), groups)]
    if mode == "random_topk":
        return [np.sort(draw.choice(features, min(topk or features // groups, features), replace=False)) for _ in range(groups)]
    raise ValueError(f"unknown group mode {mode!r}")


@dataclass
class PackedEncoder:
    """Block packing with groups by any mode; the ``mlp`` mode learns its groups from labelled samples first."""

    weights: np.ndarray
    mode: str = "contiguous_partition"
    groups: int = 4
    topk: int | None = None
    seed: int = 0
    masks: list[np.ndarray] | None = None
    shares: list[float] | None = None

    def __post_init__(self) -> None:
        if self.mode != "mlp" and self.masks is None:
            self.masks = group_masks(self.mode, len(self.weights), self.groups, self.seed, self.topk)

    def fit(self, samples: DataFrame, classes: int) -> PackedEncoder:
        if self.mode == "mlp":
            self.masks, self.shares = learn_groups(samples, classes, self.groups, self.topk or max(1, len(self.weights) // self.groups), seed=self.seed)
        return self

    def encode(self, samples: DataFrame, x: str = "x", out: str = "h") -> DataFrame:
        if self.masks is None:
            raise RuntimeError("an encoder with learned groups must be fitted before it encodes")
        return encode_block(samples, self.weights, self.masks, x, out, self.shares)
