"""Low-rank bases: Gram aggregation, eigenvectors, completion, projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


#: Matrices that one task merges.
FAN = 16


def merged(df: DataFrame, x: str, partial: Callable[[np.ndarray], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray], fan: int = FAN) -> np.ndarray | None:
    """One matrix of all rows: ``partial`` of an Arrow batch's rows, combined in tasks and then in a tree of ``fan`` at a time.

    What is shuffled and what reaches the driver is one matrix per task or node, of
    the model's size and not of the data's.  None without rows; null rows count nothing.
    """

    def packed(part: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["part", "width", "m"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                now = partial(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1))
                total = now if total is None else combine(total, now)
        if total is not None:
            yield packed(TaskContext.get().partitionId(), total)

    def node(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((p, w, m) for batch in batches for p, w, m in zip(*(batch.column(c).to_pylist() for c in ("part", "width", "m")), strict=True))
        total = None
        for _, width, m in held:
            now = np.frombuffer(m, np.float64).reshape(-1, width)
            total = now if total is None else combine(total, now)
        yield packed(key[0].as_py(), total)

    node.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "part int, width int, m binary"
    level = df.select(x).mapInArrow(leaf, schema)
    tasks = df.rdd.getNumPartitions()
    while tasks > fan:
        level = level.withColumn("to", F.floor(F.col("part") / fan).cast("int")).groupBy("to").applyInArrow(node, schema)
        tasks = -(-tasks // fan)
    out = None
    for r in level.orderBy("part").collect():  # ``fan`` matrices at most
        now = np.frombuffer(bytes(r.m), np.float64).reshape(-1, r.width)
        out = now if out is None else combine(out, now)
    return out


def covariance(df: DataFrame, x: str = "w") -> np.ndarray:
    """Sum of the outer products of all rows; dimensions x dimensions."""
    total = merged(df, x, lambda m: m.T @ m, np.add)
    return np.zeros((0, 0)) if total is None else total


def gram(df: DataFrame, x: str = "w") -> DataFrame:
    """Sum of the outer products of all rows, as rows (i, g)."""
    total = covariance(df, x)
    rows = [(i, row.tolist()) for i, row in enumerate(total)]
    return df.sparkSession.createDataFrame(rows, "i int, g array<double>")


def matrix(table: DataFrame) -> np.ndarray:
    """A gram table as a matrix; its size is that of the vectors, not of the data."""
    rows = table.orderBy("i").toPandas()
    return np.array(rows["g"].tolist(), dtype=np.float64)


def right_vectors(df: DataFrame, rank: int, x: str = "w", oversample: int = 8, power: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of the matrix of all rows, and their right vectors as columns with canonical signs.

    A randomised range finder: rows meet a seeded sketch of rank + oversample
    directions, ``power`` more passes turn it to the leading ones, and a tall-skinny
    QR of the rows in the found range (its R factors merged in a tree) gives values
    and vectors.  Passes shuffle dimensions x sketch numbers a task, never
    dimensions squared.
    """
    first = df.select(F.size(x).alias("d")).where("d >= 0").first()
    if first is None or rank <= 0:
        return np.zeros(0), np.zeros((first.d if first else 0, 0))
    d = first.d
    q = np.random.default_rng(seed).normal(size=(d, min(d, rank + oversample)))
    for _ in range(power + 1):
        # rows times the sketch and back: the sum over tasks of their own products
        q, _r = np.linalg.qr(merged(df, x, lambda m, q=q: m.T @ (m @ q), np.add))
    r = merged(df, x, lambda m: np.linalg.qr(m @ q, mode="r"), lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r"))
    _, values, turn = np.linalg.svd(r)
    return values[:rank], canonical_signs((q @ turn.T)[:, :rank])


def canonical_signs(basis: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive, the first on a tie."""
    if basis.size == 0:
        return basis
    at = np.abs(np.round(basis, 12)).argmax(axis=0)
    turn = np.sign(basis[at, np.arange(basis.shape[1])])
    return basis * np.where(turn == 0, 1, turn)


def orthonormal(x: np.ndarray, eps: float = EPS) -> np.ndarray:
    """Orthonormal columns that span x; directions below eps go."""
    if x.size == 0:
        return x
    q, r = np.linalg.qr(x)
    return q[:, np.abs(np.diag(r)) > eps]


def orthogonal_to(x: np.ndarray, reference: np.ndarray | None) -> np.ndarray:
    """Orthonormal columns of x without their part in the reference basis."""
    if reference is None or reference.size == 0:
        return orthonormal(x)
    for _ in range(2):  # the second pass removes what rounding left
        x = x - reference @ (reference.T @ x)
    return orthonormal(x)


def complete(basis: np.ndarray, rank: int, reference: np.ndarray | None = None, seed: int | None = None) -> np.ndarray:
    """Adds vectors, made orthogonal to what there is, until the rank is reached.

    They are unit vectors, or random ones first if a seed is given.
    """
    d = basis.shape[0]
    random = [] if seed is None else list(np.random.default_rng(seed).normal(size=(max(rank - basis.shape[1], 0), d)))
    for v in [*random, *np.eye(d)]:
        if basis.shape[1] >= rank:
            break
        held = basis if reference is None else np.hstack([reference, basis])
        new = orthogonal_to(v[:, None], held)
        basis = np.hstack([basis, new])
    return basis[:, :rank]


def top_basis(cov: np.ndarray, rank: int, reference: np.ndarray | None = None, oversample: int = 1, fill: bool = False) -> np.ndarray:
    """Leading eigenvectors, largest first, with canonical signs.

    With a reference, more of them are taken, made orthogonal to it, and cut.  A
    covariance of nothing gives zero columns, or unit vectors if ``fill`` is set.
    """
    d = len(cov)
    if np.abs(cov).max(initial=0) <= EPS:
        basis = np.zeros((d, 0))
    else:
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        take = min(rank * oversample, d)
        vectors, values = vectors[:, ::-1][:, :take], values[::-1][:take]
        basis = orthogonal_to(vectors[:, values > EPS * max(values[0], 1)], reference)[:, :rank]
    if fill:
        basis = complete(basis, rank, reference)
    elif basis.shape[1] < rank:
        basis = np.hstack([basis, np.zeros((d, rank - basis.shape[1]))])
    return canonical_signs(basis)


def shared_basis(protos: DataFrame, common: int, extra: int, x: str = "w") -> tuple[np.ndarray, np.ndarray, float]:
    """Basis of all clients' prototypes, split in two, and the energy that it explains."""
    cov = covariance(protos, x)
    basis = top_basis(cov, common + extra)
    energy = float(np.trace(basis.T @ cov @ basis) / max(np.trace(cov), EPS))
    return basis[:, :common], basis[:, common:], energy


def singular_basis(m: np.ndarray, rank: int, full: bool) -> np.ndarray:
    """Right singular vectors as columns with canonical signs, completed by unit vectors up to the rank."""
    _, _, vt = np.linalg.svd(m, full_matrices=full)
    return canonical_signs(complete(vt.T[:, :rank], rank))


def explained(protos: DataFrame, basis: np.ndarray, x: str = "w") -> float:
    """Share of the energy of all rows that a basis explains."""
    cov = covariance(protos, x)
    return float(np.trace(basis.T @ cov @ basis) / max(np.trace(cov), EPS))


def project(df: DataFrame, basis: np.ndarray, x: str, out: str) -> DataFrame:
    """Adds x times the basis."""
    from vectorloom.operators.encoders import multiply

    return multiply(df, basis, x, out)


def per_client(df: DataFrame, client: str, x: str, rank: int, reference: np.ndarray | None = None, label: str = "y", policy: str = "gram") -> DataFrame:
    """Personal basis of each client from its own rows: client, r, b, and its effective rank.

    ``policy``: eigenvectors of the rows' Gram matrix made orthogonal to the
    reference ("gram"), or right singular vectors of the rows, as many as they have
    ("reduced_svd") or all, so that those of no energy fill the rank ("full_svd").
    A client's rows are its classes, so a group is model-sized.
    """
    if policy not in ("gram", "reduced_svd", "full_svd"):
        raise ValueError(f"unknown policy {policy!r}")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows.sort_values(label)[x].to_numpy()).astype(np.float64)
        basis = top_basis(m.T @ m, rank, reference, oversample=2, fill=True) if policy == "gram" else singular_basis(m, rank, policy == "full_svd")
        top = np.linalg.norm(m, 2) ** 2 if m.size else 0.0
        return pd.DataFrame({client: rows[client].iloc[0], "r": range(rank), "b": list(basis.T), "effective_rank": float((m**2).sum() / top) if top > 0 else 0.0})

    kind = df.schema[client].dataType.simpleString()
    return df.select(client, label, x).groupBy(client).applyInPandas(fit, f"{client} {kind}, r int, b array<double>, effective_rank double")


def principal_angle(a: np.ndarray, b: np.ndarray) -> float:
    """Mean principal angle between two bases, in degrees."""
    return float(np.degrees(np.arccos(np.clip(np.linalg.svd(a.T @ b, compute_uv=False), -1, 1))).mean())


def client_angles(personal: DataFrame, client: str = "client") -> DataFrame:
    """Mean principal angle of every pair of clients' bases: i, j, degrees.

    A row per pair of clients is the result; a basis is model-sized.
    """
    packed = personal.groupBy(client).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]).alias("basis"))

    @F.pandas_udf("double")
    def angle(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([principal_angle(np.stack(p).T, np.stack(q).T) for p, q in zip(a, b, strict=True)], dtype=float)

    pairs = packed.select(F.col(client).alias("i"), F.col("basis").alias("p")).join(packed.select(F.col(client).alias("j"), F.col("basis").alias("q")), F.col("i") < F.col("j"))
    return pairs.select("i", "j", angle("p", "q").alias("degrees"))
