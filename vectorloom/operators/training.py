"""Local training of clients: what depends on the order of batches is one pass over sorted rows.

A client's state comes first in its group, then its samples in the order of the
epoch.  A task holds the state of one client, sized by the model, and one Arrow
batch of rows, however many rows the client has.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions import rng
from vectorloom.functions.vectors import EPS
from vectorloom.operators import streams



def unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=-1, keepdims=True) + EPS)


def safe_unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def scores(x: np.ndarray, w: np.ndarray, metric: str) -> np.ndarray:
    if metric not in ("dot", "cos"):
        raise ValueError(f"unknown metric {metric!r}")
    raw = x @ w.T
    if metric == "cos":
        raw = raw / (np.maximum(np.linalg.norm(x, axis=1), EPS)[:, None] * np.maximum(np.linalg.norm(w, axis=1), EPS)[None, :])
    return np.round(raw, 9)


def signed_updates(x: np.ndarray, y: np.ndarray, pred: np.ndarray, classes: int) -> np.ndarray:
    """Sum of wrong rows at their class less their sum at the predicted class."""
    wrong = pred != y
    out = np.zeros((classes, x.shape[1]))
    np.add.at(out, y[wrong], x[wrong])
    np.add.at(out, pred[wrong], -x[wrong])
    return out


class Learner:
    """State of one client's classes.  ``fields`` are its arrays, ``inputs`` those of a sample.

    take() sees rows of a batch, with predictions on the state as it stood when the
    batch began; step() ends the batch and moves the state.
    """

    fields: tuple[str, ...]
    inputs: tuple[str, ...]

    def start(self, held: dict[str, np.ndarray], own: np.ndarray | None = None) -> None:
        """``own`` are vectors of the client that training doesn't change, if it has any."""
        self.held = {k: v.copy() for k, v in held.items()}
        self.own = own
        self.classes = len(next(iter(held.values())))
        self.errors = np.zeros(self.classes, np.int64)
        self.clear()

    def clear(self) -> None:
        self.moves: dict[str, np.ndarray] = {}
        self.wrong = np.zeros(self.classes, np.int64)

    def move(self, part: str, u: np.ndarray) -> None:
        self.moves[part] = self.moves.get(part, 0) + u

    def take(self, z: dict[str, np.ndarray], y: np.ndarray) -> None:
        raise NotImplementedError

    def apply(self) -> None:
        """Moves the state by what a batch with mistakes gathered."""
        raise NotImplementedError

    def step(self) -> None:
        if self.wrong.any():
            self.apply()
            self.errors += self.wrong
        self.clear()

    def finish(self) -> dict[str, np.ndarray]:
        return self.held


@dataclass
class Memory(Learner):
    """Full memories w and their change delta.

    ``renormalise``: rows of w after the last batch ("end"), after each batch with a
    mistake ("batch"), only those that moved ("changed"), or never (None).  A
    ``mask`` (0 or 1 per dimension) keeps updates, and the norm at the end, to its
    dimensions; a ``basis`` (rank x dimensions) projects updates onto its rows.
    """

    rate: float
    metric: str = "cos"
    unit_rows: bool = False
    renormalise: str | None = "end"
    mask: np.ndarray | None = None
    basis: np.ndarray | None = None
    fields = ("w", "delta")
    inputs = ("h",)

    def start(self, held: dict[str, np.ndarray], own: np.ndarray | None = None) -> None:
        check_update(held["w"].shape[1], self.mask, self.basis)
        super().start(held, own)

    def take(self, z: dict[str, np.ndarray], y: np.ndarray) -> None:
        x = safe_unit(z["h"]) if self.unit_rows else z["h"]
        pred = scores(x, self.held["w"], self.metric).argmax(axis=1)
        self.wrong += np.bincount(y[pred != y], minlength=self.classes)
        self.move("w", signed_updates(x, y, pred, self.classes))

    def apply(self) -> None:
        u = self.moves["w"]
        u = u if self.mask is None else u * self.mask
        u = self.rate * (u if self.basis is None else (u @ self.basis.T) @ self.basis)
        w = self.held["w"] + u
        self.held["delta"] = self.held["delta"] + u
        if self.renormalise == "batch":
            w = unit(w)
        elif self.renormalise == "changed":
            moved = np.abs(u).sum(axis=1) > 0
            w[moved] = safe_unit(w[moved])
        self.held["w"] = w

    def finish(self) -> dict[str, np.ndarray]:
        if self.renormalise == "end":
            w = self.held["w"]
            if self.mask is None:
                self.held["w"] = unit(w)
            else:
                inside = np.asarray(self.mask) != 0
                w[:, inside] = unit(w[:, inside])
        return self.held


@dataclass
class Coefficients(Learner):
    """Coefficients of common c, global g, a client's change d of c, and personal p.

    c and g move by the shared rate, d and p by the personal one.
    """

    rate: float
    personal_rate: float
    metric: str = "dot"
    fields = ("c", "g", "d", "p")
    inputs = ("zc", "zg", "zp")

    def take(self, z: dict[str, np.ndarray], y: np.ndarray) -> None:
        s = self.held
        pred = scores(np.hstack([z["zc"], z["zg"], z["zp"]]), np.hstack([s["c"] + s["d"], s["g"], s["p"]]), self.metric).argmax(axis=1)
        self.wrong += np.bincount(y[pred != y], minlength=self.classes)
        for part, rows in (("c", "zc"), ("g", "zg"), ("p", "zp")):
            self.move(part, signed_updates(z[rows], y, pred, self.classes))

    def apply(self) -> None:
        for part, source, rate in (("c", "c", self.rate), ("g", "g", self.rate), ("d", "c", self.personal_rate), ("p", "p", self.personal_rate)):
            self.held[part] = self.held[part] + rate * self.moves[source]


@dataclass
class FullSpace(Learner):
    """Coefficients c, g, d, p that predict by whole memories: rows are compared with all of their dimensions.

    ``common`` and ``extra`` are bases of all clients (dimensions x rank); a client's
    own one comes with its state, a vector per row.  Mistakes are summed in full
    vectors and move the coefficients by their coordinates.
    """

    rate: float
    personal_rate: float
    common: np.ndarray
    extra: np.ndarray
    metric: str = "cos"
    fields = ("c", "g", "d", "p")
    inputs = ("h",)

    def memory(self) -> np.ndarray:
        s = self.held
        w = (s["c"] + s["d"]) @ self.common.T + s["g"] @ self.extra.T + s["p"] @ self.own
        return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), EPS)

    def clear(self) -> None:
        super().clear()
        self.whole = self.memory()  # as it stands when a batch begins

    def take(self, z: dict[str, np.ndarray], y: np.ndarray) -> None:
        pred = scores(z["h"], self.whole, self.metric).argmax(axis=1)
        self.wrong += np.bincount(y[pred != y], minlength=self.classes)
        self.move("u", signed_updates(z["h"], y, pred, self.classes))

    def apply(self) -> None:
        u = self.moves["u"]
        common = u @ self.common
        for part, move, rate in (("c", common, self.rate), ("g", u @ self.extra, self.rate), ("d", common, self.personal_rate), ("p", u @ self.own.T, self.personal_rate)):
            self.held[part] = self.held[part] + rate * move


@dataclass
class Mixed(Learner):
    """Row-normalised coordinates of a shared basis, s, and a personal one, p, mixed by alpha.

    Samples and state are of unit rows; state rows are normalised again after each
    batch with a mistake.  ``alpha`` is a column of the state, equal for all classes.
    """

    rate: float
    personal_rate: float
    fields = ("s", "p", "alpha")
    inputs = ("zs", "zp")

    def take(self, z: dict[str, np.ndarray], y: np.ndarray) -> None:
        zs, zp, a = unit(z["zs"]), unit(z["zp"]), self.held["alpha"][0, 0]
        pred = np.round(a * scores(zs, self.held["s"], "cos") + (1 - a) * scores(zp, self.held["p"], "cos"), 9).argmax(axis=1)
        self.wrong += np.bincount(y[pred != y], minlength=self.classes)
        self.move("s", signed_updates(zs, y, pred, self.classes))
        self.move("p", signed_updates(zp, y, pred, self.classes))

    def apply(self) -> None:
        self.held["s"] = unit(self.held["s"] + self.rate * self.moves["s"])
        self.held["p"] = unit(self.held["p"] + self.personal_rate * self.moves["p"])


def check_update(dims: int, mask: np.ndarray | None, basis: np.ndarray | None) -> None:
    """Raises if a mask or a basis of updates doesn't fit vectors of so many dimensions."""
    if mask is not None and np.shape(mask) != (dims,):
        raise ValueError(f"an update mask must have {dims} entries, not shape {np.shape(mask)}")
    if basis is not None and (np.ndim(basis) != 2 or np.shape(basis)[1] != dims):
        raise ValueError(f"an update basis must have rows of {dims} entries, not shape {np.shape(basis)}")


def run_batches(learner: Learner, held: dict[str, np.ndarray], z: dict[str, np.ndarray], y: np.ndarray, size: int, epochs: int = 1) -> Learner:
    """Trains on arrays that are in order already; size 0 takes all rows as one batch."""
    one = copy.deepcopy(learner)
    one.start(held)
    for _ in range(epochs):
        for a in range(0, len(y), size or max(len(y), 1)):
            b = a + (size or len(y))
            one.take({k: v[a:b] for k, v in z.items()}, y[a:b])
            one.step()
    return one


def local(samples: DataFrame, state: DataFrame, client: str, learner: Learner, batch: int = 0, epochs: int = 1, seed: int = 0, round_: int = 0, buckets: int | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """Trains every client that has state: client, y, the learner's fields, errors.

    samples: client, sample, y and the learner's inputs; state: client, y and its
    fields, arrays of doubles.  An epoch takes a client's samples by the digest of
    seed, round, epoch and sample, in batches of so many rows (0: all of them).
    Samples of classes or clients without state are passed over, and a client
    without samples keeps its state.  errors counts the mistakes per class.
    Rows of one client are taken one after the other, which is what the method is.

    An epoch is one pass of the samples beside the state that the epoch before
    left.  ``buckets``: samples are stored in so many buckets of their client, so
    only the state moves.  ``fixed`` (client, r, b) are vectors of a client that its
    learner needs and doesn't change.
    """
    fields, inputs = learner.fields, learner.inputs
    array = T.ArrayType(T.DoubleType())
    label, with_own = state.schema["y"].dataType, fixed is not None
    now = state.select(client, F.col("y").cast("bigint").alias("y"), *[F.col(c).cast(array).alias(c) for c in fields], F.lit(0).cast("bigint").alias("errors"))
    rows = samples.select(client, F.col("sample").cast("bigint").alias("sample"), F.col("y").cast("bigint").alias("y"), *[F.col(c).cast(array).alias(c) for c in inputs])

    def epoch(last: bool) -> streams.Work:
        def work(key: tuple, held: pa.RecordBatch | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held is None:
                return
            own = None
            if with_own:
                basis = held.filter(held.column("r").is_valid())
                held = held.filter(held.column("r").is_null())
                if not (held.num_rows and basis.num_rows):
                    return
                own = streams.wide(basis.column("b"))[np.argsort(basis.column("r").to_numpy(), kind="stable")]
            labels = held.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(labels, kind="stable")
            labels, errors = labels[order], held.column("errors").to_numpy(zero_copy_only=False).astype(np.int64)[order]
            arrays = {f: streams.wide(held.column(f))[order] for f in fields}
            one, filled, seen = copy.deepcopy(learner), 0, False
            one.start(arrays, own)
            for part in batches:
                seen = seen or part.num_rows > 0
                y = part.column("y").to_numpy()
                known = np.isin(y, labels)
                z, y = {c: streams.wide(part.column(c))[known] for c in inputs}, np.searchsorted(labels, y[known])
                at = 0
                while at < len(y):
                    n = min(len(y) - at, batch - filled) if batch else len(y) - at
                    one.take({k: v[at : at + n] for k, v in z.items()}, y[at : at + n])
                    filled, at = filled + n, at + n
                    if filled == batch:
                        one.step()
                        filled = 0
            one.step()
            arrays = (one.finish() if last else one.held) if seen else arrays
            yield pa.RecordBatch.from_arrays([*streams.repeated(key, len(labels)), pa.array(labels), *(streams.lists(arrays[f]) for f in fields), pa.array(errors + one.errors)], [client, "y", *fields, "errors"])

        return work

    schema = T.StructType([state.schema[client], T.StructField("y", T.LongType()), *(T.StructField(f, array) for f in fields), T.StructField("errors", T.LongType())])
    for e in range(epochs):
        turn = rng.digest(seed, F.lit(round_), F.lit(e), F.col("sample"))
        if fixed is not None:
            now = now.unionByName(fixed.select(client, "r", F.col("b").cast(array).alias("b")), allowMissingColumns=True)
        now = streams.beside(rows, now, [client], epoch(e == epochs - 1), schema, [turn, F.col("sample")], buckets)
    return now.withColumn("y", F.col("y").cast(label))
