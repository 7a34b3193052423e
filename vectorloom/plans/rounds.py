"""Federated rounds over a table of samples: the methods and their loop.

Every round is a few Spark jobs: clients train side by side, the server's means
are grouped sums, and the new state and the round's metrics are written before the
next round reads them, so no plan grows with the rounds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.tables import Log, drop, settle
from vectorloom.functions.vectors import add, norm, normalise
from vectorloom.operators import bases, encoders, streams
from vectorloom.operators import prototypes as pr
from vectorloom.operators import training as tr
from vectorloom.operators.checks import due
from vectorloom.operators.prep import participants
from vectorloom.plans import reports
from vectorloom.plans.storage import Journal, signature

@dataclass
class Settings:
    """What a run may vary.  Sizes of batches, ranks and schedules follow the method's paper."""

    rounds: int = 3
    epochs: int = 1
    batch: int = 32
    rate: float = 0.035
    personal_rate: float | None = None  # of a client's own coefficients; the shared rate if none is given
    participation: float = 1.0
    seed: int = 42
    common_rank: int = 24
    global_rank: int = 8
    personal_rank: int = 64
    alpha: float = 1.0
    gate: tuple[float, float] = (0.1, 0.9)
    metric: str = "cos"
    coefficient_metric: str = "dot"  # of coefficients in orthonormal bases, where it equals that of whole memories
    change_start: str = "zero"  # or "difference": a client's own common coefficients less the consensus
    server: str = "gated"  # how a client takes the server's means: gated, gated_unit (rows renormalised) or replace
    alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)
    refresh_every: int = 0
    centre_every: int = 0
    centres: int = 2
    beta: float = 0.0
    snapshot_rounds: tuple[int, ...] = ()
    journal: str | None = None  # folder in which whole rounds are published; a run begins after the last one there


@dataclass
class Run:
    """History (round, metric, value), final state, states of asked rounds, and seconds of each stage."""

    history: DataFrame
    state: DataFrame
    snapshots: dict[int, DataFrame] = field(default_factory=dict)
    timings: list[tuple[int, str, float]] = field(default_factory=list)


class _Book:
    """What a run writes down: metrics of a round as soon as they are known, and stage times."""

    def __init__(self, samples: DataFrame, what: str, s: Settings | None = None):
        self.log = Log(samples.sparkSession, f"{what}-history", "round int, metric string, value double")
        self.timings: list[tuple[int, str, float]] = []
        self.done, self.journal = 0, None
        if s is not None and s.journal:
            same = {k: v for k, v in asdict(s).items() if k not in ("journal", "rounds")}
            self.journal = Journal(samples.sparkSession, f"{s.journal}/{what}-{signature(same)}")
            self.done = min(self.journal.last(), s.rounds)
            if self.done:
                self.log.add(self.journal.read(self.done, "history"))

    def restored(self, name: str, fresh: Callable[[], DataFrame]) -> DataFrame:
        """A table of the last published round, or a new one where none was published."""
        return self.journal.read(self.done, name) if self.done else fresh()

    def publish(self, round_: int, **tables: DataFrame | None) -> None:
        """Makes a round whole: all its tables and the history so far appear at once, or not at all."""
        if self.journal is not None:
            self.journal.publish(round_, {**{k: v for k, v in tables.items() if v is not None}, "history": self.log.table()})

    def add(self, df: DataFrame, round_: int, **values: str | Column) -> None:
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value")) for k, v in values.items()]))
        self.log.add(df.select(F.lit(round_).cast("int").alias("round"), cells.alias("m")).select("round", "m.metric", "m.value"))

    @contextmanager
    def timed(self, round_: int, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.timings.append((round_, stage, time.perf_counter() - began))

    def uploads(self, local: DataFrame, round_: int, *parts: str) -> None:
        """What the clients of a round send: bytes per client, and the mean norm of each part's rows."""
        size = sum((F.size(p) for p in parts), F.lit(0)) * 8
        per = local.groupBy("client").agg(F.sum(size).alias("bytes"), *[F.avg(norm(p)).alias(f"_{p}") for p in parts])
        self.add(per.agg(F.avg("bytes").alias("bytes"), *[F.avg(f"_{p}").alias(f"_{p}") for p in parts]), round_, payload_bytes="bytes", **{f"upload_norm_{p}": f"_{p}" for p in parts})

    def run(self, state: DataFrame, snapshots: dict[int, DataFrame]) -> Run:
        return Run(self.log.table(), state, snapshots, self.timings)


def _chosen(samples: DataFrame, s: Settings) -> DataFrame:
    return settle(participants(samples, s.rounds, s.participation, s.seed), "participants")


def stored(samples: DataFrame, what: str) -> streams.Stored:
    """Samples in buckets of their client, so that rounds don't shuffle them: the state goes to them."""
    return streams.store(samples.select("client", "sample", "split", "y", "h"), f"{what}-samples", ["client"])


def averaging(samples: DataFrame, s: Settings) -> Run:
    """Rounds of model averaging.  samples: client, sample, split, y, h."""
    held = stored(samples, "averaging")
    train, test = held.rows.where("split = 'train'"), held.rows.where("split = 'test'")
    chosen, book = _chosen(samples, s), _Book(samples, "averaging", s)

    def first_model() -> DataFrame:
        memories = settle(pr.class_sums(train, ["client", "y"], "h", "plus"), "averaging-init")
        first = memories.agg(F.min("client").alias("client"))
        return settle(memories.join(F.broadcast(first), "client").select("y", "w"), "averaging-model")  # one row

    model, snapshots = book.restored("model", first_model), {}
    for r in range(book.done + 1, s.rounds + 1):
        now = chosen.where(F.col("round") == r).select("client")
        with book.timed(r, "clients"):
            state = now.crossJoin(F.broadcast(model)).withColumn("delta", F.transform("w", lambda v: v * 0.0))  # the model goes to every client that takes part
            local = settle(tr.local(train.join(now, "client", "left_semi"), state, "client", tr.Memory(s.rate, s.metric), s.batch, s.epochs, s.seed, r, held.buckets), "averaging-local")
        with book.timed(r, "server"):
            model = settle(pr.memory_sum(local), "averaging-model", replaces=None if r - 1 in snapshots else model)
        seen = settle(pr.predict(test, model, [], "h", metric=s.metric).select("client", "y", "pred"), "averaging-seen")
        book.add(pr.micro_accuracy(seen), r, micro_accuracy="accuracy")
        book.add(pr.macro_accuracy(seen), r, macro_accuracy="accuracy")
        book.uploads(local, r, "w")
        drop(seen)
        drop(local)
        book.publish(r, model=model)
        if r in s.snapshot_rounds:
            snapshots[r] = model
    held.drop()
    return book.run(model, snapshots)


def feedback(samples: DataFrame, s: Settings) -> Run:
    """Rounds of shared changes.  samples: client, sample, split, y, h."""
    held = stored(samples, "feedback")
    train, test = held.rows.where("split = 'train'"), held.rows.where("split = 'test'")
    chosen, book = _chosen(samples, s), _Book(samples, "feedback", s)
    counts = train.groupBy("client", "y").agg(F.count("*").alias("n"))
    start = pr.memory_sum(pr.class_sums(train, ["client", "y"], "h", "plus"))
    clients = samples.select("client").distinct()
    zero = F.transform("w", lambda v: v * 0.0)
    state = clients.crossJoin(F.broadcast(start)).join(counts, ["client", "y"], "left")  # the bootstrap gives all clients one memory
    begin = state.select("client", "y", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "w", F.lit(0).cast("bigint").alias("errors"))
    state = book.restored("state", lambda: settle(begin, "feedback-state"))
    change = book.restored("change", lambda: settle(start.select("y", zero.alias("delta")), "feedback-change"))
    snapshots = {}
    for r in range(book.done + 1, s.rounds + 1):
        now = chosen.where(F.col("round") == r).select("client")
        with book.timed(r, "clients"):
            weight = F.col("errors") / F.greatest("n", F.lit(1)) * s.rate
            absorbed = state.join(now, "client", "left_semi").join(F.broadcast(change), "y")  # one row per class
            moved = F.zip_with("w", "delta", lambda a, b: a + weight * b)
            zeroed = F.aggregate("delta", F.lit(0.0), lambda a, v: a + F.abs(v)) == 0
            ready = absorbed.withColumn("w", F.when(zeroed, F.col("w")).otherwise(normalise(moved, "plus"))).withColumn("delta", F.transform("delta", lambda v: v * 0.0))
            trained = tr.local(train.join(now, "client", "left_semi"), ready, "client", tr.Memory(s.rate, "cos", renormalise="batch"), s.batch, s.epochs, s.seed, r, held.buckets)
            local = settle(trained.join(state.select("client", "y", "n"), ["client", "y"]).select("client", "y", "n", "w", "errors", "delta"), "feedback-local")
        with book.timed(r, "server"):
            change = settle(pr.memory_sum(local, value="delta", mode=None), "feedback-change", replaces=change)
            state = settle(state.join(now, "client", "left_anti").unionByName(local.drop("delta")), "feedback-state", replaces=None if r - 1 in snapshots else state)
        book.add(pr.macro_accuracy(pr.predict(test, state.select("client", "y", "w"), ["client"], "h", buckets=held.buckets)), r, macro_accuracy="accuracy")
        book.uploads(local, r, "delta")
        drop(local)
        book.publish(r, state=state, change=change)
        if r in s.snapshot_rounds:
            snapshots[r] = state
    held.drop()
    return book.run(state, snapshots)


@dataclass
class Bootstrap:
    """Bases, coefficient state (client, y, n, c, g, d, p) and projected samples."""

    common: np.ndarray
    extra: np.ndarray
    personal: DataFrame
    state: DataFrame
    cache: DataFrame
    energy: float


def _packed(personal: DataFrame) -> DataFrame:
    """Personal bases, one array of rows per client: client, basis."""
    return personal.groupBy("client").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda x: x["b"]).alias("basis"))


def _along(x: str, basis: str = "basis") -> Column:
    """Coordinates of x along the rows of a basis."""
    return F.transform(basis, lambda b: F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v))


def bootstrap(samples: DataFrame, s: Settings, memory: DataFrame | None = None, given: tuple[np.ndarray, np.ndarray, DataFrame] | None = None) -> Bootstrap:
    """Bases from all clients' class means, and every client's coefficients in them.

    ``given`` are a common, a global and personal bases to be used instead of fitted
    ones.  The change d starts at zero, or with ``change_start="difference"`` at what
    a client's own common coefficients differ from the consensus; the residual for
    the personal basis is then what neither explains.
    """
    if s.change_start not in ("zero", "difference"):
        raise ValueError(f"unknown start of the change {s.change_start!r}")
    train = samples.where("split = 'train'")
    memory = settle(pr.class_means(train, ["client", "y"], "h", "clamp") if memory is None else memory, "subspace-memory")
    counts = train.groupBy("client", "y").agg(F.count("*").alias("n"))
    common, extra, energy = bases.shared_basis(memory, s.common_rank, s.global_rank) if given is None else (given[0], given[1], bases.explained(memory, np.hstack(given[:2])))
    both = np.hstack([common, extra])
    m = bases.project(bases.project(memory, common, "w", "mc"), extra, "w", "mg").join(counts, ["client", "y"])
    c = pr.consensus(m, "y", "mc").withColumnRenamed("mc", "c")
    g = pr.consensus(m, "y", "mg").withColumnRenamed("mg", "g")
    held = m.join(F.broadcast(c), "y").join(F.broadcast(g), "y")  # one row per class
    start = F.transform("c", lambda v: v * 0.0) if s.change_start == "zero" else F.zip_with("mc", "c", lambda a, b: a - b)
    lifted = encoders.multiply(encoders.multiply(held, common.T, "mc", "_a"), extra.T, "g", "_b")
    residual = settle(lifted.withColumn("res", F.zip_with("w", add("_a", "_b"), lambda x, y: x - y)).select("client", "y", "n", "c", "g", start.alias("d"), "res"), "subspace-residual")
    personal = settle(bases.per_client(residual, "client", "res", s.personal_rank, both), "subspace-personal") if given is None else given[2]
    packed = _packed(personal)
    state = residual.join(packed, "client").select("client", "y", "n", "c", "g", "d", _along("res").alias("p"), F.lit(0).cast("bigint").alias("wrong"))
    return Bootstrap(common, extra, personal, settle(state, "subspace-state"), settle(query_cache(samples, common, extra, personal), "subspace-cache"), energy)


def query_cache(samples: DataFrame, common: np.ndarray, extra: np.ndarray, personal: DataFrame) -> DataFrame:
    """Samples projected once for all rounds: client, sample, split, y, zc, zg, zp.

    The shared bases are model-sized and travel with the job; a client's own basis
    comes first in its group, and its samples stream past it.
    """
    kept = ["client", "sample", "split", "y"]
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(samples.schema[c] for c in kept), *(T.StructField(z, array) for z in ("zc", "zg", "zp"))])

    def work(key: tuple, held: pa.RecordBatch | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        own = streams.wide(held.column("b"))[np.argsort(held.column("r").to_numpy(), kind="stable")]
        for part in batches:
            h = streams.wide(part.column("h"))
            yield pa.RecordBatch.from_arrays([*streams.repeated(key, len(h)), *(part.column(c) for c in kept[1:]), *(streams.lists(h @ m) for m in (common, extra, own.T))], schema.names)

    return streams.beside(samples.select(*kept, F.col("h").cast(array).alias("h")), personal.select("client", "r", "b"), ["client"], work, schema)


def late_join(boot: Bootstrap, state: DataFrame, samples: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """State and projected samples of clients that come later, in the bases that there are.

    They take the classes' current consensus of c and g, weighted by counts; only
    their personal bases are fitted, to their own residuals.
    """
    train = samples.where("split = 'train'")
    memory = pr.class_means(train, ["client", "y"], "h", "clamp").join(train.groupBy("client", "y").agg(F.count("*").alias("n")), ["client", "y"])
    m = bases.project(memory, boot.common, "w", "mc")
    c, g = (pr.consensus(state, "y", k) for k in "cg")
    held = m.join(F.broadcast(c), "y").join(F.broadcast(g), "y")  # one row per class
    lifted = encoders.multiply(encoders.multiply(held, boot.common.T, "mc", "_a"), boot.extra.T, "g", "_b")
    residual = settle(lifted.withColumn("res", F.zip_with("w", add("_a", "_b"), lambda x, y: x - y)).select("client", "y", "n", "c", "g", "res"), "late-residual")
    personal = settle(bases.per_client(residual, "client", "res", s.personal_rank, np.hstack([boot.common, boot.extra])), "late-personal")
    new = residual.join(_packed(personal), "client").select("client", "y", "n", "c", "g", F.transform("c", lambda v: v * 0.0).alias("d"), _along("res").alias("p"), F.lit(0).cast("bigint").alias("wrong"))
    return settle(new, "late-state"), settle(query_cache(samples, boot.common, boot.extra, personal), "late-cache")


BRANCHES = ("fused", "shared", "personal")


def branches(cache: DataFrame, state: DataFrame, metric: str = "dot", buckets: int | None = None) -> DataFrame:
    """Projected samples with the classes that the branches predict: client, sample, y, fused, shared, personal.

    One pass gives all three.  The smallest class wins a tie.
    """
    kind = state.schema["y"].dataType
    schema = T.StructType([*(cache.schema[c] for c in ("client", "sample", "y")), *(T.StructField(b, kind) for b in BRANCHES)])

    def work(key: tuple, held: pa.RecordBatch | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        order = np.argsort(held.column("y").to_numpy(), kind="stable")
        labels = held.column("y").to_numpy()[order]
        c, g, d, p = (streams.wide(held.column(k))[order] for k in "cgdp")
        for part in batches:
            zc, zg, zp = (streams.wide(part.column(z)) for z in ("zc", "zg", "zp"))
            pairs = ((np.hstack([zc, zg, zp]), np.hstack([c + d, g, p])), (np.hstack([zc, zg]), np.hstack([c, g])), (np.hstack([zc, zp]), np.hstack([d, p])))
            pred = [pa.array(labels[tr.scores(z, w, metric).argmax(axis=1)]) for z, w in pairs]
            yield pa.RecordBatch.from_arrays([*streams.repeated(key, part.num_rows), part.column("sample"), part.column("y"), *pred], schema.names)

    return streams.beside(cache.select("client", "sample", "y", "zc", "zg", "zp"), state.select("client", "y", "c", "g", "d", "p"), ["client"], work, schema, buckets=buckets)


def branch_predictions(cache: DataFrame, state: DataFrame, metric: str = "dot", buckets: int | None = None) -> dict[str, DataFrame]:
    """Predictions of the fused, shared and personal branches on projected samples."""
    seen = branches(cache, state, metric, buckets)
    return {b: seen.select("client", "sample", "y", F.col(b).alias("pred")) for b in BRANCHES}


def branch_accuracies(seen: DataFrame) -> DataFrame:
    """Macro accuracy of every branch, in one row."""
    hit = lambda b: F.avg((F.col(b) == F.col("y")).cast("double")).alias(b)
    return seen.groupBy("client").agg(*map(hit, BRANCHES)).agg(*[F.avg(b).alias(b) for b in BRANCHES])


def merge(state: DataFrame, common: DataFrame, s: Settings) -> DataFrame:
    """Every client's c and g after the broadcast ones (columns y, cc, gg): moved by the gate, or replaced."""
    if s.server not in ("gated", "gated_unit", "replace"):
        raise ValueError(f"unknown server step {s.server!r}")
    gate = pr.follow_ratio(F.col("n"), F.col("wrong"), s.alpha, *s.gate)
    joined = state.join(F.broadcast(common), "y", "left")  # one row per class
    taken = lambda a, b: F.col(b) if s.server == "replace" else pr.gated_merge(a, b, s.rate, gate)
    moved = lambda a, b: normalise(taken(a, b), "plus") if s.server == "gated_unit" else taken(a, b)
    move = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(moved(a, b))
    return joined.select("client", "y", "n", move("c", "cc").alias("c"), move("g", "gg").alias("g"), "d", "p", "wrong")


def rebuild(boot: Bootstrap, state: DataFrame, unit: bool = True) -> DataFrame:
    """Full memories (client, y, w) of a coefficient state, rows of unit norm unless not wanted."""
    shared = encoders.multiply(encoders.multiply(state.withColumn("cd", add("c", "d")), boot.common.T, "cd", "_a"), boot.extra.T, "g", "_b").join(_packed(boot.personal), "client")
    parts = F.zip_with("p", "basis", lambda a, b: F.transform(b, lambda x: a * x))
    own = F.aggregate(parts, F.transform("_a", lambda x: x * 0.0), lambda total, part: F.zip_with(total, part, lambda x, y: x + y))
    whole = add(add("_a", "_b"), own)
    return shared.select("client", "y", (normalise(whole, "clamp") if unit else whole).alias("w"))


@dataclass
class Clients:
    """State of clients (client, y, n, c, g, d, p) and what waits to be written over it (client, y, c, g), if anything."""

    current: DataFrame
    pending: DataFrame | None = None


def materialise(clients: Clients, boot: Bootstrap, consume: bool, who: DataFrame | None = None) -> tuple[DataFrame, Clients]:
    """State of the clients in ``who`` (all without it) as a reader sees it, with memories w, and what is left for later readers.

    Pending c and g stand over the current ones; memories are built anew from them.
    A reader that consumes takes its clients' pending rows away, so that the next
    read has the current state again; a reader that doesn't leaves all as it was.
    """
    state = clients.current if who is None else clients.current.join(who, "client", "left_semi")
    if clients.pending is not None:
        late = clients.pending.select("client", "y", F.col("c").alias("_c"), F.col("g").alias("_g"))
        state = state.join(late, ["client", "y"], "left").withColumns({"c": F.coalesce("_c", "c"), "g": F.coalesce("_g", "g")}).drop("_c", "_g")
    seen = settle(state, "materialised")
    memories = rebuild(boot, seen)
    left = clients.pending
    if consume and left is not None:
        left = settle(left.join(seen.select("client").distinct(), "client", "left_anti"), "pending")
    return seen.join(memories, ["client", "y"]), Clients(clients.current, left)


def full_space_step(samples: DataFrame, state: DataFrame, boot: Bootstrap, s: Settings, round_: int = 1, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clients train on whole vectors: what they upload, and their new state.

    samples: client, sample, y, h.  The upload is trimmed: coordinates in the shared
    bases and the mistakes that are left per class (client, y, c, g, wrong).  The
    state (client, y, n, c, g, d, p, wrong) keeps the rest, and the mistakes for the
    gate of the next merge.
    """
    learner = tr.FullSpace(s.rate, s.rate if s.personal_rate is None else s.personal_rate, boot.common, boot.extra, s.metric)
    trained = settle(tr.local(samples, state, "client", learner, s.batch, s.epochs, s.seed, round_, buckets, boot.personal).drop("errors"), "full-space")
    seen = pr.predict(samples.select("client", "sample", "y", "h"), rebuild(boot, trained), ["client"], "h", metric=s.metric, skip_zero=False, buckets=buckets)
    wrong = seen.where("pred != y").groupBy("client", "y").agg(F.count("*").alias("wrong"))
    full = trained.join(state.select("client", "y", "n"), ["client", "y"]).join(wrong, ["client", "y"], "left")
    new = settle(full.select("client", "y", "n", "c", "g", "d", "p", F.coalesce("wrong", F.lit(0)).cast("bigint").alias("wrong")), "full-space-state")
    return new.select("client", "y", "c", "g", "wrong"), new


def raw_branches(samples: DataFrame, state: DataFrame, boot: Bootstrap, metric: str = "dot") -> DataFrame:
    """What branches() gives, for vectors that no cache has projected: they are projected first, in the same way."""
    return branches(query_cache(samples, boot.common, boot.extra, boot.personal), state, metric)


def pull_to_centres(state: DataFrame, uploads: DataFrame, s: Settings) -> DataFrame:
    """Moves the clients' shared coefficients towards the nearest of their class's centres.

    Centres are k-means centres of the uploaded rows, taken at unit length.
    """
    x = F.concat("c", "g")
    centres = settle(pr.kmeans(uploads.select("client", "y", normalise(x, "clamp").alias("x")), ["y"], "client", s.centres, 10), "subspace-centres")
    moved = pr.pull(state.withColumn("x", x), centres, ["y"], s.beta)
    nc = F.size("c")
    return moved.drop("centre").withColumns({"c": F.slice("x", F.lit(1), nc), "g": F.slice("x", nc + 1, F.size("g"))}).select(*state.columns)


def subspace(samples: DataFrame, s: Settings, boot: Bootstrap | None = None) -> Run:
    """Rounds of coefficient training in shared and personal bases.

    The server's means are merged by a client when it next takes part, if it took
    part in the round that made them; evaluation sees the merged state.  Every
    ``centre_every`` rounds shared coefficients are pulled to class centres, every
    ``refresh_every`` rounds bases are fitted anew to the clients' memories, and
    the mean angle between old and new shared bases is reported.
    """
    chosen, book = _chosen(samples, s), _Book(samples, "subspace", s)
    if book.done:
        boot = _restored_bases(samples, book)
    boot = bootstrap(samples, s) if boot is None else boot
    state, snapshots = book.restored("state", lambda: boot.state), {}
    held = streams.store(boot.cache, "subspace-projected", ["client"])
    learner = tr.Coefficients(s.rate, s.rate if s.personal_rate is None else s.personal_rate, s.coefficient_metric)
    pending = book.journal.read(book.done, "pending") if book.done and book.journal.has(book.done, "pending") else None
    for r in range(book.done + 1, s.rounds + 1):
        train, test = held.rows.where("split = 'train'"), held.rows.where("split = 'test'")
        now = chosen.where(F.col("round") == r).select("client")
        last = chosen.where(F.col("round") == r - 1).select("client")
        with book.timed(r, "clients"):
            ready = state.join(now, "client", "left_semi")
            if pending is not None:
                ready = merge(ready.join(last, "client", "left_semi"), pending, s).unionByName(ready.join(last, "client", "left_anti"))
            own = train.join(now, "client", "left_semi")
            trained = settle(tr.local(own, ready, "client", learner, s.batch, s.epochs, s.seed, r, held.buckets).drop("errors"), "subspace-trained")
            local = settle(_counted(trained, own, state, s, held.buckets), "subspace-local")
        with book.timed(r, "server"):
            means = pr.consensus(local, "y", "c").withColumnRenamed("c", "cc").join(pr.consensus(local, "y", "g").withColumnRenamed("g", "gg"), "y")
            pending = settle(means, "subspace-pending", replaces=pending)
        state = settle(state.join(now, "client", "left_anti").unionByName(local), "subspace-state", replaces=None if state is boot.state else state)
        if due(r, s.centre_every, s.beta):
            state = settle(pull_to_centres(state, local, s), "subspace-state", replaces=state)
        if due(r, s.refresh_every):
            old, boot = np.hstack([boot.common, boot.extra]), bootstrap(samples, s, settle(rebuild(boot, state), "subspace-memory"))
            state, pending = boot.state, None
            held.drop()
            held = streams.store(boot.cache, "subspace-projected", ["client"])
            test = held.rows.where("split = 'test'")
            drift = bases.principal_angle(old, np.hstack([boot.common, boot.extra]))
            book.add(samples.sparkSession.range(1), r, basis_drift_degrees=F.lit(drift))
        current = state if pending is None else merge(state.join(now, "client", "left_semi"), pending, s).unionByName(state.join(now, "client", "left_anti"))
        current = settle(current, "subspace-current")
        book.add(branch_accuracies(branches(test, current, s.coefficient_metric, held.buckets)), r, **{f"{b}_accuracy": b for b in BRANCHES})
        book.uploads(local, r, "c", "g")
        sync = local.select("client", "y", "c", "n", "wrong").join(current.select("client", "y", F.col("c").alias("after")), ["client", "y"])
        moved = norm(F.zip_with("c", "after", lambda a, b: a - b))
        book.add(sync.agg(F.avg(pr.follow_ratio(F.col("n"), F.col("wrong"), s.alpha, *s.gate)).alias("gate"), F.avg(moved).alias("moved")), r, mean_gate="gate", mean_sync_move="moved")
        for past in (trained, local, None if r in s.snapshot_rounds else current):
            if past is not None:
                drop(past)
        book.publish(r, state=state, pending=pending, bases=_bases_table(samples.sparkSession, boot) if book.journal else None, personal=boot.personal if book.journal else None)
        if r in s.snapshot_rounds:
            snapshots[r] = current
    held.drop()
    return book.run(state, snapshots)


def _bases_table(spark: SparkSession, boot: Bootstrap) -> DataFrame:
    """The shared bases as rows of vectors; model-sized."""
    rows = [(part, i, v.tolist()) for part, basis in (("common", boot.common), ("extra", boot.extra)) for i, v in enumerate(basis.T)]
    return spark.createDataFrame(rows, "part string, r int, b array<double>")


def _restored_bases(samples: DataFrame, book: _Book) -> Bootstrap:
    """Bases of the last published round, and the samples projected on them again."""
    rows = book.journal.read(book.done, "bases").orderBy("r").collect()
    dims = samples.select(F.size("h")).first()[0]
    common, extra = (np.array([r.b for r in rows if r.part == part]).reshape(-1, dims).T for part in ("common", "extra"))
    personal = book.journal.read(book.done, "personal")
    return Bootstrap(common, extra, personal, book.journal.read(book.done, "state"), settle(query_cache(samples, common, extra, personal), "subspace-cache"), float("nan"))


def _counted(trained: DataFrame, train: DataFrame, state: DataFrame, s: Settings, buckets: int | None = None) -> DataFrame:
    """Trained coefficients with the counts of their classes and the mistakes that are left."""
    seen = branch_predictions(train, trained, s.coefficient_metric, buckets)["fused"]
    wrong = seen.where("pred != y").groupBy("client", "y").agg(F.count("*").alias("wrong"))
    full = trained.join(state.select("client", "y", "n"), ["client", "y"]).join(wrong, ["client", "y"], "left")
    return full.select("client", "y", "n", "c", "g", "d", "p", F.coalesce("wrong", F.lit(0)).cast("bigint").alias("wrong"))


def mixed(samples: DataFrame, s: Settings, given: tuple[np.ndarray, DataFrame] | None = None) -> Run:
    """Rounds with unit coordinates of one shared basis and a personal one, mixed by a learned alpha.

    samples: client, sample, split (train, test, and val, or val is train), y, h.
    A client learns its shared and personal rows, then the alpha of the grid that
    predicts its validation rows best; the server's weighted mean of the shared
    rows, renormalised, replaces every participant's (``server="replace"``) or moves it.
    ``given`` are a shared basis and personal ones to be used instead of fitted ones.
    """
    train, test = samples.where("split = 'train'"), samples.where("split = 'test'")
    val = samples.where("split = 'val'")
    chosen, book = _chosen(samples, s), _Book(samples, "mixed", s)
    rank = s.common_rank + s.global_rank
    memory = settle(pr.class_means(train, ["client", "y"], "h", "clamp"), "mixed-memory")
    basis = bases.shared_basis(memory, rank, 0)[0] if given is None else given[0]
    counts = train.groupBy("client", "y").agg(F.count("*").alias("n"))
    shared = bases.project(memory, basis, "w", "s")
    residual = settle(encoders.multiply(shared, basis.T, "s", "_a").withColumn("res", F.zip_with("w", "_a", lambda a, b: a - b)).drop("_a"), "mixed-residual")
    personal = settle(bases.per_client(residual, "client", "res", s.personal_rank, basis), "mixed-personal") if given is None else given[1]
    state = residual.join(_packed(personal), "client").join(counts, ["client", "y"])
    state = settle(state.select("client", "y", "n", normalise("s", "plus").alias("s"), normalise(_along("res"), "plus").alias("p"), F.array(F.lit(0.5)).alias("alpha"), F.lit(0).cast("bigint").alias("wrong")), "mixed-state")
    zero = np.zeros((len(basis), 0))
    held = streams.store(query_cache(samples, basis, zero, personal).select("client", "sample", "split", "y", F.col("zc").alias("zs"), "zp"), "mixed-projected", ["client"])
    cache, n = held.rows, held.buckets
    own_rate = s.rate if s.personal_rate is None else s.personal_rate
    held_out = "val" if not val.isEmpty() else "train"
    begin, snapshots = state, {}
    state = book.restored("state", lambda: begin)
    for r in range(book.done + 1, s.rounds + 1):
        now = chosen.where(F.col("round") == r).select("client")
        with book.timed(r, "clients"):
            rows = cache.where("split = 'train'").join(now, "client", "left_semi")
            trained = settle(tr.local(rows, state.join(now, "client", "left_semi"), "client", tr.Mixed(s.rate, own_rate), s.batch, s.epochs, s.seed, r, n).drop("errors"), "mixed-trained")
            checked = cache.where(F.col("split") == held_out).join(now, "client", "left_semi")
            best = mixing_weights(checked, trained, list(s.alphas), n)
            mixed_ = trained.drop("alpha").join(best.select("client", F.array("alpha").alias("alpha")), "client")
            wrong = mixed_predictions(rows, mixed_, n)["fused"].where("pred != y").groupBy("client", "y").agg(F.count("*").alias("wrong"))
            local = settle(mixed_.join(state.select("client", "y", "n"), ["client", "y"]).join(wrong, ["client", "y"], "left").select("client", "y", "n", "s", "p", "alpha", F.coalesce("wrong", F.lit(0)).cast("bigint").alias("wrong")), "mixed-local")
        with book.timed(r, "server"):
            mean = F.broadcast(pr.consensus(local, "y", "s", mode="plus").withColumnRenamed("s", "ss"))  # one row per class
            gate = pr.follow_ratio(F.col("n"), F.col("wrong"), s.alpha, *s.gate)
            taken = F.col("ss") if s.server == "replace" else normalise(pr.gated_merge("s", "ss", s.rate, gate), "plus")
            synced = local.join(mean, "y").select("client", "y", "n", taken.alias("s"), "p", "alpha", "wrong")
            state = settle(state.join(now, "client", "left_anti").unionByName(synced), "mixed-state", replaces=None if r - 1 in snapshots else state)
        for name, seen in mixed_predictions(cache.where("split = 'test'"), state, n).items():
            book.add(pr.macro_accuracy(seen), r, **{f"{name}_accuracy": "accuracy"})
        book.add(local.groupBy("client").agg(F.first(F.get("alpha", F.lit(0))).alias("a")).agg(F.avg("a").alias("a")), r, mean_alpha="a")
        book.uploads(local, r, "s")
        drop(trained)
        drop(local)
        book.publish(r, state=state)
        if r in s.snapshot_rounds:
            snapshots[r] = state
    held.drop()
    return book.run(state, snapshots)


def mixing_weights(cache: DataFrame, state: DataFrame, alphas: list[float], buckets: int | None = None) -> DataFrame:
    """The alpha of each client that predicts these rows best, the first of the grid on a tie: client, alpha, accuracy."""
    rows = mixed_scores(cache, state, buckets).withColumn("_a", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(alphas)])))
    fused = F.transform("_s", lambda s: F.struct(F.round(F.col("_a.alpha") * s["s"] + (1 - F.col("_a.alpha")) * s["p"], 9).alias("s"), (-s["k"]).alias("k")))
    hit = (-F.array_max(fused)["k"] == F.col("y")).cast("double")
    acc = rows.groupBy("client", F.col("_a.i").alias("i"), F.col("_a.alpha").alias("alpha")).agg(F.avg(hit).alias("accuracy"))
    return acc.groupBy("client").agg(F.max_by("alpha", F.struct(F.round("accuracy", 9), -F.col("i"))).alias("alpha"), F.max("accuracy").alias("accuracy"))


def mixed_scores(cache: DataFrame, state: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (client, sample, y) with _s, the cosines of every class in both bases, and their client's _alpha."""
    kind = state.schema["y"].dataType
    cells = T.ArrayType(T.StructType([T.StructField("k", kind), T.StructField("s", T.DoubleType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*(cache.schema[c] for c in ("client", "sample", "y")), T.StructField("_s", cells), T.StructField("_alpha", T.DoubleType())])

    def work(key: tuple, held: pa.RecordBatch | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        order = np.argsort(held.column("y").to_numpy(), kind="stable")
        labels = held.column("y").to_numpy()[order]
        s, p = (streams.wide(held.column(c))[order] for c in "sp")
        alpha = float(streams.wide(held.column("alpha"))[0, 0])
        for part in batches:
            n = part.num_rows
            each = [tr.scores(streams.wide(part.column(z)), w, "cos").ravel() for z, w in (("zs", s), ("zp", p))]
            struct = pa.StructArray.from_arrays([pa.array(np.tile(labels, n)), *map(pa.array, each)], ["k", "s", "p"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(labels)), struct)
            yield pa.RecordBatch.from_arrays([*streams.repeated(key, n), part.column("sample"), part.column("y"), lists, pa.array(np.full(n, alpha))], schema.names)

    return streams.beside(cache.select("client", "sample", "y", "zs", "zp"), state.select("client", "y", "s", "p", "alpha"), ["client"], work, schema, buckets=buckets)


def mixed_predictions(cache: DataFrame, state: DataFrame, buckets: int | None = None) -> dict[str, DataFrame]:
    """Predictions of the fused, shared and personal branches."""
    rows = mixed_scores(cache, state, buckets)
    best = lambda f: -F.array_max(F.transform("_s", lambda s: F.struct(F.round(f(s), 9).alias("s"), (-s["k"]).alias("k"))))["k"]
    forms = {"fused": lambda s: F.col("_alpha") * s["s"] + (1 - F.col("_alpha")) * s["p"], "shared": lambda s: s["s"], "personal": lambda s: s["p"]}
    return {name: rows.select("client", "sample", "y", best(f).alias("pred")) for name, f in forms.items()}


def whole_predictions(samples: DataFrame, boot: Bootstrap, state: DataFrame, metric: str = "dot") -> DataFrame:
    """Predictions on whole memories rebuilt from coefficients; with orthonormal bases they agree with the fused branch."""
    return pr.predict(samples, rebuild(boot, state, unit=False), ["client"], "h", metric=metric, skip_zero=False)


def replay(snapshots: dict[int, DataFrame], cache: DataFrame, metric: str = "dot") -> DataFrame:
    """Macro accuracy of every branch on stored states, without training: round, metric, value."""
    test, book = cache.where("split = 'test'"), _Book(cache, "replay")
    for r, state in snapshots.items():
        book.add(branch_accuracies(branches(test, state, metric)), r, **{f"{b}_accuracy": b for b in BRANCHES})
    return book.log.table()


def timing_report(spark: SparkSession, run: Run, clients: int) -> DataFrame:
    """Seconds of a run's stages over its rounds: stage, rounds, q1, median, q3, iqr, ms_per_client (of the median, shared by the clients)."""
    rows = spark.createDataFrame([(r, stage, t) for r, stage, t in run.timings], "round int, stage string, seconds double")
    counts = rows.groupBy("stage").agg(F.count("*").alias("rounds"))
    table = counts.join(reports.quartiles(rows, ["stage"], "seconds"), "stage")
    return table.withColumn("ms_per_client", F.col("median") * 1000 / max(clients, 1))


#: Every method takes (samples, settings) and returns a Run.
METHODS = {"averaging": averaging, "feedback": feedback, "subspace": subspace, "mixed": mixed}


def compare(samples: DataFrame, s: Settings, methods: list[str], folder: str, save: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Runs methods one after the other and gives their history: method, round, metric, value.

    A method's rows are published in ``folder`` when it is done; one that was
    published under the same settings isn't run again, and one that was stopped goes
    on after its last whole round.  ``save`` gets the rows so far after each method.
    """
    spark = samples.sparkSession
    same = {k: v for k, v in asdict(s).items() if k != "journal"}
    journal = Journal(spark, f"{folder}/report-{signature(same)}")
    rows: DataFrame | None = None
    for name in methods:
        at = sorted(METHODS).index(name) + 1
        if not journal.has(at, "rows"):
            run = METHODS[name](samples, replace(s, journal=folder))
            journal.publish(at, {"rows": run.history.withColumn("method", F.lit(name))})
        part = journal.read(at, "rows").select("method", "round", "metric", "value")
        rows = part if rows is None else rows.unionByName(part)
        if save is not None:
            save(rows)
    return rows
