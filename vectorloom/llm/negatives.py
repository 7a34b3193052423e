"""Hard negatives by a multiway hyperplane tree with distance ranges.

A node of the tree has several split points; a vector goes to the nearest.  Each
split point stores the range of its distances to every sibling's subtree.  A window
of scores around an anchor is an annulus of distances; by the triangle inequality it
bounds the distances to a split point, and a sibling whose range lies outside holds
nothing of the window.  Leaves that are left are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.common import materialise

#: Split points of a node, and vectors that a leaf should hold.
WAYS, LEAF = 16, 256
#: Levels at most, so leaves are WAYS ** LEVELS at most, and vectors of the sample that split points come from.
LEVELS, SAMPLE = 3, 32_768
#: Vectors and anchors that meet in one task at a time.
ROWS, ANCHORS = 4096, 1024
#: Scores are exact below this; larger components are an error.
EXACT = 1 << 53


def levels(vector: Column | str) -> Column:
    """floor(256 x) of every component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


# --- tree ---


class Tree(NamedTuple):
    """Split points of each level: ``points[l]`` is nodes x WAYS x dimensions; a node with fewer repeats its first."""

    points: list[np.ndarray]

    def leaves(self) -> int:
        return self.points[0].shape[1] ** len(self.points)


def spread_points(x: np.ndarray, ways: int) -> np.ndarray:
    """Points of the sample far from each other: each next one is farthest from those before."""
    if not len(x):
        return np.zeros((ways, x.shape[1]))
    picked = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    away = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < ways and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked + picked[:1] * (ways - len(picked))]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * x @ points.T
    return np.sqrt(np.maximum(square, 0))


def build(sample: np.ndarray, depth: int, ways: int = WAYS) -> Tree:
    """A tree of so many levels over a sample; every node's points are spread over the sample vectors that reach it."""
    points, node = [], np.zeros(len(sample), np.int64)
    for level in range(depth):
        points.append(np.stack([spread_points(sample[node == n], ways) for n in range(ways**level)]))
        node = node * ways + descend(sample, node, points[-1])[0]
    return Tree(points)


def descend(x: np.ndarray, node: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest split point of each vector's node, the first on a tie, and the distances to all of them."""
    child, away = np.zeros(len(x), np.int64), np.zeros((len(x), points.shape[1]))
    for n in np.unique(node):
        own = node == n
        away[own] = distances(x[own], points[n])
        child[own] = away[own].argmin(axis=1)
    return child, away


def place(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each vector, and its distances to the split points on the way, levels x WAYS."""
    node, seen = np.zeros(len(x), np.int64), []
    for points in tree.points:
        child, away = descend(x, node, points)
        node = node * points.shape[1] + child
        seen.append(away)
    return node, np.concatenate(seen, axis=1)


class Ranges(NamedTuple):
    """Per level, nodes x split point x sibling: least and largest distance of the split point to the sibling's vectors."""

    least: list[np.ndarray]
    most: list[np.ndarray]
    norms: np.ndarray  # leaves x 2: range of the norms


def ranges(tree: Tree, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> Ranges:
    """Ranges of all levels from those of the leaves; row i of low and high belongs to leaf[i].

    Columns are the distances to the split points on the way, then the norm.  A
    subtree without vectors has an empty range.
    """
    ways, depth = tree.points[0].shape[1], len(tree.points)
    least, most = [], []
    for level in range(depth):
        lo, hi = np.full((ways**level, ways, ways), np.inf), np.full((ways**level, ways, ways), -np.inf)
        child = leaf // ways ** (depth - 1 - level)
        columns = slice(level * ways, (level + 1) * ways)
        np.minimum.at(lo, (child // ways, slice(None), child % ways), low[:, columns])
        np.maximum.at(hi, (child // ways, slice(None), child % ways), high[:, columns])
        least.append(lo)
        most.append(hi)
    norms = np.tile([np.inf, -np.inf], (tree.leaves(), 1))
    norms[leaf, 0], norms[leaf, 1] = low[:, -1], high[:, -1]
    return Ranges(least, most, norms)


def survivors(tree: Tree, held: Ranges, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves that may hold a vector whose score with x[i] is from low[i] to high[i], as (i, leaf).

    Infinite bounds are open.  A little slack keeps what rounding would lose.
    """
    ways, depth = tree.points[0].shape[1], len(tree.points)
    norm, slack = (x**2).sum(axis=1), 1e-7
    least, most = held.norms[:, 0], held.norms[:, 1]
    filled = least <= most
    if not filled.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tight = (least[filled].min() ** 2, most[filled].max() ** 2)
    with np.errstate(invalid="ignore"):
        near = np.sqrt(np.maximum(norm + tight[0] - 2 * high, 0))
        far = np.sqrt(np.maximum(norm + tight[1] - 2 * low, 0))  # no vector with less than low is nearer than this
    out = norm + tight[1] - 2 * low < 0  # no vector is that long
    near, far = near * (1 - slack) - slack, far * (1 + slack) + slack
    query, node = np.flatnonzero(~out), np.zeros(int((~out).sum()), np.int64)
    for level in range(depth):
        away = np.zeros((len(query), ways))
        for n in np.unique(node):
            own = node == n
            away[own] = distances(x[query[own]], tree.points[level][n])
        inner = np.maximum(away - far[query, None], near[query, None] - away)  # a vector of the annulus is as far from the point, at least and at most
        outer = away + far[query, None]
        lo, hi = held.least[level][node], held.most[level][node]
        alive = ((inner[:, :, None] <= hi * (1 + slack) + slack) & (outer[:, :, None] >= lo * (1 - slack) - slack)).all(axis=1)
        at, child = np.nonzero(alive)
        query, node = query[at], node[at] * ways + child
    leaf_far, leaf_near = norm[query] + most[node] ** 2 - 2 * low[query], norm[query] + least[node] ** 2 - 2 * high[query]
    ok = (leaf_far >= -slack * (1 + norm[query])) & (leaf_near <= (np.sqrt(norm[query]) + most[node] + slack) ** 2)
    return query[ok], node[ok]


# --- search ---


class Packed(NamedTuple):
    """How vectors are packed into a binary column: dimensions, and the kind of a whole number."""

    dims: int
    kind: str

    def column(self, rows: np.ndarray) -> pa.Array:
        raw = np.ascontiguousarray(rows.astype(self.kind))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * (raw.itemsize * self.dims)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

    def matrix(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """The vectors as rows of doubles."""
        if len(column) == 0:
            return np.zeros((0, self.dims))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
        return np.frombuffer(bytes(data[at[0] : at[-1]]), self.kind).reshape(len(column), self.dims).astype(np.float64)


def best_in_windows(scores: np.ndarray, fits: np.ndarray, tie: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window (a row of scores) the columns of its k best scores, ties in the order of ``tie``: (window, column)."""
    rows, cols = np.nonzero(fits & (scores >= low[:, None]) & (scores <= high[:, None]))
    order = np.lexsort((tie[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


_WINDOWS = "array<struct<slot: int, low: double, high: double>>"
_ASKED = f"query bigint, label bigint, v binary, windows {_WINDOWS}"
_FOUND = "query bigint, slot int, score bigint, vec_id bigint, key bigint"


def probe(asks: DataFrame, cells: DataFrame, packed: Packed, k: int, same: bool) -> DataFrame:
    """The k best rows of every window in the leaves that its query visits: query, slot, score, vec_id, key, rank.

    asks: query, label, v, windows, leaf; cells: leaf, label, v, members.  A leaf's
    vectors and the queries that visit it are dealt to blocks that meet once.  Every
    block gives its own k best; the best of all blocks are picked by rank.
    """
    sizes = cells.groupBy("leaf").agg(F.count("*").alias("_n"))
    asked = asks.groupBy("leaf").agg(F.count("*").alias("_q"))
    cut = sizes.join(asked, "leaf").select("leaf", F.ceil(F.col("_n") / ROWS).cast("int").alias("_nb"), F.ceil(F.col("_q") / ANCHORS).cast("int").alias("_qb"))
    cut = F.broadcast(materialise(cut, "negatives-cut"))  # WAYS ** LEVELS leaves at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = cells.join(cut, "leaf").withColumn("_i", F.pmod(F.xxhash64("v", "label"), F.col("_nb")).cast("int")).withColumn("_j", every("_qb"))
    queries = asks.join(cut, "leaf").withColumn("_j", F.pmod(F.xxhash64("query"), F.col("_qb")).cast("int")).withColumn("_i", every("_nb"))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        parts = [pa.table({n: pa.array([], pa.int32() if n == "slot" else pa.int64()) for n in ("query", "slot", "score", "vec_id", "key")})]
        if not q.num_rows or not c.num_rows:
            return parts[0]
        members = c.column("members").combine_chunks()
        owner = np.repeat(np.arange(c.num_rows), np.diff(members.offsets.to_numpy()))
        flat = members.flatten()
        ids, keys = flat.field("vec_id"), flat.field("key").to_numpy()
        tie = np.empty(len(owner), np.int64)
        tie[np.lexsort((keys, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(owner))
        vectors, labels = packed.matrix(c.column("v")), c.column("label").to_numpy()
        for part in q.to_batches(max_chunksize=max(1, (1 << 18) // max(len(owner), 1))):
            windows = part.column("windows")
            mine = np.repeat(np.arange(part.num_rows), np.diff(windows.offsets.to_numpy()))
            bounds = windows.flatten()
            fits = (labels[None, :] == part.column("label").to_numpy()[:, None]) == same
            scores = packed.matrix(part.column("v")) @ vectors.T
            r, col = best_in_windows(scores[mine][:, owner], fits[mine][:, owner], tie, bounds.field("low").to_numpy(), bounds.field("high").to_numpy(), k)
            at = mine[r]
            parts.append(pa.table({"query": part.column("query").take(pa.array(at)), "slot": bounds.field("slot").take(pa.array(r)), "score": pa.array(scores[at, owner[col]].astype(np.int64)), "vec_id": ids.take(pa.array(col)), "key": pa.array(keys[col])}))
        return pa.concat_tables(parts)

    at = ["leaf", "_i", "_j"]
    met = queries.select(*at, "query", "label", "v", "windows").groupBy(*at).cogroup(rows.select(*at, "label", "v", "members").groupBy(*at)).applyInArrow(meet, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, cells: DataFrame, tree: Tree, held: Ranges, packed: Packed, k: int, same: bool) -> DataFrame:
    """The k best rows of every window of every query, of its label or of another: query, slot, score, vec_id, key, rank.

    queries: query, label, v, windows (slot, low, high).  Each query first looks into
    its own leaf; the k-th score there narrows a window from below; then it visits
    all leaves that the distance ranges leave.
    """
    shared = queries.sparkSession.sparkContext.broadcast((tree, held))  # bounded by WAYS and LEVELS

    def visits(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, r = shared.value
            for batch in batches:
                for part in [batch.slice(i, 64) for i in range(0, batch.num_rows, 64)]:
                    x, windows = packed.matrix(part.column("v")), part.column("windows")
                    if home:
                        at, leaf, lists = np.arange(len(x)), place(t, x)[0], windows
                    else:
                        mine, bounds = np.repeat(np.arange(len(x)), np.diff(windows.offsets.to_numpy())), windows.flatten()
                        window, leaf = survivors(t, r, x[mine], bounds.field("low").to_numpy(), bounds.field("high").to_numpy())
                        pair, first = np.unique(np.stack([mine[window], leaf]), axis=1, return_inverse=True)
                        order = np.lexsort((window, first))
                        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first[order], np.arange(pair.shape[1] + 1)).astype(np.int32)), bounds.take(pa.array(window[order])))
                        at, leaf = pair
                    took = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([took.column("query"), took.column("label"), took.column("v"), lists, pa.array(leaf)], ["query", "label", "v", "windows", "leaf"])

        return run

    first = probe(queries.mapInArrow(visits(True), f"{_ASKED}, leaf bigint"), cells, packed, k, same)
    floors = first.where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("score").cast("double")))).alias("_floor"))
    narrowed = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), F.greatest(w["low"], F.coalesce(F.col("_floor")[w["slot"]], w["low"])).alias("low"), w["high"].alias("high")))
    asked = materialise(queries.join(floors, "query", "left").select("query", "label", "v", narrowed.alias("windows")), "negatives-asked")
    return probe(asked.mapInArrow(visits(False), f"{_ASKED}, leaf bigint"), cells, packed, k, same)


# --- operator ---


def index(vectors: DataFrame, packed: Packed, seed: int = 5, ways: int = WAYS, leaf: int = LEAF) -> tuple[DataFrame, Tree, Ranges]:
    """Tree over all vectors (label, v, members): the vectors with their leaf, split points, ranges.

    Split points come from a sample of at most about SAMPLE vectors, picked by hash;
    every vector is placed, and ranges are of all of them.
    """
    n = vectors.count()
    depth = 1
    while depth < LEVELS and ways**depth * leaf < n:
        depth += 1
    wanted = min(SAMPLE, 8 * ways**depth)
    picked = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 20)) < int(min(1.0, wanted / max(n, 1)) * (1 << 20)) + 1
    drawn = vectors.where(picked).select("v").toArrow().column("v")
    if not len(drawn):
        drawn = vectors.select("v").limit(1).toArrow().column("v")
    sample = packed.matrix(drawn)
    tree = build(np.unique(sample, axis=0) if len(sample) else sample, depth, ways)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # bounded by WAYS and LEVELS

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, _ = place(shared.value, packed.matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["leaf", *batch.schema.names])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = packed.matrix(batch.column("v"))
            at, away = place(shared.value, x)
            away = np.hstack([away, np.linalg.norm(x, axis=1, keepdims=True)])
            for leaf_ in np.unique(at).tolist():
                own = away[at == leaf_]
                low[leaf_], high[leaf_] = np.minimum(low.get(leaf_, np.inf), own.min(axis=0)), np.maximum(high.get(leaf_, -np.inf), own.max(axis=0))
        for leaf_ in low:
            yield pa.RecordBatch.from_arrays([pa.array([leaf_]), pa.array([low[leaf_].tolist()]), pa.array([high[leaf_].tolist()])], ["leaf", "low", "high"])

    cells = materialise(vectors.mapInArrow(put, f"leaf bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in vectors.schema)}"), "negatives-cells")
    each = vectors.select("v").mapInArrow(bounds, "leaf bigint, low array<double>, high array<double>").select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
    found = each.groupBy("leaf", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).toPandas()  # leaves x split points on the way
    wide = ways * depth + 1
    kinds = np.unique(found["leaf"].to_numpy(np.int64))
    low, high = np.zeros((len(kinds), wide)), np.zeros((len(kinds), wide))
    at = np.searchsorted(kinds, found["leaf"].to_numpy(np.int64)), found["i"].to_numpy(np.int64)
    low[at], high[at] = found["low"], found["high"]
    return cells, tree, ranges(tree, kinds, low, high)


def _percent(score: Column, percent: int, more: int) -> Column:
    """(percent * score + more) div 100 of a score that is not negative, in whole numbers."""
    whole = score * percent + more
    return ((whole - whole % 100) / 100).cast("double")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, ways: int = WAYS, leaf: int = LEAF) -> DataFrame:
    """Hard negatives of anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v (array of whole numbers).  A row's score is its inner
    product with the anchor; higher ones come first, ties by smaller vec_id, null ids
    last.  An anchor's positives are its first other rows of its label; each has as
    negatives the first rows of other labels whose score is from ``low`` to ``high``
    percent of the positive's.

    Rows with a null label, a null vector or a null component take no part.  Shorter
    vectors are filled up with zeros.  Equal vectors of a label are one entry that
    keeps its first rows by id, as many as a result can need, so a group of copies
    takes no more room than that; anchors that are copies are searched once.
    Repeated rows are rows of their own.  Components whose products could pass
    2^53 are an error.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    good = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).select("vec_id", F.col("label").cast("bigint").alias("label"), "v", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    facts = good.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims, largest = facts[0] or 0, facts[1] or 0
    if dims * largest**2 >= EXACT:
        raise ValueError(f"products of {dims} components up to {largest} are not exact")

    packed = Packed(max(dims, 1), "i2" if largest < 1 << 15 else "i4" if largest < 1 << 31 else "i8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            out = np.zeros((len(v), packed.dims), np.int64)
            out[np.repeat(np.arange(len(v)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), packed.column(out)], [*names, "v"])

    names = ["vec_id", "label", "anchor", "key"]
    given = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("v").cast("array<bigint>").alias("v"), "anchor", F.monotonically_increasing_id().alias("key"))
    table = materialise(given.mapInArrow(pack, "vec_id bigint, label bigint, anchor boolean, key bigint, v binary"), "negatives-rows")
    order = [F.col("vec_id").asc_nulls_last(), F.col("key")]
    kept = table.withColumn("_r", F.row_number().over(Window.partitionBy("v", "label").orderBy(*order))).where(F.col("_r") <= max(positives + 1, negatives))
    vectors = materialise(kept.groupBy("v", "label").agg(F.collect_list(F.struct("vec_id", "key")).alias("members")), "negatives-vectors")
    cells, tree, held = index(vectors, packed, ways=ways, leaf=leaf)
    anchors = table.where("anchor")
    asks = materialise(anchors.groupBy("v", "label").agg(F.min("key").alias("query")), "negatives-queries")
    of = materialise(anchors.join(asks, ["v", "label"]).select(F.col("vec_id").alias("anchor_id"), F.col("key").alias("_anchor"), "query"), "negatives-anchors")
    one = F.struct(F.lit(0).alias("slot"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    whole = asks.select("query", "label", "v", F.array(one).alias("windows"))
    near = search(whole, cells, tree, held, packed, positives + 1, True)
    near = materialise(near.select("query", "score", F.col("vec_id").alias("positive_id"), F.col("key").alias("_positive")), "negatives-positives")
    scores = near.where("score >= 0").groupBy("query").agg(F.sort_array(F.collect_set("score")).alias("s"))  # below 0 a window is empty; positives + 1 at most
    windows = F.transform("s", lambda x, i: F.struct(i.cast("int").alias("slot"), _percent(x, low, 99).alias("low"), _percent(x, high, 0).alias("high")))
    asked = asks.join(scores, "query")
    hard = search(asked.select("query", "label", "v", windows.alias("windows")), cells, tree, held, packed, negatives, False)
    hard = hard.join(scores, "query").withColumn("positive_score", F.get("s", F.col("slot")))
    own = of.join(near, "query").where(F.col("_anchor") != F.col("_positive"))
    rank = F.row_number().over(Window.partitionBy("_anchor").orderBy(F.desc("score"), F.col("positive_id").asc_nulls_last(), "_positive"))
    pairs = own.withColumn("_r", rank).where(F.col("_r") <= positives).select("anchor_id", "query", "positive_id", F.col("score").alias("positive_score"))
    chosen = hard.select("query", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(chosen, ["query", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
