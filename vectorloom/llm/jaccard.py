"""Exact n-gram Jaccard self-join by vertical partitioning.

The global order of n-grams is cut into fragments, wherever n-grams are counted:

1. Suspects.  Fragments of half the order (n-grams whose hash has no top bit)
   count in how many distinct sets each n-gram stands, over all documents.  A set
   of n n-grams that is similar to another shares ceil(t n) of them, so at most
   the rest of its half may stand in no other set.  The others are suspects.
2. Order.  Fragments of the whole order count the same among the suspects.  The
   order that filters pairs is by that number, rare n-grams first.
3. Partners.  Similar sets share an n-gram of the rarest (1 - t) n + 1 of either.
   Every set is first compared with one partner only, the most central of those
   with which it shares such n-grams, and linked sets become one class.  This
   gathers large groups of copies without looking at their pairs.
4. Pairs.  Then all pairs of sets of different classes that share an n-gram early
   enough in the order for their sizes are compared.

To compare pairs, their sets are cut into fragments of the order too.  Each set is
sent to the fragments of its block once; a fragment counts the partial overlaps of
the block's pairs, and their sums over the fragments decide which pairs link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.bytehash import buffers, mix, shingles, words
from vectorloom.llm.common import chunks, lean_workers, materialise, scratch, semi
from vectorloom.llm.components import connect

#: Bytes of text whose n-grams make up one fragment, and bytes of n-grams of one fragment of a comparison.
FRAGMENT_BYTES, COMPARE_BYTES = 12 << 20, 8 << 20
#: Fragments that the sets of a block are cut into at least, and pairs of a block that one task takes.
FRAGMENTS, TASK_PAIRS = 4, 1 << 20
#: Rounds in which every set meets one partner before all pairs are looked at.
ROUNDS = 1
#: n-grams that a task collects before it sends them.
HELD = 1 << 19
#: Stands for a null doc_id, which counts as smaller than any other.
NO_ID = -(1 << 63)

_SUM = np.uint64(0x5851F42D4C957F2D)
_NODE = np.dtype([("node", "<i8"), ("id", "<i8"), ("n", "<i4"), ("half", "<i4")])
_SEEN = np.dtype([("node", "<i8"), ("c", "<i4")])
_OWNER = np.dtype([("node", "<i8"), ("n", "<i4"), ("c", "<i4")])
_COUNTED = np.dtype([("node", "<i8"), ("n", "<i4"), ("df", "<i4"), ("gram", "<u8")])


def node_of(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; equal sets, and only they, share it."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _SUM))])
    n = np.diff(first).astype(np.uint64)
    return mix((sums[first[1:]] - sums[first[:-1]]) * np.uint64(3) + n).view(np.int64)


def needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """n-grams that a set of n shares with any similar set, at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def place(value: np.ndarray, parts: int) -> np.ndarray:
    """Part of 0 to parts - 1 that a 64-bit hash belongs to, by its bits 31 to 62."""
    return ((value.view(np.uint64) >> np.uint64(31)) & np.uint64(0xFFFFFFFF)).astype(np.int64) * parts >> 32


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(words(*buffers(part.column("text"))), part.num_rows, size)


def _read(cells: list[bytes], dtype: np.dtype | type) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(c, dtype) for c in cells)])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _cut(frag: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Rows of columns by fragment."""
    if not len(frag):
        return
    order = np.argsort(frag.astype(np.uint16) if int(frag.max()) < 1 << 16 else frag, kind="stable")
    frag, columns = frag[order], tuple(c[order] for c in columns)
    start = _starts(frag)
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(frag)], strict=True):
        yield int(frag[a]), tuple(c[a:b] for c in columns)


def _owned(frag: np.ndarray, node: np.ndarray, n: np.ndarray, gram: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Cells of n-grams by fragment: the owners, each with how many follow, and the n-grams."""
    out = []
    for f, (o, m, g) in _cut(frag, node, n, gram):
        start = _starts(o)
        owner = np.zeros(len(start), _OWNER)
        owner["node"], owner["n"], owner["c"] = o[start], m[start], np.diff(np.append(start, len(o)))
        out.append((f, owner.tobytes(), g.tobytes()))
    return out


def _shared(node: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n-grams that stand in two distinct sets or more, one per set, and that number."""
    ordered = np.sort(gram)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return (np.zeros(0, np.int64),) * 2
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, gram), len(twice) - 1)] == gram)
    at = at[np.lexsort((node[at], gram[at]))]
    at = at[_starts(gram[at], node[at])]  # copies are one
    start = _starts(gram[at])
    df = np.diff(np.append(start, len(at)))
    df = np.repeat(df, df)
    return at[df > 1], df[df > 1]


def _cells(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["frag", "kind", "owner", "gram"])


_CELLS = "frag int, kind int, owner binary, gram binary"


def _count(texts: DataFrame, fragments: int, size: int) -> DataFrame:
    """Step 1 by fragments: rows (kind 0: id, node, n) and cells by node (1: _NODE; 2: _SEEN)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            known: set[int] = set()  # sets that this batch has sent
            weight = 0

            def send() -> pa.RecordBatch:
                info, node, gram = (np.concatenate(x) for x in zip(*held, strict=True))
                frag = place(gram, fragments)
                rows = [(f, 3, o, g) for f, o, g in _owned(frag, node, np.zeros(len(node), np.int32), gram.astype(np.uint32))]
                rows.append((int(info["node"][0] & 0x7FFFFFFF) % fragments, 0, info.tobytes(), b""))
                order = np.lexsort((info["id"], info["node"]))
                alone = info[order][_starts(info["node"][order])]
                rows += [(f, 1, x.tobytes(), b"") for f, (x,) in _cut(place(alone["node"], fragments), alone)]
                held.clear()
                return _cells(rows)

            for part in chunks(batch, "text"):
                sets, first = _sets(part, size)
                node, n = node_of(sets, first), np.diff(first)
                fresh = np.zeros(len(n), dtype=bool)
                for i, x in enumerate(node.tolist()):
                    if x not in known:
                        known.add(x)
                        fresh[i] = True
                row = np.repeat(np.arange(len(n)), n)
                half = sets < np.uint64(1 << 63)
                info = np.zeros(len(n), _NODE)
                info["node"], info["id"], info["n"] = node, part.column("id").to_numpy(zero_copy_only=False), n
                info["half"] = np.bincount(row[half], minlength=len(n))
                half &= fresh[row]
                held.append((info, node[row[half]], sets[half]))
                weight += int(half.sum())
                if weight >= HELD:
                    yield send()
                    weight = 0
            if held:
                yield send()

    def gather(table: pa.Table) -> pa.Table:
        kinds, owners, grams = (table.column(c).to_pylist() for c in ("kind", "owner", "gram"))
        of = lambda k, cells: [c for c, x in zip(cells, kinds, strict=True) if x == k]
        info = _read(of(0, owners), _NODE)
        cells = [(int(table.column("frag")[0].as_py()), 1, c) for c in of(1, owners)]
        owner = _read(of(3, owners), _OWNER)
        node = np.repeat(owner["node"], owner["c"])
        at, _ = _shared(node, _read(of(3, grams), np.uint32))
        names, c = np.unique(node[at], return_counts=True)
        seen = np.zeros(len(names), _SEEN)
        seen["node"], seen["c"] = names, c
        cells += [(f, 2, x.tobytes()) for f, (x,) in _cut(place(names, fragments), seen)]
        k, m = len(info), len(cells)
        whole = [pa.array(np.concatenate([info[c].astype(np.int64), np.zeros(m, np.int64)])) for c in ("id", "node", "n")]
        return pa.table([pa.array([0] * k + [x for _, x, _ in cells], pa.int32()), *whole, pa.array([None] * k + [f for f, _, _ in cells], pa.int32()), pa.array([None] * k + [x for _, _, x in cells], pa.binary())], names=["kind", "id", "node", "n", "frag", "data"])

    return texts.mapInArrow(cut, _CELLS).repartition(fragments, "frag").groupBy("frag").applyInArrow(gather, "kind int, id bigint, node bigint, n bigint, frag int, data binary")


def _suspects(counted: DataFrame, fragments: int, similarity: float) -> DataFrame:
    """Sets that may be similar to another: node, id of one document, n."""

    def judge(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        info, seen = (_read([c for c, x in zip(data, kinds, strict=True) if x == k], t) for k, t in ((1, _NODE), (2, _SEEN)))
        info = info[np.lexsort((info["id"], info["node"]))]
        info = info[_starts(info["node"])]
        shared = np.bincount(np.searchsorted(info["node"], seen["node"]), weights=seen["c"], minlength=len(info))
        n = info["n"].astype(np.int64)
        maybe = info[(n > 0) & (shared >= info["half"] - (n - needed(n, similarity)))]
        return pa.table({c: pa.array(maybe[c].astype(np.int64)) for c in ("node", "id", "n")})

    cells = counted.where("kind > 0").select("frag", "kind", "data")
    return cells.repartition(fragments, "frag").groupBy("frag").applyInArrow(judge, "node bigint, id bigint, n bigint")


def _ordered(texts: DataFrame, suspects: DataFrame, size: int, similarity: float) -> DataFrame:
    """Sets that may be similar to another, by all their n-grams: node, n, grams, prefix, central.

    ``grams`` has those that another suspect holds too, in the global order, and
    ``prefix`` is how many of them are among the set's first (1 - t) n + 1.
    ``central`` is the mean number of suspects that hold an n-gram of the set.
    """
    weight = suspects.agg(F.sum("n")).first()[0] or 0
    fragments = max(4, -(-weight * 16 // FRAGMENT_BYTES))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                value, first = _sets(part, size)
                cells = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node_of(value, first)), pa.array(cells, pa.binary())], ["node", "grams"])

    found = semi(semi(texts, suspects.select("id").distinct(), "id").mapInArrow(sets, "node bigint, grams binary"), suspects.select("node"), "node")
    found = materialise(found, "jaccard-found")  # else one task has two Python workers, and every core keeps two from then on

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, cells = batch.column("node").to_numpy(zero_copy_only=False), batch.column("grams").to_pylist()
            n = np.array([len(c) // 8 for c in cells], dtype=np.int64)
            edge = np.cumsum(n) // HELD
            for a, b in zip(*((s := _starts(edge)).tolist(), [*s[1:].tolist(), len(n)]), strict=True):
                gram = _read(cells[a:b], np.uint64)
                yield _cells([(f, 0, o, g) for f, o, g in _owned(place(gram, fragments), np.repeat(node[a:b], n[a:b]), np.repeat(n[a:b], n[a:b]), gram)])

    def count(table: pa.Table) -> pa.Table:
        owner, gram = _read(table.column("owner").to_pylist(), _OWNER), _read(table.column("gram").to_pylist(), np.uint64)
        at, df = _shared(np.repeat(owner["node"], owner["c"]), gram)
        out = np.zeros(len(at), _COUNTED)
        out["node"], out["n"], out["df"], out["gram"] = np.repeat(owner["node"], owner["c"])[at], np.repeat(owner["n"], owner["c"])[at], df, gram[at]
        rows = [(f, x.tobytes()) for f, (x,) in _cut(place(out["node"], fragments), out)]
        return pa.table({"part": pa.array([f for f, _ in rows], pa.int32()), "data": pa.array([x for _, x in rows], pa.binary())})

    def sift(table: pa.Table) -> pa.Table:
        r = _read(table.column("data").to_pylist(), _COUNTED)
        r = r[np.lexsort((r["gram"], r["df"], r["node"]))]
        start = _starts(r["node"])
        c, n = np.diff(np.append(start, len(r))), r["n"][start].astype(np.int64)
        need = needed(n, similarity)
        keep = np.flatnonzero(c >= need)
        prefix = np.maximum(0, n - need + 1 - (n - c))  # n-grams that no one shares come first
        gram = np.ascontiguousarray(r["gram"])
        cells = [gram[a : a + k].tobytes() for a, k in zip(start[keep].tolist(), c[keep].tolist(), strict=True)]
        central = np.add.reduceat(r["df"].astype(np.float64), start) / n if len(start) else np.zeros(0)
        return pa.table({"node": pa.array(r["node"][start[keep]]), "n": pa.array(n[keep]), "grams": pa.array(cells, pa.binary()), "prefix": pa.array(prefix[keep]), "central": pa.array(central[keep])})

    counted = found.mapInArrow(cut, _CELLS).repartition(fragments, "frag").groupBy("frag").applyInArrow(count, "part int, data binary")
    return counted.repartition(fragments, "part").groupBy("part").applyInArrow(sift, "node bigint, n bigint, grams binary, prefix bigint, central double")


def _filings(sets: DataFrame) -> DataFrame:
    """One row for each n-gram of each prefix: gram, node, n, central, and its place in the set's order from 0."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("prefix").to_numpy().astype(np.int64)
            cells = [np.frombuffer(c, np.int64, p) for c, p in zip(batch.column("grams").to_pylist(), k.tolist(), strict=True)]
            whole = np.array([len(c) // 8 for c in batch.column("grams").to_pylist()], dtype=np.int64)
            lead = batch.column("n").to_numpy() - whole  # n-grams of its own come first
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lead, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *cells])), *(pa.array(np.repeat(batch.column(c).to_numpy(), k)) for c in ("node", "n", "central")), pa.array(at)], ["gram", "node", "n", "central", "place"])

    return sets.mapInArrow(file, "gram bigint, node bigint, n bigint, central double, place bigint")


def _near(a: Column, b: Column, similarity: float) -> Column:
    """Whether sizes are near enough for similar sets."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def overlaps(i: np.ndarray, j: np.ndarray, first: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Partial overlap of each pair of sets i and j: n-grams here that both hold."""
    k = np.diff(first)
    swap = k[i] > k[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)  # the smaller side is looked up in the larger
    _, rank = np.unique(gram, return_inverse=True)
    span = int(rank.max(initial=0)) + 1
    held = np.sort(np.repeat(np.arange(len(k)), k) * span + rank)
    out = np.zeros(len(i), dtype=np.int64)
    edge = np.cumsum(k[i]) // HELD
    cuts = _starts(edge) if len(edge) else np.zeros(0, np.int64)
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)], strict=True):
        many = k[i[x:y]]
        pair = np.repeat(np.arange(y - x), many)
        at = np.repeat(first[i[x:y]], many) + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        want = j[x:y][pair] * span + rank[at]
        hit = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want if len(held) else np.zeros(0, bool)
        out[x:y] = np.bincount(pair[hit], minlength=y - x)
    return out


def compare(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, block) that link, by partial overlaps in fragments, summed per pair: a, b."""
    members = pairs.select("block", F.col("a").alias("node")).unionByName(pairs.select("block", F.col("b").alias("node"))).distinct()
    sized = members.join(sets.select("node", F.octet_length("grams").cast("bigint").alias("bytes")), "node")
    blocks = sized.groupBy("block").agg(F.sum("bytes").alias("bytes")).join(pairs.groupBy("block").agg(F.count("*").alias("m")), "block")
    cuts = blocks.select("block", F.greatest(F.lit(FRAGMENTS), F.ceil(F.col("bytes") / COMPARE_BYTES)).cast("int").alias("cuts"), F.ceil(F.col("m") / TASK_PAIRS).cast("int").alias("parts"), F.col("bytes").alias("whole"))
    cuts = materialise(cuts, "jaccard-blocks")
    tasks = max(4, -(-(cuts.agg(F.sum(F.col("whole") * F.col("parts"))).first()[0] or 0) // COMPARE_BYTES))
    share = F.xxhash64("block", "k", "part").alias("share")  # of a block: one fragment for some of its pairs
    frag = F.pmod("share", F.lit(tasks)).cast("int").alias("frag")
    each = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = pairs.join(cuts, "block").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int")).withColumn("k", each)
    dealt = dealt.select(share, F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("data"))
    sent = members.join(cuts, "block").join(sets.select("node", "n", "grams"), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "cuts", "node", "n", "grams")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(c, np.uint64) for c in batch.column("grams").to_pylist()]
            rows: list[tuple] = []
            for i, (g, m) in enumerate(zip(cells, batch.column("cuts").to_pylist(), strict=True)):
                rows += [(i, k, x.tobytes()) for k, (x,) in _cut(place(g, m), g)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("block", "part", "node", "n")] + [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["block", "part", "node", "n", "k", "data"])

    cut = sent.mapInArrow(segments, "block bigint, part int, node bigint, n bigint, k int, data binary")
    cut = cut.select(share, F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("n").alias("b"), "data")

    def count(table: pa.Table) -> pa.Table:
        kind, share, a, b = (table.column(c).to_numpy() for c in ("kind", "share", "a", "b"))
        own = lambda x: mix(share.view(np.uint64) ^ mix(x.view(np.uint64)))  # noqa: E731  a set within its share
        name, at, pair = own(a), kind == 0, kind == 1
        cells = table.filter(pa.array(at)).column("data").to_pylist()
        row = np.repeat(np.arange(len(cells)), np.array([len(c) // 8 for c in cells], dtype=np.int64))
        gram = _read(cells, np.uint64)
        names, which = np.unique(name[at], return_inverse=True)
        size = np.zeros(len(names), np.int64)
        size[which] = b[at]
        order = np.lexsort((gram, which[row]))
        first = np.searchsorted(which[row][order], np.arange(len(names) + 1))
        left, right = name[pair], own(b)[pair]
        both = np.isin(left, names) & np.isin(right, names)  # a set may have nothing in this fragment
        left, right = np.searchsorted(names, left[both]), np.searchsorted(names, right[both])
        got = overlaps(left, right, first, gram[order])
        some = got > 0
        return pa.table({"a": a[pair][both][some], "b": b[pair][both][some], "c": got[some], "na": size[left[some]], "nb": size[right[some]]})

    partial = dealt.unionByName(cut).withColumn("frag", frag).repartition(tasks, "frag").groupBy("frag").applyInArrow(count, "a bigint, b bigint, c bigint, na bigint, nb bigint")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return summed.where(F.col("c") >= similarity * (F.col("na") + F.col("nb") - F.col("c")) - 1e-9).select("a", "b")


def _open(filings: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Filings with the class of their set, under n-grams that stand in two classes or more."""
    named = filings.withColumn("class", F.col("node")) if classes is None else filings.join(classes.withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    wide = named.groupBy("gram").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("gram")
    return named.join(wide, "gram")


def _partners(filings: DataFrame, turn: int, similarity: float) -> DataFrame:
    """One pair per set: the centre of another class with which it shares most n-grams of the prefixes.

    The centre under an n-gram is its most central set, to which edited copies are
    nearer than to each other; later turns draw among the most central ones.
    """
    drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    order = F.struct((-F.col("central") * (1 - 0.1 * turn * drawn)).alias("turn"), "node", "n", "class")
    centres = filings.groupBy("gram").agg(F.min(order).alias("centre"))
    met = filings.join(centres, "gram").where((F.col("class") != F.col("centre.class")) & _near(F.col("n"), F.col("centre.n"), similarity))
    shared = met.groupBy("node", F.col("centre.node").alias("b")).agg(F.count("*").alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", "b")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.b").alias("b"), F.col("best.b").alias("block"))


def early(place: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether an n-gram at this place of a set of n may be the first of those shared with a similar set of m.

    Two similar sets share ``common`` n-grams or more.  All but size - common of a
    prefix are among them, and those of the prefix that ends first stand in both,
    so one of the sets has at least the smaller number of them from the first on.
    """
    common = F.ceil(similarity * (m + n) / (1 + similarity) - 1e-9)
    prefix = lambda k: k - F.ceil(similarity * k - 1e-9) + 1
    shared = F.least(*[prefix(k) - (k - common) for k in (n, m)])
    return place <= prefix(n) - shared


def _pairs(filings: DataFrame, similarity: float) -> DataFrame:
    """Pairs of sets of different classes that share an early n-gram: a, b, and their classes ca, cb.

    Under each n-gram, the sets of its largest class are not paired with each other.
    """
    main = filings.groupBy("gram", "class").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max(F.struct("c", "class")).getField("class").alias("main"))
    full = filings.join(main, "gram").select("gram", "main", "node", "n", "class", "place")
    few = full.where(F.col("class") != F.col("main")).select("gram", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("class").alias("cx"), F.col("place").alias("px"))
    apart = (F.col("class") != F.col("cx")) & ((F.col("class") == F.col("main")) | (F.col("x") < F.col("node")))
    n, nx = F.col("n"), F.col("nx")
    met = few.join(full, "gram").where(apart & _near(n, nx, similarity) & early(F.col("place"), n, nx, similarity) & early(F.col("px"), nx, n, similarity))
    low = F.col("x") < F.col("node")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"), pick("cx", "class").alias("ca"), pick("class", "cx").alias("cb")).distinct()


def _placed(pairs: DataFrame) -> DataFrame:
    """Pairs with the block that compares them: of their two classes, the one that has more pairs."""
    both = pairs.select(F.col("ca").alias("class")).unionByName(pairs.select(F.col("cb").alias("class")))
    many = both.groupBy("class").agg(F.count("*").alias("m"))
    of = lambda c, m: many.select(F.col("class").alias(c), F.col("m").alias(m))
    joined = pairs.join(of("ca", "ma"), "ca").join(of("cb", "mb"), "cb")
    return joined.select("a", "b", F.greatest(F.struct(F.col("ma").alias("m"), F.col("ca").alias("block")), F.struct(F.col("mb").alias("m"), F.col("cb").alias("block"))).getField("block").alias("block"))


def links(sets: DataFrame, similarity: float) -> DataFrame | None:
    """Class of every set that links with another: node, root; None if no n-gram stands in two prefixes."""
    filings = materialise(_filings(sets), "jaccard-filings")
    found: DataFrame | None = None
    classes: DataFrame | None = None
    for turn in range(ROUNDS):
        open_ = materialise(_open(filings, classes), "jaccard-open")
        if open_.isEmpty():
            return classes
        pairs = materialise(_partners(open_, turn, similarity), "jaccard-partners")
        more = materialise(compare(pairs, sets, similarity), "jaccard-links")
        found = more if found is None else found.unionByName(more)
        classes = connect(found)
    open_ = materialise(_open(filings, classes), "jaccard-open")
    pairs = materialise(_pairs(open_, similarity), "jaccard-pairs")
    if pairs.isEmpty():
        return classes
    placed = materialise(_placed(pairs), "jaccard-placed")
    last = compare(placed, sets, similarity)
    return connect(last if found is None else found.unionByName(last))


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.75) -> DataFrame:
    """Classes of documents under links: doc_id, n_shingles, component_id.

    A document's set are its distinct runs of ``size`` words, A-Z folded to lower
    case; with fewer words the whole sequence is the only one; without words the
    set is empty and links with nothing.  Two documents link when the
    intersection of their sets is ``similarity`` of the union or more.
    ``component_id`` is the smallest doc_id that links reach, with itself.

    No class misses a link: pairs that are not compared are in one class already,
    or can't be similar.  Documents of equal sets count as one while links are
    searched, so copies cost nothing.  A null text is empty; a null doc_id counts
    as the smallest and stays null; rows repeated in full or in doc_id alone are
    documents of their own; doc_id may be of any ordered type; other columns are
    ignored; an empty table gives an empty result.  n-grams and sets are told
    apart by 64-bit hashes.  Classes that don't settle in the rounds of
    components.connect are an error.
    """
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _similar(docs.select(F.col("doc_id").cast("bigint"), "text"), size, similarity)
    rows = materialise(docs.select(F.col("doc_id").alias("name"), "text", F.monotonically_increasing_id().alias("doc_id")), "jaccard-named")
    named = materialise(_similar(rows.select("doc_id", "text"), size, similarity).join(rows.select("doc_id", "name"), "doc_id"), "jaccard-classes")
    first = F.when(F.count("name") == F.count("*"), F.min("name")).alias("first")  # a null name is the smallest
    firsts = materialise(named.groupBy("component_id").agg(first), "jaccard-firsts")
    return named.join(firsts, "component_id").select(F.col("name").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"))


def _similar(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    lean_workers(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), "text")
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    fragments = max(4, -(-(held or 0) // FRAGMENT_BYTES))
    with scratch(docs.sparkSession):
        counted = materialise(_count(texts, fragments, size), "jaccard-counted", keep=True)
        info = counted.where("kind = 0").select("id", "node", "n")
        suspects = materialise(_suspects(counted, fragments, similarity), "jaccard-suspects")
        sets = materialise(_ordered(texts, suspects, size, similarity), "jaccard-sets")
        classes = links(sets, similarity)
        nodes = info.where("n > 0").groupBy("node").agg(F.min("id").alias("component"))
        if classes is not None:
            # written before they are joined, so that a class or a set of very many documents can be split
            rooted = materialise(nodes.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-rooted")
            least = materialise(rooted.groupBy("root").agg(F.min("component").alias("component")), "jaccard-classes")
            nodes = rooted.select("node", "root").join(least, "root").select("node", "component")
        nodes = materialise(nodes, "jaccard-nodes", keep=True)
    named = info.where("n > 0").join(nodes, "node").select("id", "n", "component").unionByName(info.where("n = 0").select("id", "n", F.col("id").alias("component")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
