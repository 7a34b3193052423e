"""Benchmark decontamination: a BM25 inverted index, block-max WAND, then overlap checks.

The benchmark's items are the indexed documents and every training passage is a
query.  Posting lists keep items in document order, cut into blocks of which each
list knows its largest contribution.

A passage's blocks are bounded first: the block maxima of its lists are added up
over all blocks in which they have postings, and blocks whose sum stays below the
threshold are skipped.  In the others the lists are walked in document order: the
pivot is the first item at which the maxima of the lists up to it reach the
threshold, lists skip to it, and only pivots are scored.  So every item above the
threshold is found.  Question and answer of a found item are then looked for in
the text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vectorloom.llm.bytehash import LOWER, Prefix, Words, buffers, mix, words
from vectorloom.llm.common import chunks, lean_workers, materialise

#: Items of a block of a posting list.
BLOCK = 4
SHINGLE = 5
#: Bytes of benchmark text in one part of the index; every part is sent to all tasks.
PART_BYTES = 4 << 20
#: Bytes of text whose words and passages a task holds at a time.
CHUNK_BYTES = 1 << 19
#: Block maxima that are added up at a time.
HELD = 1 << 20
_TABLE_BITS = 18


class Index(NamedTuple):
    """A part of the inverted index; weights are shares of an item's own score."""

    items: list  # item ids, in document order
    kind: T.DataType  # of the ids
    terms: np.ndarray  # sorted hashes of terms
    table: np.ndarray  # slot of a hash -> first term that falls there
    first: np.ndarray  # first block of each term's list, and the total
    block: np.ndarray  # block numbers, ascending within a list
    most: np.ndarray  # largest weight of the list in the block
    begin: np.ndarray  # first posting of each block, and the total
    item: np.ndarray  # postings: places of items, ascending within a list
    weight: np.ndarray  # postings: contribution to the item
    parts: list[tuple[np.ndarray, np.ndarray]]  # shingles of question and answer
    span: int  # words of a passage's stride


#: Bytes that don't count at the end of a word, so marks glued to a passage don't hide it.
_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b"#*$%&|<>.,;:!?\"')]}")] = True


def tokens(column: pa.Array) -> Words:
    """Words of texts, lower-cased, without marks at their end."""
    data, at = buffers(column)
    w = words(data, at)
    end = w.end.copy()
    while True:
        cut = np.flatnonzero((end - w.start > 1) & _TAIL[data[end - 1]]) if len(end) else end
        if not len(cut):
            break
        end[cut] -= 1
    return w._replace(end=end, hash=Prefix(LOWER[data]).slices(w.start, end))


def _grams(w: Words, a: int, b: int, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of words a to b; fewer words are one shingle."""
    h = w.hash[a:b]
    if len(h) == 0:
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return np.unique(mix(out))


class Benchmark(NamedTuple):
    """Items with their terms, term frequencies over all of them, and in how many parts they are indexed."""

    items: DataFrame  # item_id, text, n, terms, part
    frequency: DataFrame  # term, df
    kind: T.DataType  # of item_id
    count: int
    mean: float
    longest: int
    parts: int
    k1: float
    b: float

    def part(self, number: int) -> Index | None:
        """The index of one part; None if no item fell into it."""
        own = self.items.where(F.col("part") == number)
        rows = own.select("item_id", "text").collect()
        if not rows:
            return None
        df = own.select(F.explode("terms").alias("term")).distinct().join(self.frequency, "term").toPandas()
        at = np.argsort(df["term"].to_numpy(np.int64).view(np.uint64))
        return _part([r.item_id for r in rows], [r.text for r in rows], self.kind, df["df"].to_numpy(np.int64)[at], self.count, self.mean, int(max(32, self.longest)), self.k1, self.b)


def build(benchmark: DataFrame, part_bytes: int = PART_BYTES, k1: float = 1.2, b: float = 0.75) -> Benchmark | None:
    """Prepares the index of the benchmark (item_id, text); None if it has no text with a word.

    Items are cut into words once and written; frequencies of terms and the mean
    length are counted over all items by Spark.  Parts of about ``part_bytes`` of
    items are indexed when they are searched, each in full.

    item_id may be of any type and null; items repeated in full are one, and texts
    that share an id are items of their own.
    """
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), *T.StructType.fromDDL("text string, n bigint, terms array<bigint>").fields])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text"):
                w = tokens(some.column("text"))
                sets = [np.unique(w.hash[a:z]).view(np.int64) for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("item_id"), some.column("text"), pa.array(np.diff(w.first), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema.names)

    given = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    held = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-held // part_bytes))
    cut = given.distinct().mapInArrow(split, schema).where("n > 0")
    items = materialise(cut.withColumn("part", F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(parts))), "benchmark-items")
    count, mean, longest = items.agg(F.count("*"), F.avg("n"), F.max("n")).first()
    if not count:
        return None
    frequency = materialise(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "benchmark-terms")
    return Benchmark(items, frequency, kind, count, mean, longest, parts, k1, b)


def _part(ids: list, texts: list[str], kind: T.DataType, df: np.ndarray, count: int, mean: float, span: int, k1: float, b: float) -> Index:
    """The index of some items, given the frequencies of their terms in order of hash."""
    order = sorted(range(len(ids)), key=lambda i: (-len(texts[i]), texts[i], str(ids[i])))  # like lengths share a block, which tightens bounds
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    w = tokens(pa.array(texts, pa.string()))
    sizes = np.diff(w.first)
    terms, which = np.unique(w.hash, return_inverse=True)
    key, tf = np.unique(which.astype(np.int64) * len(ids) + w.row, return_counts=True)  # by term, then item
    term, item = key // len(ids), key % len(ids)
    idf = np.log(1 + (count - df + 0.5) / (df + 0.5))[term]
    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[item] / mean))
    weight = (weight / np.bincount(item, weights=weight)[item]).astype(np.float32)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)
    begin = np.flatnonzero(new)
    parts = []
    for r, text in enumerate(texts):
        a, z = int(w.first[r]), int(w.first[r + 1])
        cut = _answer_start(text, z - a) + a
        parts.append((_grams(w, a, cut), _grams(w, cut, z)))
    table = np.zeros(1 << _TABLE_BITS, dtype=np.int32)
    table[(terms[::-1] >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = np.arange(len(terms), 0, -1)
    return Index(ids, kind, terms, table, np.searchsorted(term[begin], np.arange(len(terms) + 1)), item[begin] // BLOCK, np.maximum.reduceat(weight, begin), np.append(begin, len(key)), item, weight, parts, span)


def _answer_start(text: str, n: int) -> int:
    """Word at which an item's answer starts: its last sentence, or its last third."""
    tokens = text.split()
    ends = [i + 1 for i, t in enumerate(tokens[:-1]) if t[-1] in ".?!:"]
    at = next((i for i in reversed(ends) if n - i >= SHINGLE), None)
    return at if at is not None and at >= SHINGLE else n - n // 3


def _lookup(index: Index, h: np.ndarray) -> np.ndarray:
    """Term of each hash, -1 if the benchmark doesn't have it."""
    at = index.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.int64) - 1
    found = np.full(len(h), -1, dtype=np.int64)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        hit = index.terms[at[open_]] == h[open_]
        found[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1  # terms that share a slot are neighbours
        inside = at[open_] < len(index.terms)
        open_ = open_[inside]
        open_ = open_[index.terms[at[open_]] <= h[open_]]
    return found


def walk(lists: list[tuple[float, list[int], list[float]]], threshold: float) -> list[tuple[int, float]]:
    """Items of a block that reach the threshold, by pivots, and their scores.

    Each list has its maximum in the block, its items in order and their weights.
    """
    at = [0] * len(lists)
    found = []
    while True:
        live = sorted((items[at[i]], i) for i, (_, items, _) in enumerate(lists) if at[i] < len(items))
        bound, pivot = 0.0, -1
        for item, i in live:
            bound += lists[i][0]
            if bound >= threshold - 1e-4:
                pivot = item
                break
        if pivot < 0:
            return found
        if live[0][0] == pivot:
            on = [i for item, i in live if item == pivot]
            score = sum(lists[i][2][at[i]] for i in on)
            if score >= threshold - 1e-6:
                found.append((pivot, score))
            for i in on:
                at[i] += 1
        else:
            for item, i in live:
                if item >= pivot:
                    break
                while at[i] < len(lists[i][1]) and lists[i][1][at[i]] < pivot:
                    at[i] += 1


def candidates(index: Index, w: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, items and scores of passages that reach the threshold.

    Passages are windows of twice ``span`` words that start every ``span`` words of a
    text, so a copy of any item lies inside one of them.
    """
    term = _lookup(index, w.hash)
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    place = (np.arange(len(w.hash)) - w.first[w.row])[at] // index.span
    row, term = w.row[at].astype(np.int64), term[at]
    key = np.concatenate([row << 32 | place, (row << 32 | place - 1)[place > 0]])  # passage by its first stride
    term = np.concatenate([term, term[place > 0]])
    order = np.lexsort((term, key))
    key, term = key[order], term[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (term[1:] != term[:-1])
    key, term = key[new], term[new]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    passage = np.cumsum(fresh) - 1
    key = key[fresh]
    many = np.diff(index.first)[term]  # blocks of each list
    upto = np.cumsum(np.bincount(passage, weights=many, minlength=len(key)))
    wide = int(index.block.max()) + 1
    group = np.maximum(upto.astype(np.int64) // HELD, np.arange(len(key)) * wide // (4 * HELD))  # passages that are bounded together
    cuts = np.searchsorted(group, np.arange(int(group[-1]) + 2))
    rows: list[int] = []
    items: list[int] = []
    scores: list[float] = []
    for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if p == q:
            continue
        a, z = np.searchsorted(passage, [p, q])
        n = many[a:z]
        entry = np.repeat(index.first[term[a:z]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(passage[a:z] - p, n) * wide + index.block[entry]
        opened = np.bincount(cell, weights=index.most[entry], minlength=(q - p) * wide) >= threshold - 1e-4
        keep = opened[cell]
        entry, cell = entry[keep], cell[keep]
        order = np.argsort(cell, kind="stable")
        entry, cell = entry[order], cell[order]
        first, last = index.begin[entry].tolist(), index.begin[entry + 1].tolist()
        most = index.most[entry].tolist()
        start = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)).tolist()
        for i, j in itertools.pairwise(start):
            lists = [(most[e], index.item[first[e] : last[e]].tolist(), index.weight[first[e] : last[e]].tolist()) for e in range(i, j)]
            for item, score in walk(lists, threshold):
                rows.append(int(key[p + cell[i] // wide]) >> 32)
                items.append(item)
                scores.append(score)
    return np.array(rows, np.int64), np.array(items, np.int64), np.array(scores, np.float64)


def find_leaks(docs: DataFrame, benchmark: Benchmark | None, threshold: float = 0.5, overlap: float = 0.75) -> DataFrame:
    """Benchmark items that stand in documents: doc_id, item_id, score, question_overlap, answer_overlap.

    One row per document and item whose best passage has ``threshold`` or more of
    the item's own BM25 score, if the document then holds ``overlap`` or more of
    the five-word shingles of both the item's question and its answer.  An item's
    answer is its last sentence; an item without a second one is cut at its last
    third.  Case of A-Z is ignored.

    Null and empty texts match nothing; neither do items without a word.  Repeated
    rows give repeated results, a null doc_id or item_id stays null, both keep
    their types, other columns are ignored, and an empty table or benchmark gives
    an empty result.  Whole texts are queried, passage by passage.

    A benchmark of several parts is searched part by part: one is indexed, sent to
    the tasks, searched, its finds written, and released before the next, so driver
    and tasks hold one part at a time; documents are read once for every part.
    """
    kind = benchmark.kind if benchmark else T.LongType()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", kind), *T.StructType.fromDDL("score double, question_overlap double, answer_overlap double").fields])
    if benchmark is None:
        return docs.sparkSession.createDataFrame([], schema)
    found = []
    for number in range(benchmark.parts):
        index = benchmark.part(number)
        if index is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of a part, whose size build() bounds
        leaks = _search(docs, shared, index.kind, schema, threshold, overlap)
        if benchmark.parts == 1:
            return leaks
        found.append(materialise(leaks, "benchmark-leaks"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _search(docs: DataFrame, shared: Broadcast[Index], kind: T.DataType, schema: T.StructType, threshold: float, overlap: float) -> DataFrame:
    """find_leaks for one part of the index."""
    lean_workers(docs.sparkSession)
    kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                w = tokens(part.column("text"))
                best: dict[tuple[int, int], float] = {}
                for r, i, s in zip(*(x.tolist() for x in candidates(ix, w, threshold)), strict=True):
                    best[r, i] = max(s, best.get((r, i), 0.0))
                grams: dict[int, np.ndarray] = {}
                out = []
                for (r, i), s in sorted(best.items()):
                    if r not in grams:
                        grams[r] = np.concatenate([_grams(w, w.first[r], w.first[r + 1], n) for n in range(1, SHINGLE + 1)])
                    shares = [float(np.isin(p, grams[r]).mean()) if len(p) else 1.0 for p in ix.parts[i]]
                    if min(shares) >= overlap:
                        out.append((r, ix.items[i], min(s, 1.0), *shares))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(columns[0])), pa.array(columns[1], kind), *(pa.array(c, pa.float64()) for c in columns[2:])], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
