"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its own features and those of the lines before and
after it speak for a label, and so do the labels beside it.  Forward-backward
gives each line's probability of being good; the mean over lines, weighted by
length, is calibrated to the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.bytehash import Prefix, buffers, words
from vectorloom.llm.common import chunks, lean_workers

FEATURES = 16
#: The calibrated score at which training documents are told apart best.
CUT = 0.3
#: Weight of the squared penalty on weights and transitions.
PENALTY = 1e-3

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 4 digit, 8 symbol, 16 sentence mark, 32 other punctuation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 4
_CLASS[list(b"#*$%&|<>{}[]^~_=+@\\/")] = 8
_CLASS[list(b".!?")] = 16
_CLASS[list(b",;:'\"()-")] = 32


class Lines(NamedTuple):
    """Lines of a batch: features, word characters, and the first line of each text."""

    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray


class Model(NamedTuple):
    """Unary weights (3 x FEATURES + 1), transitions, and the map to scores."""

    unary: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float


def line_features(texts: pa.Array) -> Lines:
    """Features of every line; a text without lines counts as one empty line."""
    data, at = buffers(texts)
    breaks = np.flatnonzero(data == 10) + 1
    rows = len(at) - 1  # an empty text shares its place with the next; each text has a first line of its own
    inner = breaks[~np.isin(breaks, at)]
    start = np.concatenate([at[:-1], inner])
    owner = np.concatenate([np.arange(rows), np.searchsorted(at, inner, side="right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    first = np.searchsorted(owner, np.arange(rows + 1))
    end = np.append(start[1:], at[-1])
    end[first[1:] - 1] = at[1:]
    w = words(data, at, lower=True)
    word_at = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    # a word is cut at the end of its text, so it lies inside one line
    n = (word_at[1] - word_at[0]).astype(np.float64)
    kinds = _CLASS[data]

    def tally(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[end] - sums[start]).astype(np.float64)

    def word_tally(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[word_at[1]] - sums[word_at[0]]).astype(np.float64)

    ink = word_tally(w.end - w.start)
    chars = np.maximum(ink, 1)
    per = np.maximum(n, 1)
    again = np.zeros(len(w.hash), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    last = kinds[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
    alone = (w.end - w.start == 1) & (last == 8)
    tail = np.zeros(len(start), dtype=np.uint8)
    has = n > 0
    tail[has] = last[word_at[1][has] - 1]
    doubled = np.zeros(len(data), dtype=bool)
    doubled[1:] = (data[1:] == data[:-1]) & (kinds[1:] >= 8)
    copies = _copies(data, start, end, owner, n)
    long = w.end - w.start >= 12
    f = np.stack([
        np.log1p(n) / 4, n == 0, ink / per / 8, tally(kinds == 8) / chars, tally(kinds == 2) / chars, tally(kinds == 4) / chars, tally(kinds == 32) / chars, tally(kinds == 16) / per,
        word_tally(again) / per, word_tally(last == 8) / per, word_tally(alone) / per, tail == 16, tally(doubled) / per, copies > 0, word_tally(long) / per, n < 4,
    ], axis=1).astype(np.float32)
    return Lines(f, ink + 1, first)


def _copies(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 where a line with words stands earlier in the same text."""
    h = Prefix(data).slices(start, end) ^ owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, at = np.unique(h, return_index=True)
    later = np.ones(len(start), dtype=bool)
    later[at] = False
    return later & (n > 0)


def _with_neighbours(lines: Lines) -> np.ndarray:
    """Own, previous and next features and a constant, zero beyond either end."""
    f, k = lines.features, FEATURES
    out = np.zeros((len(f), 3 * k + 1), dtype=np.float32)
    out[:, :k], out[:, -1] = f, 1
    out[1:, k : 2 * k], out[:-1, 2 * k : 3 * k] = f[:-1], f[1:]
    out[lines.first[:-1], k : 2 * k] = 0
    out[lines.first[1:] - 1, 2 * k : 3 * k] = 0
    return out


def marginals(score: np.ndarray, transition: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected pairs of labels of neighbours.

    ``score`` is the log odds of good per line; ``weight``, if given, is that of
    each line's text among the pairs.  Texts are swept side by side,
    line by line, longest first, in log space.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, size = first[:-1][order], sizes[order]
    unary = np.stack([np.zeros_like(score), score], axis=1).astype(np.float64)
    live = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")  # texts with more than t lines
    forward, backward = unary.copy(), np.zeros_like(unary)
    for t in range(1, len(live)):
        at = begin[: live[t]] + t
        step = forward[at - 1][:, :, None] + transition
        forward[at] += np.logaddexp(step[:, 0], step[:, 1])
    for t in range(len(live) - 1, 0, -1):
        at = begin[: live[t]] + t
        step = transition + (unary[at] + backward[at])[:, None, :]
        backward[at - 1] = np.logaddexp(step[:, :, 0], step[:, :, 1])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    later = np.ones(len(score), dtype=bool)
    later[first[:-1]] = False
    at = np.flatnonzero(later)
    pair = forward[at - 1][:, :, None] + transition + (unary[at] + backward[at])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True)) if len(at) else np.zeros((0, 2, 2))
    if not len(at):
        return good, np.zeros((2, 2))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, (pair if weight is None else pair * weight[at][:, None, None]).sum(axis=0)


def _text_means(good: np.ndarray, lines: Lines) -> np.ndarray:
    return np.add.reduceat(good * lines.weight, lines.first[:-1]) / np.add.reduceat(lines.weight, lines.first[:-1])


def slopes(w: np.ndarray, transition: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the weighted mean negative log likelihood of labels y, with its penalties.

    ``weight`` is that of each line's text; features and transitions weigh alike.
    """
    good, pairs = marginals(x @ w, transition, first, weight)
    later = np.ones(len(y), dtype=bool)
    later[first[:-1]] = False
    at = np.flatnonzero(later)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), weight[at])
    return x.T @ ((good - y) * weight) / weight.sum() + PENALTY * w, (pairs - seen) / weight.sum() + PENALTY * transition


def train(lines: Lines, label: np.ndarray, steps: int = 150) -> Model:
    """Fits the field to labels of whole texts, which their lines inherit, by Adam."""
    x, rows = _with_neighbours(lines), np.diff(lines.first)
    y = np.repeat(label, rows).astype(np.float64)
    share = np.clip(label.mean(), 0.02, 0.98)
    weight = np.repeat(np.where(label > 0, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(rows), rows)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        for i, (part, slope) in enumerate(zip((w, trans), slopes(w, trans, x, lines.first, y, weight), strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * slope
            v[i] = 0.99 * v[i] + 0.01 * slope**2
            part -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    mean = _text_means(marginals(x @ w, trans, lines.first)[0], lines)
    slope, offset = _calibrate(mean, label)
    return Model(w, trans, slope, offset)


def _calibrate(mean: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A rising logistic map that puts the best cut between the labels at CUT."""
    order = np.argsort(mean, kind="stable")
    y = label[order] > 0
    missed = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1)
    passed = 1 - np.concatenate([[0], np.cumsum(~y)]) / max((~y).sum(), 1)
    at = int((missed + passed).argmin())
    m = mean[order]
    cut = m[0] / 2 if at == 0 else (m[-1] + 1) / 2 if at == len(m) else (m[at - 1] + m[at]) / 2
    slope = 12.0
    return slope, float(np.log(CUT / (1 - CUT)) - slope * cut)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 6000, fit_lines: int = 1_000_000) -> Model | None:
    """Learns from the texts of labelled documents, about ``fit_docs`` of them and ``fit_lines`` lines at most.

    labels has doc_id and quality; a document with several labels takes the
    larger.  doc_id may be of any type.  The sample is picked by a hash of doc_id,
    documents of the smallest hashes first while their lines fit, and only line
    features of the sample reach the driver.  None if there is no labelled text.
    """
    lean_workers(docs.sparkSession)
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = marks.count()
    pick = F.xxhash64("doc_id")
    share = F.pmod(pick, F.lit(1 << 20)) < min(1 << 20, -(-fit_docs << 20) // max(total, 1))
    drawn = docs.select("doc_id", "text").join(F.broadcast(marks.where(share)), "doc_id")  # about fit_docs rows
    sampled = drawn.select(pick.alias("pick"), "quality", "text", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).alias("lines"))
    sizes = sampled.select("pick", "lines").toPandas().sort_values("pick")
    fits = sizes[sizes["lines"] <= fit_lines]
    fits = fits[fits["lines"].cumsum() <= fit_lines]
    if fits.empty:
        return None
    picked = sampled.where((F.col("lines") <= fit_lines) & (F.col("pick") <= int(fits["pick"].iloc[-1])))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                lines = line_features(part.column("text"))
                cells = [lines.features[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
                sizes = [lines.weight[a:b].tobytes() for a, b in zip(lines.first[:-1], lines.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("pick"), part.column("quality").cast(pa.int32()), pa.array(cells, pa.binary()), pa.array(sizes, pa.binary())], ["pick", "quality", "f", "w"])

    rows: pd.DataFrame = picked.select("pick", "quality", "text").mapInArrow(features, "pick bigint, quality int, f binary, w binary").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["pick", "f", "w"], kind="stable")
    f = np.frombuffer(b"".join(rows["f"]), np.float32).reshape(-1, FEATURES)
    w = np.frombuffer(b"".join(rows["w"]), np.float64)
    first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in rows["w"]])])
    return train(Lines(f, w, first), rows["quality"].to_numpy(np.int64))


def score_lines(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, Lines, np.ndarray]:
    """Score of each text, its lines, and each line's probability of being good."""
    lines = line_features(texts)
    if model is None:
        return np.full(len(lines.first) - 1, 0.5), lines, np.full(len(lines.weight), 0.5)
    good, _ = marginals(_with_neighbours(lines) @ model.unary, model.transition, lines.first)
    return 1 / (1 + np.exp(-(model.slope * _text_means(good, lines) + model.offset))), lines, good


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Scores documents: doc_id, score (0 to 1), line_good (a probability per line).

    Every line of the whole text takes part, empty ones with little weight.  A
    null or empty text is one empty line and is scored like any other.  Without a
    model every score is 0.5.  Repeated rows give repeated results, a null doc_id
    stays null, other columns are ignored, and an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values, lines, good = score_lines(model, part.column("text"))
                per_line = pa.ListArray.from_arrays(pa.array(lines.first, pa.int32()), pa.array(good.astype(np.float32), pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64()), per_line], ["doc_id", "score", "line_good"])

    lean_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, line_good array<float>")
