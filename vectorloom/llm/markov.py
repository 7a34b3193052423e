"""A hidden Markov language model over words: Baum-Welch counts, exact likelihoods.

Words become symbols: the most frequent have one of their own, the others share
symbols by their last bytes and have a probability inside them from their count in
the corpus.  State 0 stands between texts: it alone emits the end, so transitions
from it start a text and transitions to it end one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.bytehash import LOWER, _SPACE, Prefix, buffers
from vectorloom.llm.common import chunks, lean_workers, materialise

#: Hidden states besides the one between texts, words with a symbol of their own, symbols that the others share.
STATES, OWN, SHARED = 12, 8192, 1024
#: Words, the most frequent, whose counts go to every task; counts of the others are joined.  Longer words are known by a digest.
FREQUENT, LONGEST = 200_000, 64
#: Rounds of Baum-Welch, first ones and last ones; the likelihoods of the last ones are kept.
WARM_ROUNDS, ROUNDS = 12, 3
#: Least words of a slice, if the first rounds are to take a slice each, in turn.  None: every round takes everything.
WARM_WORDS: int | None = None
#: Symbols of a run in training; texts longer than LONG symbols are scored by blocks of so many.
RUN, LONG = 64, 4096
CHUNK_BYTES = 1 << 21
#: Runs that train side by side, symbols whose emissions scoring holds at a time, steps between scalings (a step is never below 1e-20 or so).
SIDE, HELD, SCALED = 512, 1 << 18, 8
#: Steps between scalings in training, whose numbers have 32 bits; a step keeps 1e-8 or so, as the best state emits 1.  It divides RUN.
LEAP = 4
#: Pseudo counts: of every transition, and of all symbols of a state together, dealt by their frequency.
MOVES_PRIOR, SYMBOLS_PRIOR = 0.5, 20.0


class Frequent:
    """The most frequent words in order.  Words are looked up by a hash and then compared."""

    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.large_string())
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None  # made once per task, not sent

    def __getstate__(self) -> dict:
        return {"words": self.words, "_sorted": None}

    def places(self, keys: pa.Array) -> np.ndarray:
        """Place of every key among the words, -1 if it isn't one."""
        if not len(self.words) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        if self._sorted is None:
            h = _hashes(self.words)
            order = np.argsort(h)
            self._sorted = h[order], order
        h, order = self._sorted
        at = order[np.minimum(np.searchsorted(h, _hashes(keys)), len(h) - 1)]
        return np.where(pc.equal(keys, self.words.take(pa.array(at))).to_numpy(zero_copy_only=False), at, -1)


def _hashes(words: pa.Array) -> np.ndarray:
    data, at = buffers(words)
    return Prefix(data).slices(at[:-1], at[1:])


class Vocabulary(NamedTuple):
    """Counts of the training words, their sums, and what shared symbols hold."""

    counts: DataFrame  # word (null: the end), n
    total: int
    distinct: int
    ends: int
    words: Frequent
    n: np.ndarray
    own: int  # how many of them have a symbol of their own
    shared_total: np.ndarray  # words of each shared symbol: how often, how many
    shared_distinct: np.ndarray


class Model(NamedTuple):
    vocabulary: Vocabulary
    moves: np.ndarray  # from state x to state
    symbols: np.ndarray  # state x symbol
    likelihoods: list[float]  # natural logarithm per round over all training texts


# --- words ---


class Tokens(NamedTuple):
    row: np.ndarray  # of every word, ascending
    word: np.ndarray  # which distinct word
    keys: pa.Array  # of the distinct words
    first: np.ndarray  # first word of each row, and the total


def tokens(texts: pa.Array) -> Tokens:
    """Words of a batch of texts, A-Z in lower case, and the keys of the distinct ones; null has none."""
    data, at = buffers(texts)
    ink = ~_SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    cuts = at[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = ink[cuts]
    count = np.concatenate([[0], np.cumsum(ink)])
    start = np.flatnonzero(begins)
    offsets = np.concatenate([count[start], [count[-1]]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(LOWER[data][ink]))
    coded = words.dictionary_encode()
    keys = coded.dictionary
    long = np.flatnonzero(pc.binary_length(keys).to_numpy(zero_copy_only=False) > LONGEST)
    word = coded.indices.to_numpy().astype(np.int64)
    if len(long):
        short = keys.to_pylist()
        for i in long.tolist():
            short[i] = " " + hashlib.sha256(short[i].encode()).hexdigest()  # no word has a space
        keys = pa.array(short, pa.large_string())
    first = np.searchsorted(start, at)
    return Tokens(np.repeat(np.arange(len(at) - 1), np.diff(first)), word, keys, first)


def count_words(docs: DataFrame) -> DataFrame:
    """How often every word stands in the texts: word, n.  The null word is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for part in chunks(batch, "text", CHUNK_BYTES):
                t = tokens(part.column("text"))
                yield pa.RecordBatch.from_arrays([t.keys.cast(pa.string()), pa.array(np.bincount(t.word, minlength=len(t.keys)))], ["word", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([ends])], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, frequent: int = FREQUENT, own: int = OWN) -> Vocabulary:
    """Counts all words of the texts; at most ``frequent`` of them, of LONGEST + 1 bytes each, come to the driver."""
    if 1 + own + SHARED > 1 << 16:
        raise ValueError(f"{own} symbols of their own don't fit 16 bits")
    counts = materialise(count_words(docs), "markov-counts")
    real = counts.where(F.col("word").isNotNull())
    levels = real.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(frequent).toPandas()
    past = levels.loc[levels["k"].cumsum() > frequent, "n"]  # words that stand so often or less are not frequent
    top = real.where(F.col("n") > (int(past.iloc[0]) if len(past) else 0)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    bucket = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)), F.lit(SHARED))
    named = top.head(own)
    by = real.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas()  # SHARED rows at most
    total, distinct = np.zeros(SHARED), np.zeros(SHARED)
    total[by["b"]], distinct[by["b"]] = by["n"], by["k"]
    if len(named):
        b = _buckets(pa.array(named["word"].tolist(), pa.large_string()))
        total -= np.bincount(b, weights=named["n"], minlength=SHARED)
        distinct -= np.bincount(b, minlength=SHARED)
    return Vocabulary(counts, int(sums[0]), int(sums[1]), int(sums[2]), Frequent(top["word"].tolist()), top["n"].to_numpy(np.int64), own, total, distinct)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_CRC = _crc_table()


def _buckets(words: pa.Array) -> np.ndarray:
    """CRC-32 of the last three bytes of each word (fewer, if it has no more), modulo SHARED."""
    data, at = buffers(words)
    c = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        has = at[1:] - at[:-1] >= back
        c[has] = _CRC[(c[has] ^ data[at[1:][has] - back]) & 0xFF] ^ (c[has] >> np.uint32(8))
    return (c ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % SHARED


def _symbols_of(keys: pa.Array, frequent: Frequent, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every distinct word: its place among the frequent ones (-1: none) and its symbol."""
    place = frequent.places(keys)
    symbol = place + 1
    others = np.flatnonzero((place < 0) | (place >= own))
    symbol[others] = 1 + own + _buckets(keys.take(pa.array(others)))
    return place, symbol


def frequencies(v: Vocabulary) -> np.ndarray:
    """Share of every symbol among the training tokens, none of them zero."""
    held = np.zeros(1 + v.own + SHARED)
    held[0] = v.ends + 0.5
    held[1 : 1 + min(v.own, len(v.n))] = v.n[: v.own]
    held[1 + v.own :] = v.shared_total + 0.5 * (v.shared_distinct + 1)
    return held / held.sum()


# --- Baum-Welch ---


def starting_point(share: np.ndarray, seed: int, states: int = STATES) -> tuple[np.ndarray, np.ndarray]:
    """States that tend to stay, with frequencies that differ at random; state 0 emits the end and no other does."""
    draw = np.random.default_rng(seed)
    moves = np.full((states + 1, states + 1), 0.2 / states) + 0.8 * np.eye(states + 1)
    moves[0] = 1 / states
    moves[:, 0] = share[0]
    symbols = share[None, :] * np.exp(draw.normal(0, 0.6, (states + 1, len(share))))
    symbols[:, 0] = 0
    symbols[0] = np.eye(1, len(share))[0]
    return moves / moves.sum(axis=1, keepdims=True), symbols / symbols.sum(axis=1, keepdims=True)


def expected_counts(stream: np.ndarray, moves: np.ndarray, emits: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected moves (state x state) and symbols (symbol x state) of a stream of texts, each closed by symbol 0.

    The stream is cut into runs that go side by side, SIDE of them at a time, so that
    what a step touches stays in the processor's caches.  A run begins in state 0
    after an end, else in the states that the symbol before it suggests, ``usual``
    being how often states occur.  ``emits`` is symbol x state.
    """
    k, symbols = len(moves), len(emits)
    n = -(-len(stream) // RUN)
    filled = np.full(n * RUN, symbols, np.int64)  # one more symbol, which says nothing
    filled[: len(stream)] = stream
    runs = filled.reshape(n, RUN)
    before = np.concatenate([[0], runs[:-1, -1]])
    top = np.maximum(emits.max(axis=1), np.finfo(np.float64).tiny)  # of the states; a symbol's emissions are taken relative to it
    table = np.vstack([emits / top[:, None], np.ones((1, k))]).astype(np.float32)
    there, back_there = moves.astype(np.float32), np.ascontiguousarray(moves.T.astype(np.float32))
    every = np.ones(k, np.float32)
    moved, seen, likelihood = np.zeros((k, k)), np.zeros((k, symbols + 1)), float(np.log(top)[stream].sum())
    # states by step, run, state: forward ones, what a step emits and what follows it, what follows a state
    ahead, emit, behind = (np.empty((RUN + 1, min(SIDE, n), k), np.float32) for _ in range(3))
    for a in range(0, n, SIDE):
        at, first = np.ascontiguousarray(runs[a : a + SIDE].T), before[a : a + SIDE]
        f, e, b = (x[:, : len(first)] for x in (ahead, emit, behind))
        f[0] = usual.astype(np.float32) * table[first]
        f[0, first == 0] = np.eye(1, k, dtype=np.float32)
        f[0] /= (f[0] @ every)[:, None]
        scale = np.empty((RUN // LEAP, len(first)), np.float32)
        for t in range(1, RUN + 1):
            table.take(at[t - 1], axis=0, mode="clip", out=e[t])
            np.matmul(f[t - 1], there, out=f[t])
            f[t] *= e[t]
            if t % LEAP == 0:
                np.matmul(f[t], every, out=scale[t // LEAP - 1])
                f[t] /= scale[t // LEAP - 1][:, None]
        b[RUN] = 1
        for t in range(RUN, 0, -1):
            e[t] *= b[t]
            if t % LEAP == 0:
                e[t] /= scale[t // LEAP - 1][:, None]
            np.matmul(e[t], back_there, out=b[t - 1])
        e[1:][at == symbols] = 0  # filling makes no move; what comes before it sees none either
        moved += f[:-1].reshape(-1, k).T @ e[1:].reshape(-1, k)
        b[1:] *= f[1:]
        flat, one = at.ravel(), np.empty(at.shape)
        for j in range(k):
            one[...] = b[1:, :, j]
            seen[j] += np.bincount(flat, weights=one.ravel(), minlength=symbols + 1)
        likelihood += float(np.log(scale, dtype=np.float64).sum())
    return moved * moves, seen[:, :-1].T, likelihood


def maximised(moved: np.ndarray, seen: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves and symbols of the expected counts, with their pseudo counts."""
    moves = moved + MOVES_PRIOR
    symbols = seen.T + SYMBOLS_PRIOR * share[None, :]
    symbols[:, 0] = 0
    symbols[0] = np.eye(1, len(share))[0]
    return moves / moves.sum(axis=1, keepdims=True), symbols / symbols.sum(axis=1, keepdims=True)


def slices_of(total: int) -> int:
    """Slices of WARM_WORDS words or more on average, one if that is None; their number divides WARM_ROUNDS, so all come in equally often."""
    if WARM_WORDS is None:
        return 1
    return max(k for k in range(1, WARM_ROUNDS + 1) if WARM_ROUNDS % k == 0 and k <= max(1, total // WARM_WORDS))


def _streams(docs: DataFrame, v: Vocabulary, slices: int) -> DataFrame:
    """Texts as symbols, many texts in one row, each closed by an end: slice, symbols.  Every text is in one slice."""
    frequent = docs.sparkSession.sparkContext.broadcast(v.words)  # FREQUENT short words at most
    own = v.own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                t = tokens(part.column("text"))
                _, symbol = _symbols_of(t.keys, frequent.value, own)
                size = np.diff(t.first)
                stream = np.zeros(len(t.word) + len(size), np.uint16)
                stream[np.arange(len(t.word)) + t.row] = symbol[t.word]
                of = np.repeat(part.column("slice").to_numpy(), size + 1)
                rows = [(k, s.tobytes()) for k in range(slices) if len(s := stream[of == k])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.binary())], ["slice", "symbols"])

    slice_ = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(slices)).cast("int")
    return docs.select("text", slice_.alias("slice")).mapInArrow(run, "slice int, symbols binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Symbols of several rows at a time, so that runs fill the side-by-side steps; each row closes with an end."""
    held: list[np.ndarray] = []
    for batch in batches:
        for cell in batch.column("symbols"):
            held.append(np.frombuffer(cell.as_buffer(), np.uint16))
            if sum(map(len, held)) >= 32 * SIDE * RUN:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def _round(streams: DataFrame, moves: np.ndarray, symbols: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One expectation step: tasks add up their counts, the sums over tasks come to the driver; they are model-sized.

    A row has the counts of a symbol, of moves from a state, or last the likelihood, a column for each state.
    """
    k, n = symbols.shape
    names = [f"v{j}" for j in range(k)]
    shared = streams.sparkSession.sparkContext.broadcast((moves, np.ascontiguousarray(symbols.T), usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for stream in _joined(batches):
            moved, seen, likelihood = expected_counts(stream, *shared.value)
            part = np.vstack([seen, moved, np.full((1, k), likelihood)])
            total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(v)) for v in total[at].T)], ["at", *names])

    counts = streams.select("symbols").mapInArrow(run, ", ".join(["at int", *(f"{v} double" for v in names)]))
    sums = counts.groupBy("at").agg(*[F.sum(v).alias(v) for v in names]).toPandas()
    shared.unpersist()
    total = np.zeros((n + k + 1, k))
    total[sums["at"]] = sums[names]
    return total[n:-1], total[:n], float(total[-1, 0])


def fit(docs: DataFrame, seed: int = 11, states: int = STATES, frequent: int = FREQUENT, own: int = OWN) -> Model:
    """Learns vocabulary, transitions and symbol frequencies from all texts of ``docs``.

    Every round of Baum-Welch, WARM_ROUNDS + ROUNDS of them, takes all texts.  Only with
    WARM_WORDS do the first WARM_ROUNDS take them slice by slice, dealt by a hash of the
    text.  A null text counts as empty; it has an end.  Without texts all frequencies
    are equal.
    """
    lean_workers(docs.sparkSession)
    v = vocabulary(docs, frequent, own)
    share = frequencies(v)
    moves, symbols = starting_point(share, seed, states)
    slices = slices_of(v.total)
    streams = materialise(_streams(docs, v, slices), "markov-symbols")
    usual, likelihoods = np.full(states + 1, 1 / (states + 1)), []
    for r in range((WARM_ROUNDS + ROUNDS) if v.total else 0):
        moved, seen, likelihood = _round(streams.where(F.col("slice") == r % slices) if r < WARM_ROUNDS else streams, moves, symbols, usual)
        if not seen.any():  # no text fell into the slice
            continue
        moves, symbols = maximised(moved, seen, share)
        usual = seen.sum(axis=0) / seen.sum()
        if r >= WARM_ROUNDS:
            likelihoods.append(likelihood)
    return Model(v, moves, symbols, likelihoods)


# --- likelihoods ---


def forward(stream: np.ndarray, first: np.ndarray, moves: np.ndarray, emits: np.ndarray, long: int = LONG) -> np.ndarray:
    """Natural logarithm of the likelihood of every sequence ``stream[first[i]:first[i + 1]]`` that begins in state 0.

    The scaled forward recursion runs over all sequences side by side.  What a long
    sequence has beyond ``long`` symbols is cut into blocks whose recursion runs from
    every state at once; a block's rows are then put together in order, which is
    the same sum.
    """
    k, size = len(moves), np.diff(first)
    blocks = np.maximum(1, -(-size // long))
    owner = np.repeat(np.arange(len(size)), blocks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    copies = np.where(inner == 0, 1, k)
    block = np.repeat(np.arange(len(owner)), copies)
    state_of = np.arange(len(block)) - np.repeat(np.cumsum(copies) - copies, copies)
    begin = (first[owner] + inner * long)[block]
    length = np.minimum(size[owner] - inner * long, long)[block]
    order = np.argsort(-length, kind="stable")
    state, total = np.empty((len(order), k)), np.empty(len(order))
    upto = np.cumsum(length[order])
    a = 0
    while a < len(order):  # sequences whose symbols' emissions are held at a time
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD, side="right")))
        own = order[a:z]
        state[own], total[own] = _side_by_side(stream, begin[own], length[own], np.eye(k)[state_of[own]], moves, emits)
        a = z
    at = np.cumsum(copies) - copies
    result = total[at[inner == 0]]
    for i in np.flatnonzero(blocks > 1).tolist():
        mine = np.flatnonzero(owner == i)
        belief = state[at[mine[0]]]
        for b in mine[1:].tolist():
            rows, logs = state[at[b] : at[b] + k], total[at[b] : at[b] + k]
            top = logs[belief > 0].max()
            mixed = (belief * np.exp(np.minimum(logs - top, 0))) @ rows
            belief, result[i] = mixed / mixed.sum(), result[i] + top + np.log(mixed.sum())
    return result


def _side_by_side(stream: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last states, which sum to 1, and log likelihoods of sequences, the longest first; scaled every few steps."""
    n, most = len(length), int(length.max(initial=0))
    active = np.searchsorted(-length, -np.arange(1, most + 1), side="right")
    off = np.concatenate([[0], np.cumsum(active)])
    lane = np.repeat(np.arange(n), length)
    inner = np.arange(len(lane)) - np.repeat(np.cumsum(length) - length, length)
    by_step = np.empty(len(lane), np.int64)
    by_step[off[inner] + lane] = stream[np.repeat(begin, length) + inner]
    held = emits[by_step]
    total = np.zeros(n)
    for t, m in enumerate(active.tolist()):
        now = state[:m] @ moves
        now *= held[off[t] : off[t] + m]
        state[:m] = now
        if t % SCALED == SCALED - 1:
            scale = now.sum(axis=1)
            total[:m] += np.log(scale)
            state[:m] /= scale[:, None]
    scale = state.sum(axis=1)
    return state / scale[:, None], total + np.log(scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Likelihoods of whole texts: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is log10 of the model's probability of the text and its end.
    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, where
    c is a token's count in training, N that of all and V how many there are;
    ``n_known`` counts tokens with c > 0.  A null text counts as empty: its only
    token is the end.  Repeated rows give repeated results, a null doc_id stays
    null, other columns are ignored, and an empty table gives an empty result.

    Counts of frequent words are in every task; the other words of a text meet their
    counts in a join, none of them often enough to be a hot key.
    """
    spark = docs.sparkSession
    lean_workers(spark)
    v, own = model.vocabulary, model.vocabulary.own
    given = spark.sparkContext.broadcast((v.words, v.n, v.ends, v.total + 0.5 * (v.distinct + 1), v.shared_total + 0.5 * (v.shared_distinct + 1), model.moves, np.ascontiguousarray(model.symbols.T)))  # model-sized

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, ends, every, shared, moves, emits = given.value
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                t = tokens(part.column("text"))
                rows = part.num_rows
                place, symbol = _symbols_of(t.keys, words, own)
                stream = np.zeros(len(t.word) + rows, np.int64)
                stream[np.arange(len(t.word)) + t.row] = symbol[t.word]
                likelihood = forward(stream, t.first + np.arange(rows + 1), moves, emits) / np.log(10)
                c = np.where(place >= 0, n[np.maximum(place, 0)] if len(n) else 0, 0)
                counted = np.where(place >= 0, np.log10(c + 0.5), 0.0)
                base = counted - np.log10(every)
                inside = np.where(symbol > own, counted - np.log10(shared[np.maximum(symbol - own - 1, 0)]), 0.0)
                add = lambda x, t=t, rows=rows: np.bincount(t.row, weights=x[t.word], minlength=rows)
                base = add(base) + np.log10(ends + 0.5) - np.log10(every)
                cells = [np.diff(t.first) + 1, add(place >= 0).astype(np.int64) + int(ends > 0), base, likelihood + add(inside)]
                none = pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_row"), *map(pa.array, cells), *none], names)
                rare = place[t.word] < 0
                key, times = np.unique(t.row[rare] * max(len(t.keys), 1) + t.word[rare], return_counts=True)
                row, word = key // max(len(t.keys), 1), key % max(len(t.keys), 1)
                empty = [pa.nulls(len(key), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(key), part.schema.field("doc_id").type), part.column("_row").take(pa.array(row)), *empty, t.keys.take(pa.array(word)).cast(pa.string()), pa.array(times)], names)

    fields = T.StructType.fromDDL("_row bigint, n_tokens bigint, n_known bigint, base double, likelihood double, word string, times bigint").fields
    names = ["doc_id", *(f.name for f in fields)]
    both = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))
    both = materialise(both, "markov-rows")
    rare = both.where(F.col("word").isNotNull()).select("_row", "word", "times").join(v.counts.where(F.col("word").isNotNull()), "word", "left")
    c = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("_row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("_more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"))
    joined = both.where(F.col("word").isNull()).join(sums, "_row", "left")
    more = F.coalesce("_more", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("likelihood") + more).alias("score"))
