"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

The script of a word's letters leaves as candidates the languages that are
written in it.  Letter n-grams score the word in those.  A Viterbi path over the
words, which pays for every change of language, labels spans; the language with
the most letters is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.bytehash import buffers, words
from vectorloom.llm.common import chunks, lean_workers

#: Buckets that n-grams are hashed to; a model is languages x BUCKETS numbers.
BUCKETS = 1 << 16
#: A word's score in a language is never below this log posterior.
FLOOR = -9.0
#: Bytes of text whose n-grams a task holds at a time; a task takes about 100 bytes for each.
CHUNK_BYTES = 1 << 19
#: Log score that a change of language costs.
PENALTY = 8.0
UNDETERMINED = "und"
#: A language's least likelihood is so many deviations below the mean of held-out texts; a deviation is LEAST_SPREAD or more.
DEVIATIONS, LEAST_SPREAD = 8.0, 0.25

# First code point of ranges and the script that starts there.
SCRIPTS = (
    (0x0000, ""), (0x0041, "Latin"), (0x0250, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, ""),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"), (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, ""), (0x20000, "Han"), (0x30000, ""),
)
_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
_NAMES = sorted({n for _, n in SCRIPTS if n})
_BITS = np.array([1 << _NAMES.index(n) if n else 0 for _, n in SCRIPTS], dtype=np.int64)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Model(NamedTuple):
    """Languages, log likelihoods of n-gram buckets, scripts each language uses."""

    languages: list[str]
    scores: np.ndarray  # languages x BUCKETS
    scripts: np.ndarray  # bit set per language


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, whether a letter starts there and the bit of its script."""
    letter = _ASCII_LETTER[data]
    script = np.where(letter, _BITS[1], 0)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        a, b, c, d = (wide[lead + i] for i in range(4))
        low = lambda x: x & 63
        cp = np.where(a < 0xE0, (a & 31) << 6 | low(b), np.where(a < 0xF0, (a & 15) << 12 | low(b) << 6 | low(c), (a & 7) << 18 | low(b) << 12 | low(c) << 6 | low(d)))
        kinds, back = np.unique(cp, return_inverse=True)
        is_letter = np.array([chr(k).isalpha() for k in kinds.tolist()], dtype=bool)
        letter[lead] = is_letter[back]
        script[lead] = np.where(letter[lead], _BITS[np.searchsorted(_STARTS, cp, side="right") - 1], 0)
    return letter, script


class Lexicon(NamedTuple):
    """Words of a batch: their rows, and per word which distinct word it is."""

    row: np.ndarray
    first: np.ndarray  # first word of each row
    which: np.ndarray
    letters: np.ndarray  # letters of each word
    scripts: np.ndarray  # per distinct word
    grams: np.ndarray  # buckets of all n-grams of distinct words
    gram_first: np.ndarray  # first n-gram of each distinct word
    row_letters: np.ndarray  # letters of each row


def lexicon(texts: pa.Array) -> Lexicon:
    """Splits texts into words and takes the 2- to 4-byte-grams of the distinct ones."""
    data, at = buffers(pc.utf8_lower(texts))
    w = words(data, at, lower=False)
    letter, script = _letters(data)
    count = np.concatenate([[0], np.cumsum(letter)])
    _, pick, which = np.unique(w.hash, return_index=True, return_inverse=True)
    start, end = w.start[pick], w.end[pick]
    size = end - start + 2  # a space on either side
    off = np.concatenate([[0], np.cumsum(size)])
    many = 3 * size - 6  # n-grams of each distinct word
    gram_first = np.cumsum(many) - many
    kind = np.int32 if many.sum() < 1 << 31 else np.int64
    each = lambda of: np.repeat(of.astype(kind), size)
    at_byte = np.arange(off[-1], dtype=kind)
    source = at_byte + each(start - off[:-1] - 1)
    b, bits = np.zeros(len(at_byte) + 3, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    if len(pick):
        b[:-3] = data.take(source, mode="clip")
        bits = script.take(source, mode="clip")
        for edge in (off[:-1], off[1:] - 1):
            b[edge], bits[edge] = 32, 0
        bits = np.bitwise_or.reduceat(bits, off[:-1])
    h = b[:-3] * np.uint32(0x9E3779B1)
    grams = np.empty(int(many.sum()), dtype=np.int64)
    room = each(off[1:]) - at_byte
    place = at_byte + each(gram_first - off[:-1])
    step = each(size)
    for n in (2, 3, 4):
        h = (h ^ (b[n - 1 : n - 1 + len(h)] + np.uint32(n))) * np.uint32(0x85EBCA6B)
        fits = np.flatnonzero(room >= n)
        grams[place[fits]] = (h ^ h >> np.uint32(15))[fits] >> np.uint32(16)
        place += step - (n - 1)
    return Lexicon(w.row, w.first, which, count[w.end] - count[w.start], bits, grams, gram_first, count[at[1:]] - count[at[:-1]])


def fit(docs: DataFrame) -> Model:
    """Learns a model from text and non-null lang of ``docs``, of every row that has both.

    Tasks count n-grams; what reaches the driver is languages x BUCKETS counts,
    however many documents there are.
    """

    lean_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        used: dict[str, dict[int, int]] = {}
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                lex = lexicon(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                distinct = len(lex.gram_first)
                key, times = np.unique(coded.indices.to_numpy()[lex.row].astype(np.int64) * distinct + lex.which, return_counts=True)
                many = np.diff(np.append(lex.gram_first, len(lex.grams)))
                cuts = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * distinct)
                for i, lang in enumerate(coded.dictionary.to_pylist()):
                    word, n = key[cuts[i] : cuts[i + 1]] - i * distinct, times[cuts[i] : cuts[i + 1]]
                    size = many[word]
                    entry = np.arange(size.sum()) + np.repeat(lex.gram_first[word] - (np.cumsum(size) - size), size)
                    held[lang] = held.get(lang, 0) + np.bincount(lex.grams[entry], weights=np.repeat(n, size), minlength=BUCKETS)
                    tally = used.setdefault(lang, {})
                    kinds, which = np.unique(lex.scripts[word], return_inverse=True)
                    for bits, k in zip(kinds.tolist(), np.bincount(which, weights=n, minlength=len(kinds)).tolist(), strict=True):
                        tally[bits] = tally.get(bits, 0) + int(k)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            names = [lang] * (len(at) + len(used[lang]))
            scripts = list(used[lang])
            keys = np.concatenate([at, -1 - np.array(scripts, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.int64()), pa.array(np.concatenate([counts[at], [used[lang][s] for s in scripts]]), pa.float64())], ["lang", "key", "n"])

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rows = labelled.mapInArrow(count, "lang string, key bigint, n double").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.full((len(languages), BUCKETS), 0.05)
    scripts = np.zeros(len(languages), dtype=np.int64)
    for i, lang in enumerate(languages):
        own = rows[rows["lang"] == lang]
        grams, bits = own[own["key"] >= 0], own[own["key"] < 0]
        counts[i, grams["key"].to_numpy(np.int64)] += grams["n"].to_numpy()
        total = bits["n"].sum()
        for key, n in zip(bits["key"], bits["n"], strict=True):
            if n >= 0.001 * total:  # scripts of a few stray words are not the language's
                scripts[i] |= -1 - int(key)
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), scripts)


def word_scores(model: Model, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every distinct word: log posteriors of the languages, at least FLOOR; log likelihoods per n-gram; whether it has a candidate.

    A language that is not written in the word's script is no candidate; a word
    without letters, or in a script that no language has, tells nothing (0).
    """
    n = len(lex.gram_first)
    if n == 0:
        return np.zeros((0, len(model.languages)), np.float32), np.zeros((0, len(model.languages)), np.float32), np.zeros(0, bool)
    raw = np.stack([np.add.reduceat(s[lex.grams], lex.gram_first) for s in model.scores], axis=1)
    each = raw / np.diff(np.append(lex.gram_first, len(lex.grams)))[:, None]
    fits = (lex.scripts[:, None] & model.scripts[None, :]) != 0
    raw = np.where(fits, raw / 2, -np.inf)  # grams overlap
    some = fits.any(axis=1)
    top = np.where(some, raw.max(axis=1), 0.0)
    odds = np.exp(raw - top[:, None])
    total = odds.sum(axis=1, keepdims=True)
    post = np.log(np.maximum(odds / np.where(total > 0, total, 1), np.exp(FLOOR)))
    return np.where(some[:, None], post, 0.0).astype(np.float32), each, some


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word given scores words x labels and a cost per change.

    ``best`` is the best single label, ``ahead`` a bound on how far any other label
    leads it when a word is reached.  Below minus the penalty every label comes from
    ``best`` there, so a best path passes it.  Between two such words the path leaves
    ``best`` only if another label gains more than two penalties over it, at the ends
    of the text one; only stretches where it may are traced word by word.
    """
    n, k = s.shape
    best = int(s.sum(axis=0, dtype=np.float64).argmax())
    path = np.full(n, best, dtype=np.int64)
    if n == 0 or k == 1:
        return path
    ahead = np.cumsum(np.delete(s, best, axis=1).max(axis=1) - s[:, best], dtype=np.float64)
    ahead[1:] -= np.minimum(np.minimum.accumulate(ahead)[:-1] + penalty, 0.0)
    open_ = ahead > penalty
    open_[-1] |= ahead[-1] >= 0
    if open_.any():
        certain = np.flatnonzero(ahead < -penalty)
        for i in np.unique(np.searchsorted(certain, np.flatnonzero(open_))).tolist():
            a, b = certain[i - 1] if i else 0, certain[i] + 1 if i < len(certain) else n
            path[a:b] = trace(s[a:b], penalty, best if i else None, best if i < len(certain) else None)
    return path


def trace(s: np.ndarray, penalty: float, first: int | None = None, last: int | None = None) -> list[int]:
    """Best label of each word, word by word; the first and the last word's may be given."""
    rows = s.tolist()
    score, came = rows[0], []
    if first is not None:
        score = [0.0 if j == first else -np.inf for j in range(len(score))]
    for row in rows[1:]:
        top = max(score)
        at = score.index(top)
        top -= penalty
        came.append([at if top > x else j for j, x in enumerate(score)])
        score = [(top if top > x else x) + y for x, y in zip(score, row, strict=True)]
    label = score.index(max(score)) if last is None else last
    path = [label]
    for back in reversed(came):
        label = back[label]
        path.append(label)
    return path[::-1]


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Labels documents: doc_id, lang_pred, score, spans (first word, end word, lang), likelihood.

    ``lang_pred`` is the language of most letters over the labelled spans, with
    the first language by name on a tie; ``score`` is the mean posterior of that
    language over the letters of the document, from 0 to 1, where letters of words
    in a script that no language has count 0.  ``likelihood`` is the log likelihood
    per n-gram in that language, as a mean over the words that have a candidate; it
    is null without such a word.  A text that is null,
    empty or without a letter is ``und`` with score 0 and no spans; so is every
    text if nothing was learned.  Whole texts are read.  Repeated rows give
    repeated results, a null doc_id stays null, other columns are ignored and an
    empty table gives an empty result.  ``carry`` names columns to put before the
    result instead of doc_id.
    """
    lean_workers(docs.sparkSession)
    spark = docs.sparkSession
    carried = docs.select(*(carry or ["doc_id"]))
    carried_names = carried.columns
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                yield label(part)

    def label(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        lex = lexicon(part.column("text").fill_null(""))
        scores = None
        if m.languages:
            scores, each, known = (x[lex.which] for x in word_scores(m, lex))
        names, values, spans, likely = [], [], [], []
        for r in range(part.num_rows):
            a, b = lex.first[r], lex.first[r + 1]
            if scores is None or lex.row_letters[r] == 0:
                names.append(UNDETERMINED)
                values.append(0.0)
                spans.append([])
                likely.append(None)
                continue
            s, letters, some = scores[a:b], lex.letters[a:b], known[a:b]
            path = viterbi(s)
            weight = np.bincount(path, weights=letters, minlength=len(m.languages))
            best = int(weight.argmax())
            names.append(m.languages[best])
            values.append(float(min(1.0, (np.exp(s[:, best], dtype=np.float64) * letters * some).sum() / letters.sum())))
            likely.append(float(each[a:b, best][some].mean(dtype=np.float64)) if some.any() else None)
            cuts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [b - a]])
            spans.append([{"start": int(i), "end": int(j), "lang": m.languages[path[i]]} for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in carried_names), pa.array(names, pa.string()), pa.array(values, pa.float64()), pa.array(spans, _SPANS), pa.array(likely, pa.float64())], [*carried_names, "lang_pred", "score", "spans", "likelihood"])

    schema = T.StructType([*carried.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>, likelihood double").fields])
    wanted = carried.columns if "text" in carried.columns else [*carried.columns, "text"]
    return docs.select(*wanted).mapInArrow(run, schema)


def least_likelihoods(named: DataFrame) -> DataFrame:
    """Likelihood that texts of a language have at least: lang, least.

    ``named`` are documents that the model has not seen, as ``identify`` labels
    them, beside their true ``lang``; all that are named rightly count.  A language
    of which none is has no row.
    """
    right = named.where((F.col("lang") == F.col("lang_pred")) & F.col("likelihood").isNotNull())
    spread = F.greatest(F.stddev_pop("likelihood"), F.lit(LEAST_SPREAD))
    return right.groupBy("lang").agg((F.avg("likelihood") - DEVIATIONS * spread).alias("least"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
