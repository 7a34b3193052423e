"""Cross-tokenizer alignment: token-byte incidence matrices and their products.

Two tokenizers cut the same bytes.  Each cut is an incidence matrix of tokens and
bytes in compressed rows; the product A·Bᵀ, row by row, links tokens whose bytes
overlap.  Runs of overlapping tokens are groups, which end where both cuts end; the
product of the group incidences links all tokens of a group.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.bytehash import Prefix, buffers
from vectorloom.llm.common import chunks, lean_workers, materialise

#: Distinct id pairs up to which their counts are broadcast (16 bytes each); beyond, links join them by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Bytes of text whose alignment a task holds at a time.
CHUNK_BYTES = 1 << 21
#: Products are taken in blocks of rows that expand to so many entries.
BLOCK = 1 << 22
#: Words, and bytes of words, beyond which a Python worker forgets those it has aligned.
KNOWN_WORDS, KNOWN_BYTES = 1 << 19, 1 << 25
#: Pattern that a byte-level tokenizer splits text by before it merges (a fixed value of its files).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"


# --- compressed rows ---


class Rows(NamedTuple):
    """A sparse matrix in compressed rows: row i has the columns ``cols[at[i]:at[i + 1]]`` with ``values``."""

    at: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] … start[0] + length[0] - 1, then the same of the next, as one array."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def product(a: Rows, b: Rows, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a times b as (row, column, value), by Gustavson's scheme: row i is the sum of b's rows that a's row i names.

    Comes in blocks of whole rows that expand to about ``block`` entries before equal
    columns are added up.
    """
    wide = b.at[a.cols + 1] - b.at[a.cols]
    grown = np.concatenate([[0], np.cumsum(wide)])[a.at]
    first = 0
    while first < len(a.at) - 1:
        last = max(first + 1, int(np.searchsorted(grown, grown[first] + block, side="right")) - 1)
        lo, hi = a.at[first], a.at[last]
        size = wide[lo:hi]
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(a.at[first : last + 1])), size)
        at = ragged(b.at[a.cols[lo:hi]], size)
        cols, values = b.cols[at], np.repeat(a.values[lo:hi], size) * b.values[at]
        if len(rows):
            key = rows * b.width + cols
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, rows, cols, values = key[order], rows[order], cols[order], values[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield rows[new], cols[new], np.add.reduceat(values, new)
        first = last


def incidence(lengths: np.ndarray) -> Rows:
    """Tokens x bytes: each token's run of bytes."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(at, np.arange(at[-1]), np.ones(at[-1], np.int64), int(at[-1]))


def by_byte(lengths: np.ndarray) -> Rows:
    """The same transposed, bytes x tokens: every byte names its token."""
    n = int(lengths.sum())
    return Rows(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64), len(lengths))


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of tokens that share bytes, and how many: (token of a, token of b, bytes); a and b are token lengths."""
    parts = list(product(incidence(a), by_byte(b)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none)


def groups_of(row: np.ndarray, col: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token of a and of b: tokens that overlap links join are in one group."""
    first = np.flatnonzero(np.diff(row, prepend=-1))  # every token has a byte, so every row has a link
    last = np.append(first[1:], len(row)) - 1
    new = np.ones(n_a, bool)
    new[1:] = col[first[1:]] != col[last[:-1]]  # both cuts end here
    a = np.cumsum(new) - 1
    b = np.zeros(n_b, np.int64)
    b[col] = a[row]
    return a, b


def group_links(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a token of a and a token of b of one group; a and b are group numbers in order."""
    n = int(a[-1]) + 1 if len(a) else 0
    left = Rows(np.arange(len(a) + 1), a, np.ones(len(a), np.int64), n)
    right = Rows(np.searchsorted(b, np.arange(n + 1)), np.arange(len(b)), np.ones(len(b), np.int64), len(b))
    for row, col, _ in product(left, right, block):
        yield row, col


# --- tokenizers ---


class Cut(NamedTuple):
    """Tokens of a list of texts: ids of all, tokens of each text."""

    ids: np.ndarray
    sizes: np.ndarray


class Tokenizer(NamedTuple):
    """encode(texts) cuts texts that begin with a space; ``bytes_`` of id i are ``data[at[i]:at[i + 1]]``.

    ``by_word``: a cut at a space that follows a character that is not white
    changes no token, so distinct words can be cut once.
    """

    encode: Callable[[list[str]], Cut]
    data: np.ndarray
    at: np.ndarray
    by_word: bool


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)


def _flat(lists: list[list[int]]) -> Cut:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return Cut(np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes)


def _byte_letters() -> dict[str, int]:
    """Byte-level files write bytes that are no printable Latin-1 characters as code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_level(raw: bytes) -> Tokenizer:
    """A byte-level BPE from its JSON file; strings of special tokens are plain text.

    Where the file is of the plain kind (merges in order of ids, no normalizer, the
    usual split) its ranks run in tiktoken, which gives the same tokens faster.
    """
    spec = json.loads(raw)
    model, letters = spec["model"], _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens") or []}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    plain = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    tokens = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1)
    for t, i in plain.items():
        tokens[i] = t
    joined = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    in_order = all(a < b for a, b in zip(joined, joined[1:], strict=False)) and len(joined) + 256 == len(plain) == max(plain.values()) + 1
    if usual and in_order and not model.get("ignore_merges"):
        import tiktoken

        ranks = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=plain, special_tokens={})
        data, at = _table(tokens)

        def encode(texts: list[str]) -> Cut:
            """Texts that end in a letter or mark can be cut in one go; the space of the next begins a token."""
            raw = pa.array(texts, pa.large_string())
            letters, begin = buffers(raw)
            last = letters[np.maximum(begin[1:] - 1, 0)] if len(letters) else np.zeros(len(texts), np.uint8)
            alone = (last <= 0x20) | (begin[1:] == begin[:-1])
            for i in np.flatnonzero(last >= 0x80).tolist():
                alone[i] = texts[i][-1].isspace()
            if alone.any():
                together = [t for t, x in zip(texts, alone.tolist(), strict=True) if not x]
            else:
                together = texts
            ids = np.array(ranks.encode_ordinary("".join(together)), np.int64)
            ends, wanted = np.cumsum(at[ids + 1] - at[ids]), np.cumsum(np.diff(begin)[~alone])
            upto = np.searchsorted(ends, wanted, side="right")
            if len(together) and not np.array_equal(np.concatenate([[0], ends])[upto], wanted):
                return _flat([ranks.encode_ordinary(t) for t in texts])
            sizes = np.zeros(len(texts), np.int64)
            sizes[~alone] = np.diff(upto, prepend=0)
            rest = _flat([ranks.encode_ordinary(t) for t, x in zip(texts, alone.tolist(), strict=True) if x])
            sizes[alone] = rest.sizes
            all_ids = np.empty(int(sizes.sum()), np.int64)
            of = np.repeat(alone, sizes)
            all_ids[~of], all_ids[of] = ids, rest.ids
            return Cut(all_ids, sizes)

        return Tokenizer(encode, data, at, True)
    import tokenizers

    whole = tokenizers.Tokenizer.from_str(raw.decode())
    whole.encode_special_tokens = True
    return Tokenizer(lambda texts: _flat([e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]), *_table(tokens), False)


@lru_cache(maxsize=4)
def pieces(raw: bytes) -> Tokenizer:
    """A piece model with byte fallback; it adds the first space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    probe = "  aﬁ  ｆ\té\n "
    same = hasattr(model, "normalize") and model.normalize(probe) == (" " + probe).replace(" ", MARK)
    split = same and not any(MARK in p.lstrip(MARK) for p in names)
    return Tokenizer(lambda texts: _flat(model.encode([t[1:] for t in texts], num_threads=1)), *_table(tokens), split)


#: Kinds of files that align() reads.
READERS = {"byte_level": byte_level, "pieces": pieces}


# --- words of a batch ---


class Lexicon(NamedTuple):
    """Distinct words with their alignment."""

    words: pa.Array
    good: np.ndarray  # joined tokens of both sides are the word's bytes; else all counts are 0
    counts: np.ndarray  # words x (tokens of a, tokens of b, groups, overlap links)
    first: np.ndarray  # first linked id pair of each word, and the total
    pair: np.ndarray
    times: np.ndarray  # how often the word links the pair
    groups: pa.Array  # ids of a, a bar, ids of b, with semicolons between groups

    def take(self, at: np.ndarray) -> Lexicon:
        size = self.first[at + 1] - self.first[at]
        pairs, where = ragged(self.first[at], size), pa.array(at)
        return Lexicon(self.words.take(where), self.good[at], self.counts[at], np.concatenate([[0], np.cumsum(size)]), self.pair[pairs], self.times[pairs], self.groups.take(where))

    def plus(self, other: Lexicon) -> Lexicon:
        join = lambda x, y: pa.concat_arrays([x, y])
        both = [np.concatenate([x, y]) for x, y in ((self.good, other.good), (self.counts, other.counts), (self.first[:-1], other.first + self.first[-1]), (self.pair, other.pair), (self.times, other.times))]
        return Lexicon(join(self.words, other.words), *both, join(self.groups, other.groups))


class Aligned(NamedTuple):
    """A batch of texts as words of a lexicon."""

    row: np.ndarray  # of every word in the batch, ascending
    word: np.ndarray  # its place in the lexicon
    bad: np.ndarray  # per row: joined tokens differ from the text, or there is none
    lexicon: Lexicon


def _segments(texts: pa.Array, split: bool) -> tuple[pa.Array, np.ndarray]:
    """Every text with a space before it, cut into words if that changes no token; and the row of each word."""
    full = pc.binary_join_element_wise(pa.scalar(""), texts.fill_null(""), pa.scalar(" "))
    full = pc.if_else(pc.equal(pc.binary_length(texts.fill_null("")), 0), pa.scalar(""), full).cast(pa.string())
    data, at = buffers(full)
    start = np.zeros(len(data) + 1, bool)
    start[at] = True
    if split and len(data) > 4:
        lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # white characters of two and three bytes begin with these
        after = np.ones(len(data), bool)
        after[0] = False
        after[1:] = (data[:-1] > 0x20) & (data[:-1] != 0x7F)
        after[2:] &= ~lead[:-2]
        after[3:] &= ~(lead[:-3] & (data[:-3] != 0xC2))
        start[:-1] |= (data == 0x20) & after
        start[at[1:][np.diff(at) > 0] - 1] = False  # a piece model can't be told to cut a space alone
    start[-1] = False
    begin = np.flatnonzero(start)
    offsets = np.concatenate([begin, [len(data)]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(at, begin, side="right") - 1


def _bytes_agree(cut: Cut, t: Tokenizer, data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Per text, whether its tokens' bytes, joined, are its bytes."""
    size = (t.at[cut.ids + 1] - t.at[cut.ids]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(cut.sizes)])
    ends = np.concatenate([[0], np.cumsum(size)])
    total = ends[first[1:]] - ends[first[:-1]]
    good = (total == length) & (total > 0)
    begin = np.concatenate([[0], np.cumsum(length)])[:-1]
    kept = np.repeat(good, cut.sizes)
    own = t.data[ragged(t.at[cut.ids[kept]], size[kept])]
    wanted = data[ragged(begin[good], length[good])]
    off = np.cumsum(np.concatenate([[0], own != wanted]))
    at = np.concatenate([[0], np.cumsum(length[good])])
    good[np.flatnonzero(good)] = off[at[1:]] == off[at[:-1]]
    return good


def align_words(words: pa.Array, left: Tokenizer, right: Tokenizer, written: bool = True) -> Lexicon:
    """Aligns distinct words: overlap product, groups from it, then the products of the groups; groups as text if wanted."""
    strings = words.to_pylist()
    data, at = buffers(words)
    length = np.diff(at)
    a, b = left.encode(strings), right.encode(strings)
    good = _bytes_agree(a, left, data, length) & _bytes_agree(b, right, data, length)
    keep = lambda c: Cut(c.ids[np.repeat(good, c.sizes)], np.where(good, c.sizes, 0))
    a, b = keep(a), keep(b)
    x, y, _ = overlaps(left.at[a.ids + 1] - left.at[a.ids], right.at[b.ids + 1] - right.at[b.ids])
    group_a, group_b = groups_of(x, y, len(a.ids), len(b.ids))
    n, owner = len(strings), np.repeat(np.arange(len(strings)), a.sizes)
    new = np.flatnonzero(np.diff(group_a, prepend=-1))
    counts = np.stack([a.sizes, b.sizes, np.bincount(owner[new], minlength=n), np.bincount(owner[x], minlength=n)], axis=1)
    return Lexicon(words, good, counts, *word_pairs(a, b, group_a, group_b, right.at.size - 1), written_groups(a, b, group_a, group_b) if written else pa.nulls(n, pa.large_string()))


class Memory:
    """The words that a Python worker has aligned, for its later batches; a bounded number of them.

    Words are found by a hash, in order, and then compared.
    """

    def __init__(self, written: bool = True) -> None:
        none = np.zeros(0, np.int64)
        self.written = written
        self.known = Lexicon(pa.array([], pa.large_string()), np.zeros(0, bool), np.zeros((0, 4), np.int64), np.zeros(1, np.int64), none, none, pa.array([], pa.large_string()))
        self.hashes, self.places = np.zeros(0, np.uint64), none

    def align(self, words: pa.Array, left: Tokenizer, right: Tokenizer) -> Lexicon:
        """The words' alignment in their order; only new ones are aligned."""
        data, begin = buffers(words)
        h, n = Prefix(data).slices(begin[:-1], begin[1:]), len(self.known.words)
        at = np.full(len(words), -1, np.int64)
        if n:
            near = self.places[np.minimum(np.searchsorted(self.hashes, h), n - 1)]
            at = np.where(pc.equal(words, self.known.words.take(pa.array(near))).to_numpy(zero_copy_only=False), near, -1)
        new = np.flatnonzero(at < 0)
        at[new] = n + np.arange(len(new))
        self.known = self.known.plus(align_words(words.take(pa.array(new)), left, right, self.written))
        own = self.known.take(at)
        if len(self.known.words) > KNOWN_WORDS or self.known.words.nbytes > KNOWN_BYTES:
            self.known, self.places = own, np.argsort(h, kind="stable")  # words of the last batch come soonest again
            self.hashes = h[self.places]
        else:
            order = np.argsort(h[new], kind="stable")
            slot = np.searchsorted(self.hashes, h[new][order])
            self.hashes, self.places = np.insert(self.hashes, slot, h[new][order]), np.insert(self.places, slot, at[new][order])
        return own


@lru_cache(maxsize=1)
def memory(left: bytes, right: bytes, written: bool) -> Memory:
    return Memory(written)


def align_batch(texts: pa.Array, left: Tokenizer, right: Tokenizer, known: Memory) -> Aligned:
    """A batch of texts as words, aligned."""
    words, row = _segments(texts, left.by_word and right.by_word)
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    held = known.align(coded.dictionary, left, right)
    bad = np.ones(len(texts), bool)
    bad[row] = False
    bad[row[~held.good[word]]] = True
    return Aligned(row, word, bad, held)


def word_pairs(a: Cut, b: Cut, group_a: np.ndarray, group_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked id pairs of every word: (first pair of each word, pair, how often)."""
    owner, kinds = np.repeat(np.arange(len(a.sizes)), a.sizes), int(a.ids.max(initial=0) + 1) * width
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x, y in group_links(group_a, group_b):
        new, often = np.unique(owner[x] * kinds + a.ids[x] * width + b.ids[y], return_counts=True)
        if len(keys):
            new, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            often = np.bincount(back, weights=np.concatenate([times, often])).astype(np.int64)
        keys, times = new, often
    return np.searchsorted(keys, np.arange(len(a.sizes) + 1) * kinds), keys % max(kinds, 1), times


def row_words(w: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of every row that has tokens: (row, word, how often)."""
    use, n = ~w.bad[w.row], max(len(w.lexicon.good), 1)
    seen, often = np.unique(w.row[use] * n + w.word[use], return_counts=True)
    return seen // n, seen % n, often


def row_pairs(w: Aligned, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked id pairs of every row that has tokens: (row, pair, how often), each once; pairs are below ``kinds``."""
    row, word, often = row_words(w)
    size = w.lexicon.first[word + 1] - w.lexicon.first[word]
    at = ragged(w.lexicon.first[word], size)
    kept, back = np.unique(np.repeat(row, size) * kinds + w.lexicon.pair[at], return_inverse=True)
    total = np.bincount(back, weights=w.lexicon.times[at] * np.repeat(often, size), minlength=len(kept)).astype(np.int64)
    return kept // kinds, kept % kinds, total


def pair_counts(w: Aligned, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows every id pair is linked: (pair, rows)."""
    row, word, _ = row_words(w)
    size = w.lexicon.first[word + 1] - w.lexicon.first[word]
    cells = np.repeat(row, size) * kinds + w.lexicon.pair[ragged(w.lexicon.first[word], size)]
    cells.sort()
    return np.unique(cells[np.flatnonzero(np.diff(cells, prepend=-1))] % kinds, return_counts=True)


def written_groups(a: Cut, b: Cut, group_a: np.ndarray, group_b: np.ndarray) -> pa.Array:
    """Every word's groups as text: ids of a, a bar, ids of b, with semicolons between groups."""
    n_a, n_b = len(a.ids), len(b.ids)
    groups = int(group_a[-1]) + 1 if n_a else 0
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=groups)), np.bincount(group_b, minlength=groups)
    place = np.concatenate([np.arange(n_a) + (np.cumsum(upto_b) - upto_b)[group_a], np.arange(n_b) + upto_a[group_b]])
    ids = np.empty(n_a + n_b, np.int64)
    ids[place] = np.concatenate([a.ids, b.ids])
    side = np.empty_like(ids)
    side[place] = np.repeat([0, 1], [n_a, n_b])
    after = np.full(len(ids), ord(","), np.uint8)
    after[:-1][side[1:] > side[:-1]] = ord("|")
    after[:-1][side[1:] < side[:-1]] = ord(";")
    digits = np.ones(len(ids), np.int64)
    for power in range(1, len(str(int(ids.max(initial=0))))):
        digits += ids >= 10**power
    end = np.cumsum(digits + 1)
    text = np.empty(end[-1] if len(end) else 0, np.uint8)
    text[end - 1] = after
    left = ids.copy()
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        text[end[has] - 2 - k] = left[has] % 10 + ord("0")
        left //= 10
    first = np.concatenate([[0], np.cumsum(a.sizes + b.sizes)])
    offsets = np.concatenate([[0], end])[first]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    keep = np.ones(len(text), bool)
    keep[last] = False  # no mark after a word's last token
    shift = np.concatenate([[0], np.cumsum(~keep)])
    return pa.LargeStringArray.from_buffers(len(a.sizes), pa.py_buffer(offsets - shift[offsets]), pa.py_buffer(text[keep]))


# --- documents ---

COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


def align(docs: DataFrame, left: tuple[str, bytes], right: tuple[str, bytes], broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Aligns both tokenizers' cuts of every text: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups, n_best, count_sum.

    ``left`` and ``right`` are a kind of READERS and the bytes of a tokenizer file.
    The first cuts a space and the text, the second the text, to which it adds the
    space itself.  ``groups`` writes the ids of every group, ``a1,a2|b1;a3|b2``.
    ``n_overlaps`` counts links of tokens that share bytes, ``n_links`` links of
    tokens of one group.  The count of an id pair is the number of rows of ``docs``
    that hold it linked: ``count_sum`` adds it up over a text's links, and
    ``n_best`` counts links whose count is the highest of their left id.

    A text that is null, empty, or not given back by the bytes of its tokens has
    zeros and empty groups.  Whole texts are read.  Every row is a document, also
    when ids or rows repeat; a null doc_id stays null; other columns are ignored;
    an empty table gives an empty result.

    Texts are cut twice, for the counts and for the result, which is cheaper than
    to keep all tokens: tokens and groups never cross a word's end, so a task cuts
    the distinct words of a batch only.  Counts of up to ``broadcast_pairs`` pairs
    are broadcast; more are joined with the links of every row by a shuffle.
    """
    spark = docs.sparkSession
    lean_workers(spark)
    files = spark.sparkContext.broadcast((left, right))  # two vocabulary files
    width = READERS[right[0]](right[1]).at.size - 1
    kinds = (READERS[left[0]](left[1]).at.size - 1) * width

    def load(written: bool) -> tuple[Tokenizer, Tokenizer, Memory]:
        (first, a), (second, b) = files.value
        return READERS[first](a), READERS[second](b), memory(a, b, written)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                w = align_batch(part.column("text"), *load(False))
                held.append(pair_counts(w, kinds))
                size += len(held[-1][0])
                if size > BLOCK:
                    held = [added()]
                    size = len(held[0][0])
                    if size > BLOCK // 2:  # as many different pairs: the shuffle adds them up
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "n"])
                        held, size = [], 0
        if held:
            pairs, n = added()
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    found = docs.select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialise(found, "align-pairs")
    if pairs.count() <= broadcast_pairs:
        table = pairs.toPandas().sort_values("pair")
        known = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64)))  # at most broadcast_pairs rows
        return _scored(docs, load, width, kinds, known).drop("_row", "_pairs")
    rows = materialise(_scored(docs.withColumn("_row", F.monotonically_increasing_id()), load, width, kinds, None), "align-rows")
    best = pairs.withColumn("a", F.floor(F.col("pair") / width)).groupBy("a").agg(F.max("n").alias("top"))  # one row per id of the left vocabulary
    links = rows.select("_row", F.explode("_pairs").alias("p")).select("_row", "p.pair", "p.times").join(pairs, "pair")
    marked = links.join(F.broadcast(best), F.floor(F.col("pair") / width) == F.col("a"))
    sums = marked.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    joined = rows.drop("_pairs", "n_best", "count_sum").join(sums, "_row", "left")
    return joined.select("doc_id", *COUNTS, "groups", F.coalesce("_best", F.lit(0)).cast("bigint").alias("n_best"), F.coalesce("_sum", F.lit(0)).cast("bigint").alias("count_sum"))


def _scored(docs: DataFrame, load: Callable[[bool], tuple[Tokenizer, Tokenizer, Memory]], width: int, kinds: int, known) -> DataFrame:
    """Rows with their counts and groups; sums over pair counts if they are known, else the rows' pairs."""
    keyed = docs if "_row" in docs.columns and known is None else docs.withColumn("_row", F.lit(None).cast("bigint"))
    fields = T.StructType.fromDDL("_row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups string, n_best bigint, count_sum bigint, _pairs array<struct<pair: bigint, times: bigint>>")

    def sums(w: Aligned, per_word: np.ndarray) -> pa.Array:
        use = ~w.bad[w.row]
        total = np.zeros(len(w.bad), np.int64)
        np.add.at(total, w.row[use], per_word[w.word[use]])
        return pa.array(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        if known is not None:
            pairs, n = known.value
            best = np.zeros(int(pairs[-1] // width) + 1 if len(pairs) else 1, np.int64)
            np.maximum.at(best, pairs // width, n)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                w = align_batch(part.column("text"), *load(True))
                x = w.lexicon
                owner = np.repeat(np.arange(len(x.good)), np.diff(x.first))
                add = lambda v, owner=owner, x=x: np.bincount(owner, weights=v, minlength=len(x.good)).astype(np.int64)
                cells = [sums(w, v) for v in (*x.counts.T[:3], add(x.times), x.counts[:, 3])]
                texts = x.groups.take(pa.array(w.word[~w.bad[w.row]]))
                lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(w.row[~w.bad[w.row]], np.arange(len(w.bad) + 1))), texts)
                groups = pc.binary_join(lists, pa.scalar(";", pa.large_string())).cast(pa.string())
                if best is not None:
                    each = n[np.searchsorted(pairs, x.pair)]
                    scores = [sums(w, add(x.times * (each == best[x.pair // width]))), sums(w, add(x.times * each))]
                    held = pa.nulls(len(w.bad), _PAIRS)
                else:
                    scores = [pa.nulls(len(w.bad), pa.int64())] * 2
                    row, pair, often = row_pairs(w, kinds)
                    held = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(w.bad) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(pair), pa.array(often)], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_row"), *cells, groups, *scores, held], ["doc_id", *fields.names])

    return keyed.select("doc_id", "_row", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields.fields]))


_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))


def read_file(path: str) -> bytes:
    """A tokenizer file, read on the driver; its bytes travel with the job."""
    with open(path, "rb") as file:
        return file.read()
