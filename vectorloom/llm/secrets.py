"""Secret scan: Aho-Corasick keyword hits, anchored patterns there, checksums last.

One pass of an Aho-Corasick automaton over each text finds where a keyword
stands.  A pattern of that keyword's kind is then matched at that place only,
never searched for.  Long hexadecimal runs have no keyword: they alone are
searched for, by one expression over the text.  Kinds whose tokens embed a checksum (CRC-32 in base 62,
Bech32, Base58Check) are reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vectorloom.llm.common import lean_workers

#: Kinds in the order in which spans at the same place are listed.
KINDS = ("assign", "access", "hex", "crc62", "bech32", "base58")
BASE_KINDS = KINDS[:3]

# Key words, formats and alphabets as their issuers publish them.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CRC62_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
_BECH32_WORDS = ("age-secret-key-1", "nsec1")
_BASE58_WORDS = ("xprv",)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CRC62 = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_BECH = re.compile(r"(?:AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}|nsec1[02-9ac-hj-np-z]{58})(?![0-9A-Za-z])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")


def _crc62_holds(token: str) -> bool:
    body, check, value = token[:-6], token[-6:], 0
    for c in check:
        value = value * 62 + _BASE62.index(c)
    return value == zlib.crc32(body.encode())


def _bech32_holds(token: str) -> bool:
    prefix, _, rest = token.lower().rpartition("1")
    values = [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *(_BECH32.index(c) for c in rest)]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for bit, step in enumerate(_BECH32_STEPS):
            state ^= step if top >> bit & 1 else 0
    return state == 1


def _base58_holds(token: str) -> bool:
    value = 0
    for c in token:
        value = value * 58 + _BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _lower(text: str) -> str:
    """Lower case of the same length, so places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def automaton() -> ahocorasick.Automaton:
    """All keywords with the kind that each starts."""
    a = ahocorasick.Automaton()
    for kind, words in ((0, _ASSIGN_WORDS), (1, ("akia",)), (3, _CRC62_WORDS), (4, _BECH32_WORDS), (5, _BASE58_WORDS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of a text in code points, sorted; kind indexes KINDS."""
    found: list[tuple[int, int, int]] = []
    starts = sorted({(end - size + 1, kind) for end, (kind, size) in words.iter(_lower(text))})
    free = [0] * len(KINDS)  # matches of one kind never overlap
    for at, kind in starts:
        if at < free[kind]:
            continue
        if kind == 0:
            if m := _ASSIGN.match(text, at):
                free[0] = m.end()
                if len(m[2]) >= 6:
                    found.append((at, 0, m.end()))
        elif kind == 1:
            if m := _ACCESS.match(text, at):
                free[1] = m.end()
                if m.end() - at >= 20:
                    found.append((at, 1, m.end()))
        elif kind == 3:
            if (m := _CRC62.match(text, at)) and _crc62_holds(m[1]):
                free[3] = m.end()
                found.append((at, 3, m.end()))
        elif kind == 4:
            if (m := _BECH.match(text, at)) and _bech32_holds(m[0]):
                free[4] = m.end()
                found.append((at, 4, m.end()))
        elif (m := _XPRV.match(text, at)) and _base58_holds(m[0]):
            free[5] = m.end()
            found.append((at, 5, m.end()))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end).

    Places are code points, the end is exclusive.  Kinds: ``assign`` (a key word
    set to a value), ``access`` (key ids), ``hex`` (long hexadecimal runs), and
    with a checksum that holds ``crc62``, ``bech32`` and ``base58``.

    A null or empty text has no spans.  Repeated rows give repeated results, a
    null doc_id stays null, other columns are ignored, and an empty table gives
    an empty result.  Texts are scanned whole, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, words)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    lean_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
