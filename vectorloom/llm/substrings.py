"""Exact removal of repeated substrings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``width`` bytes, by most-significant-digit
passes; suffixes that are equal through all of them start a repeated window.
Every pass drops suffixes that are alone with their digit.

First digit.  Of a window's ``width - GRAM + 1`` overlapping byte grams, the one of
least hash, at whatever place in the window it stands, so suffixes side by side
share one and a digit is sent once for all of them: a stretch.  Digits that a batch
sees in many different stretches repeat for certain; their stretches are dealt by
themselves, so no task gathers them.

Second digit.  The whole stretch of text under all windows of that digit.  Equal
stretches repeat as a whole, and one of them goes on for the others.  Stretches
that are equal inside one batch are combined before anything is sent.

Third digit.  Only where stretches differ: a stretch is cut into runs of RUN windows
by their distance from the gram, and the bytes that all windows of such a run
share are the digit.

Last digits.  The windows' own bytes, eight at a time, from their first to their
last.  Where very many runs share the third digit, what is left of a window beside
it (RUN - 1 bytes) is one digit, counted by a grouped sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.bytehash import Prefix, buffers, mix
from vectorloom.llm.common import chunks, lean_workers, materialise, semi

#: Bytes of a gram of the first digit.
GRAM = 64
#: Bytes of text whose digits make up one fragment.
FRAGMENT_BYTES = 12 << 20
#: Places that a text may have before its digits are taken piece by piece.
PIECE = 1 << 20
#: Windows of one run of the third digit.
RUN = 32
#: Different stretches of a digit in one batch from which on they are dealt by themselves.
SPREAD = 16
#: Runs of a third digit up to which one task orders them.
MANY = 1 << 14
#: Bytes of runs that one task orders.
RUN_BYTES = 8 << 20

_PLACE_BITS = np.uint64(21)
_FIRST = np.dtype([("digit", "<u8"), ("stretch", "<u8"), ("row", "<i8"), ("start", "<i4"), ("span", "u1"), ("back", "u1"), ("many", "u1"), ("kind", "u1")])
#: Kinds of first digits: stretches, stretches dealt by themselves, and the mark of their digit.
_PLAIN, _ALONE, _MARK = range(3)
_DONE = np.dtype([("row", "<i8"), ("start", "<i4"), ("end", "<i4")])
_STRETCH = np.dtype([("start", "<i4"), ("span", "u1"), ("back", "u1"), ("open", "u1")])
_RUN = np.dtype([("start", "<i4"), ("end", "<i4")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minima over ``width`` values."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def first_digits(data: np.ndarray, row: int, width: int) -> np.ndarray:
    """Stretches of windows of one text with their digits, as records _FIRST.

    ``start`` is the first window, ``span`` how many follow, and ``back`` how far
    behind the first window the gram of the digit lies.
    """
    out = []
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    for base in range(0, max(len(data) - width + 1, 0), PIECE):
        part = data[base : base + PIECE + width - 1]
        prefix = Prefix(part)
        grams = prefix.windows(GRAM)
        place = (_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - GRAM + 1) & low).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        start = np.concatenate([[0], cut])
        end = np.concatenate([cut, [len(place)]]) - 1
        at = place[start]
        r = np.zeros(len(start), _FIRST)
        r["digit"], r["row"], r["start"], r["span"], r["back"] = grams[at], row, start + base, end - start, at - start
        r["stretch"] = prefix.slices(start, end + width) ^ mix((at - start).astype(np.uint64))
        out.append(r)
    return np.concatenate(out) if out else np.zeros(0, _FIRST)


def combine(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines equal stretches before they are sent: what to send, and runs known to repeat.

    Stretches that occur twice or more among the records repeat whatever others
    hold; one of them is sent, marked, for the others.  Their windows become runs
    of records _DONE, joined where they touch, so repetitive text stays small and
    no digit of it crowds a fragment.  Digits with SPREAD stretches or more send a
    mark to the digit's own fragment, where other batches' stretches meet it.
    """
    r = r[np.lexsort((r["start"], r["row"], r["stretch"], r["digit"]))]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["stretch"][1:] != r["stretch"][:-1]) | (r["digit"][1:] != r["digit"][:-1])
    size = np.bincount(np.cumsum(new) - 1, minlength=0)
    many = np.repeat(size > 1, size) if len(r) else np.zeros(0, bool)
    send = r[new]
    send["many"] = many[new]
    fresh = np.ones(len(send), dtype=bool)
    fresh[1:] = send["digit"][1:] != send["digit"][:-1]
    crowd = np.bincount(np.cumsum(fresh) - 1, minlength=0)
    alone = np.repeat(crowd >= SPREAD, crowd) if len(send) else np.zeros(0, bool)
    send["kind"][alone] = _ALONE
    marks = send[alone & fresh]
    marks["kind"] = _MARK
    return np.concatenate([send, marks]), _runs(r[many]["row"], r[many]["start"].astype(np.int64), r[many]["start"].astype(np.int64) + r[many]["span"])


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs of windows of each row, joined where they touch."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1] + 1)
    at = np.flatnonzero(new)
    out = np.zeros(len(at), _DONE)
    out["row"], out["start"] = row[at], start[at]
    if len(at):
        out["end"] = np.maximum.reduceat(end, at)
    return out


def fragment_of(r: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments of records; digits are least hashes, so they are mixed again to spread evenly."""
    return (mix(np.where(r["kind"] == _ALONE, r["digit"] ^ mix(r["stretch"]), r["digit"])) >> np.uint64(32)).astype(np.int64) * fragments >> 32


def _fragments(records: np.ndarray, done: np.ndarray, fragments: int) -> pa.RecordBatch:
    """Cuts records by their first digit, one row per fragment; runs go by their text."""
    frags, kinds, data = [], [], []
    for kind, part, frag in ((0, records, fragment_of(records, fragments)), (1, done, done["row"] % fragments)):
        order = np.argsort(frag, kind="stable")
        part, frag = part[order], frag[order]
        cuts = np.concatenate([[0], np.flatnonzero(frag[1:] != frag[:-1]) + 1, [len(frag)]]) if len(frag) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            frags.append(int(frag[a]))
            kinds.append(kind)
            data.append(part[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(frags, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["frag", "kind", "data"])


def _by_row(rows: np.ndarray, cells: np.ndarray) -> list[tuple[int, bytes]]:
    """Cells of records grouped by the text they belong to."""
    order = np.argsort(rows, kind="stable")
    rows, cells = rows[order], cells[order]
    cuts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
    return [(int(rows[a]), cells[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _table(cells: list[tuple[int, bytes]], runs: list[tuple[int, bytes]]) -> pa.Table:
    n, m = len(cells), len(runs)
    return pa.table({
        "row": pa.array([r for r, _ in cells] + [r for r, _ in runs], pa.int64()),
        "cells": pa.array([c for _, c in cells] + [None] * m, pa.binary()),
        "runs": pa.array([None] * n + [c for _, c in runs], pa.binary()),
    })


def _more(row: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows found to repeat, as cells of runs: row, more."""
    pieces = _run_cells(_runs(row, start, start))
    return pa.table({"row": pa.array([r for r, _ in pieces], pa.int64()), "more": pa.array([c for _, c in pieces], pa.binary())})


def _run_cells(done: np.ndarray) -> list[tuple[int, bytes]]:
    runs = np.zeros(len(done), _RUN)
    runs["start"], runs["end"] = done["start"], done["end"]
    return _by_row(done["row"], runs)


def split_digits(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches whose first digit repeats, and which of them go on to the third digit.

    Returns the kept records and for each 0 (the stretch repeats as a whole), 1 (it
    doesn't; its windows must be looked at) or 2 (it repeats, and stands for all
    its copies where other stretches of the digit are looked at).
    """
    r = r[np.lexsort((r["stretch"], r["digit"]))]
    new = np.ones(len(r), dtype=bool)
    new[1:] = r["digit"][1:] != r["digit"][:-1]
    group = np.cumsum(new) - 1
    crowded = np.zeros(int(group.max(initial=-1)) + 1, dtype=bool)  # has stretches in other fragments
    crowded[group[r["kind"] != _PLAIN]] = True
    real = r["kind"] != _MARK
    size = np.bincount(group, weights=real * (1.0 + r["many"]))
    kept = real & ((size > 1) | crowded)[group] if len(r) else real
    r, group = r[kept], group[kept]
    fresh = np.ones(len(r), dtype=bool)
    fresh[1:] = (r["stretch"][1:] != r["stretch"][:-1]) | (group[1:] != group[:-1])
    kind = np.cumsum(fresh) - 1
    copies = np.bincount(kind, weights=1.0 + r["many"])[kind] if len(r) else np.zeros(0)
    lone = copies == 1
    looked = crowded.copy()
    looked[group[lone]] = True
    state = np.where(lone, 1, np.where(fresh & looked[group], 2, 0)).astype(np.uint8) if len(r) else np.zeros(0, np.uint8)
    return r, state


def cut_runs(data: np.ndarray, cells: np.ndarray, width: int) -> list[tuple[int, int, int, int, int, bytes]]:
    """Runs of a text's stretches: third digit, first window, windows, distance of the first from the gram, state, bytes."""
    whole = Prefix(data)
    out = []
    for start, span, back, state in zip(*(cells[c].astype(np.int64).tolist() for c in ("start", "span", "back", "open")), strict=True):
        gram = start + back
        far = back
        while far >= back - span:
            near = max(far // RUN * RUN, back - span)  # windows from far to near from the gram
            first = gram - far // RUN * RUN  # every window of the run has the bytes from here on
            digit = whole.slices(np.array([first]), np.array([first + width - RUN + 1])) ^ mix(np.array([far // RUN], np.uint64))
            at, n = gram - far, far - near + 1
            out.append((int(digit.view(np.int64)[0]), at, n, far, state, data[at : at + n - 1 + width].tobytes()))
            far = near - 1
    return out


def equal_windows(group: np.ndarray, place: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``data`` are equal to another of their group, byte by byte.

    Most-significant-digit passes over eight bytes each; windows alone with their
    digits drop out.  Only groups in which a digit differs are sorted again.
    """
    eight = np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))
    live = np.argsort(group, kind="stable")
    group = group[live]
    for depth in [*range(0, width - 7, 8), width - 8]:
        new = np.ones(len(live), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group, minlength=0)
        keep = size[group] > 1 if len(live) else np.zeros(0, bool)
        live, group = live[keep], group[keep]
        if not len(live):
            break
        digit = eight[place[live] + depth]
        differs = np.zeros(len(size), dtype=bool)
        inside = group[1:] == group[:-1]
        differs[group[1:][inside & (digit[1:] != digit[:-1])]] = True
        at = np.flatnonzero(differs[group])
        order = at[np.lexsort((digit[at], group[at]))]
        live[at], digit[at] = live[order], digit[order]  # groups lie together, so they keep their places
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]))
    new = np.ones(len(live), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    size = np.bincount(np.cumsum(new) - 1, minlength=0)
    out = np.zeros(len(place), dtype=bool)
    out[live[np.repeat(size > 1, size)] if len(live) else live] = True
    return out


def cover(runs: np.ndarray, width: int) -> np.ndarray:
    """Maximal byte spans covered by windows that start in the runs (start, end inclusive)."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    runs = np.sort(runs, order="start")
    begin, end = runs["start"].astype(np.int64), np.maximum.accumulate(runs["end"].astype(np.int64) + width)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([begin[at], np.append(end[at[1:] - 1], end[-1])], axis=1)


def remove_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """Removes every byte covered by a ``width``-byte string that also starts elsewhere.

    Returns per row: doc_id, kept (the remaining bytes, null where nothing is
    removed), n_bytes, n_removed, spans (maximal removed runs, byte start and end)
    and kept_sha256.  Strings are judged on the input, occurrences may overlap or
    lie in one text, and never run over the end of a text.

    A null or empty text has no bytes; texts under ``width`` bytes stay whole.
    Rows repeated in full repeat each other's strings, so they lose every byte if
    they are long enough.  A null doc_id stays null; other columns are ignored; an
    empty table gives an empty result.  Whole stretches, and the digits before the
    last ones, are compared by 64-bit hashes; windows by their bytes.  A row is
    known by the hash of its id and text.
    """
    lean_workers(docs.sparkSession)
    if not GRAM <= width < GRAM + 250:
        raise ValueError(f"width must be from {GRAM} to {GRAM + 249}")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", body.alias("text"), F.xxhash64(F.col("doc_id"), body).alias("row"))
    long = rows.where(F.octet_length("text") >= width).select("row", "text")
    held = long.agg(F.sum(F.octet_length("text"))).first()[0]
    fragments = max(4, -(-(held or 0) // FRAGMENT_BYTES))

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for part in chunks(batch, "text"):
                data, at = buffers(part.column("text"))
                own = part.column("row").to_pylist()
                found += [first_digits(data[a:b], r, width) for r, a, b in zip(own, at[:-1], at[1:], strict=True)]
            if found:
                yield _fragments(*combine(np.concatenate(found)), fragments)

    def split(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        read = lambda kind, dtype: np.concatenate([np.zeros(0, dtype), *(np.frombuffer(c, dtype) for k, c in zip(kinds, data, strict=True) if k == kind)])
        r, state = split_digits(read(0, _FIRST))
        cells = np.zeros(len(r), _STRETCH)
        cells["start"], cells["span"], cells["back"], cells["open"] = r["start"], r["span"], r["back"], state
        whole = r[(state != 1) & (r["many"] == 0)]
        runs = _runs(whole["row"], whole["start"].astype(np.int64), whole["start"].astype(np.int64) + whole["span"])
        return _table(_by_row(r["row"][state > 0], cells[state > 0]), _run_cells(np.concatenate([read(1, _DONE), runs])))

    cut = long.mapInArrow(digits, "frag int, kind int, data binary").repartition(fragments, "frag").groupBy("frag").applyInArrow(split, "row bigint, cells binary, runs binary")
    stretches = materialise(cut.groupBy("row").agg(F.collect_list("cells").alias("cells"), F.collect_list("runs").alias("runs")), "repeats-stretches")

    # the third digit: only texts with open stretches
    def open_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, cells = [], []
            for r, parts in zip(batch.column("row").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if parts:
                    own.append(r)
                    cells.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(cells, pa.binary())], ["row", "cells"])

    opened = materialise(stretches.select("row", "cells").mapInArrow(open_only, "row bigint, cells binary"), "repeats-open")
    within = semi(long, opened.select("row"), "row").dropDuplicates(["row"]).join(opened, "row")

    def thirds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for part in chunks(batch, "text"):
                data, at = buffers(part.column("text"))
                out: list[tuple] = []
                for r, cell, a, b in zip(part.column("row").to_pylist(), part.column("cells").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    out += [(d, r, *rest) for d, *rest in cut_runs(data[a:b], np.frombuffer(cell, _STRETCH), width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], ["digit", "row", "start", "n", "far", "open", "text"])

    runs = materialise(within.mapInArrow(thirds, "digit bigint, row bigint, start int, n int, far int, open int, text binary"), "repeats-runs")
    crowds = materialise(runs.groupBy("digit").agg(F.count("*").alias("c")).where(F.col("c") > MANY).select("digit"), "repeats-crowds")
    tasks = max(4, -(-(runs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RUN_BYTES))

    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        digit, row, start, n, far, opened = (table.column(c).to_numpy() for c in ("digit", "row", "start", "n", "far", "open"))
        _, which, size = np.unique(digit, return_inverse=True, return_counts=True)
        kept = np.flatnonzero(size[which] > 1)
        data, at = buffers(pa.concat_arrays([*table.column("text").chunks, pa.array([], pa.binary())]))
        owner = np.repeat(kept, n[kept])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n[kept]) - n[kept], n[kept])
        same = equal_windows(which[owner] * 1024 + far[owner] - step, at[owner] + step, data, width)
        hit = np.flatnonzero(same & (opened[owner] == 1))
        return _more(row[owner[hit]], start[owner[hit]] + step[hit])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for digit, row, start, n, far, open_, text in zip(*(batch.column(c).to_pylist() for c in ("digit", "row", "start", "n", "far", "open", "text")), strict=True):
                common = far % RUN  # bytes before those that the run shares
                out += [(digit, far - k, text[k:common] + text[common + width - RUN + 1 : k + width], row, start + k, open_) for k in range(n)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], ["digit", "far", "edge", "row", "start", "open"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _more(batch.column("row").to_numpy(), batch.column("start").to_numpy().astype(np.int64)).to_batches()[0] if batch.num_rows else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["row", "more"])

    last = semi(runs, crowds, "digit", "left_anti").withColumn("frag", F.pmod(F.xxhash64("digit"), F.lit(tasks)).cast("int")).repartition(tasks, "frag").groupBy("frag").applyInArrow(settle, "row bigint, more binary")
    if not crowds.isEmpty():
        windows = materialise(semi(runs, crowds, "digit").mapInArrow(edges, "digit bigint, far int, edge binary, row bigint, start int, open int"), "repeats-windows")
        key = ["digit", "far", "edge"]
        often = materialise(windows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key), "repeats-often")
        last = last.unionByName(windows.where("open = 1").join(often, key).select("row", "start").mapInArrow(pack, "row bigint, more binary"))
    later = last.groupBy("row").agg(F.collect_list("more").alias("more"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = [], []
            for r, runs, more in zip(*(batch.column(c).to_pylist() for c in ("row", "runs", "more")), strict=True):
                spans = cover(np.frombuffer(b"".join([*runs, *(more or [])]), _RUN), width)
                if len(spans):
                    own.append(r)
                    out.append(spans.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(out, pa.binary())], ["row", "removed"])

    removed = materialise(stretches.select("row", "runs").join(later, "row", "left").mapInArrow(merge, "row bigint, removed binary"), "repeats-removed")
    touched = semi(rows, removed.select("row"), "row").join(removed, "row")
    clean = semi(rows, removed.select("row"), "row", "left_anti")

    span = T.StructType.fromDDL("start bigint, end bigint")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("kept binary, n_bytes bigint, n_removed bigint").fields, T.StructField("spans", T.ArrayType(span)), T.StructField("kept_sha256", T.StringType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, cell in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                raw, spans = text.encode(), np.frombuffer(cell, np.int64).reshape(-1, 2).tolist()
                left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
                for column, value in zip(out, (left, len(raw), len(raw) - len(left), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], schema.names)

    done = touched.select("doc_id", "text", "removed").mapInArrow(strip, schema)
    rest = clean.select(
        "doc_id", F.lit(None).cast("binary").alias("kept"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast(T.ArrayType(span)).alias("spans"), F.sha2("text", 256).alias("kept_sha256"),
    )
    return done.unionByName(rest)

