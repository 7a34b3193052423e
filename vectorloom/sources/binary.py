"""Sources in binary files: IDX images and MATLAB arrays, decoded where they are read."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IDX = {0x08: np.uint8, 0x09: np.int8, 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}


def decode_idx(content: bytes) -> np.ndarray:
    """An array in IDX format, compressed or not."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    kind, rank = raw[2], raw[3]
    shape = struct.unpack(f">{rank}I", raw[4 : 4 + 4 * rank])
    return np.frombuffer(raw, _IDX[kind], offset=4 + 4 * rank).reshape(shape)


def idx_rows(spark: SparkSession, path: str) -> DataFrame:
    """Items of IDX files: file, row, x flattened; bytes are divided by 255."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a = decode_idx(content)
                flat = a.reshape(len(a), -1).astype(np.float64) / (255.0 if a.dtype == np.uint8 and a.ndim > 1 else 1.0)
                for low in range(0, len(flat), 4096):
                    part = flat[low : low + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(low, low + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["file", "row", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "file string, row bigint, x array<double>")


def images(spark: SparkSession, pictures: str, labels: str) -> DataFrame:
    """Images and labels of two IDX files side by side: sample, y, x."""
    x, y = idx_rows(spark, pictures), idx_rows(spark, labels)
    return x.select("row", "x").join(y.select("row", F.col("x")[0].cast("int").alias("y")), "row").select(F.col("row").alias("sample"), "y", "x")


# Fixed values of MATLAB 5 files: number types of data elements, and the elements that hold others.
_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
#: Classes of arrays of numbers; others (text, cells, structures, sparse ones) are passed over.
_NUMBERS = range(6, 16)


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Data elements one after the other: type and content.  Small ones carry up to four bytes in their tag."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(f"{order}II", raw, at)
        if kind >> 16:
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != _COMPRESSED else 0)


def decode_mat(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of real numbers in a MATLAB 5 file by name; parts may be compressed."""
    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, data in _elements(content[128:], order):
        for inner, body in _elements(zlib.decompress(data), order) if kind == _COMPRESSED else [(kind, data)]:
            parts = list(_elements(body, order)) if inner == _MATRIX else []
            if len(parts) < 4 or parts[0][1][0 if order == "<" else 3] not in _NUMBERS:
                continue
            shape = np.frombuffer(parts[1][1], f"{order}i4")
            values = np.frombuffer(parts[3][1], order + _MAT[parts[3][0]])
            out[parts[2][1].decode()] = values.reshape(tuple(shape), order="F")
    return out


def mat_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of the named matrices of MATLAB files side by side: file, row, x."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = decode_mat(content)
                flat = np.hstack([held[f].astype(np.float64).reshape(len(held[f]), -1) for f in fields])
                for low in range(0, len(flat), 4096):
                    part = flat[low : low + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(range(low, low + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["file", "row", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "file string, row bigint, x array<double>")


def hand_movements(spark: SparkSession, root: str, modality: str = "emg") -> DataFrame:
    """Movement recordings, three exercises per subject with classes offset by 0, 12 and 29."""
    fields = {"emg": ["emg"], "glove": ["glove"], "both": ["emg", "glove"]}[modality]
    rows = mat_rows(spark, f"{root}/S*_A1_E*.mat", [*fields, "restimulus"])
    part = lambda n: F.regexp_extract("file", r"S([0-9]+)_A1_E([0-9]+)\.mat$", n).cast("int")
    offset = F.when(F.col("e") == 1, 0).when(F.col("e") == 2, 12).otherwise(29)
    typed = rows.withColumns({"s": part(1), "e": part(2), "k": F.element_at("x", -1).cast("int")}).where("k != 0")
    return typed.select(F.concat(F.lit("subject_"), F.col("s").cast("string")).alias("client"), F.xxhash64("file", "row").alias("sample"), (F.col("k") + offset - 1).alias("y"), F.slice("x", F.lit(1), F.size("x") - 1).alias("x"))


def daily_activities(spark: SparkSession, root: str) -> DataFrame:
    """Recordings with activity and trial in the file name."""
    rows = mat_rows(spark, f"{root}/Subject*/a*t*.mat", ["sensor_readings"])
    part = lambda pattern: F.regexp_extract("file", pattern, 1)
    return rows.select(part(r"/(Subject[^/]*)/").alias("client"), part(r"t([0-9]+)\.mat$").cast("int").alias("trial"), F.col("row").alias("sample"), (part(r"/a([0-9]+)t").cast("int") - 1).alias("y"), "x")
