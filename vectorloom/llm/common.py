"""Small helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.tables import shared_dir

#: Rows of 8-byte ids up to which a set of them is broadcast; beyond, a shuffle join is used.
BROADCAST_IDS = 500_000
#: Bytes of text that a task turns into numpy arrays at a time.
CHUNK_BYTES = 1 << 20
#: Regular expressions of white space and of words, alike in Java, RE2 and Python.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lean_workers(spark: SparkSession) -> None:
    """Lets Python workers that start from now on give freed memory back at once.

    By default the C library and Arrow keep what a large batch took, for as long
    as a worker lives, and workers live on between stages.  Variables that the
    session already gives its workers stay.
    """
    for name, value in {"MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}.items():
        spark.sparkContext.environment.setdefault(name, value)


_SCOPES: list[list[str]] = []  # tables to delete when a scope of scratch() ends


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what materialise() writes inside, unless it says to keep it.

    A result that is returned must not read such tables.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    Lost executors cost nothing that was written.  Several later uses read the
    files instead of running the plan again.  Inside scratch() the table goes when
    the scope ends, or with the scope around that one if it is to be kept.
    """
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    for scope in _SCOPES[-2:-1] if keep else _SCOPES[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that keeps the partitions as they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """df semi- or anti-joined with ids, whose rows are counted first.

    Up to BROADCAST_IDS ids are broadcast, so df (with its texts) is not
    shuffled; a larger set takes a plain shuffle join.
    """
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def bucket_of(key: Column, mod: int) -> Column:
    """crc32 of the key as text modulo mod; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(mod))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text each."""
    texts = batch.column(column)
    at = 0
    held = 0
    wide = pa.types.is_large_string(texts.type)
    import numpy as np

    kind = np.int64 if wide else np.int32
    if batch.num_rows == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind, count=len(texts) + 1, offset=texts.offset * kind().itemsize)
    sizes = np.diff(offsets)
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)
