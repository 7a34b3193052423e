"""Rows that stream past their client's state, and samples that are stored where they are needed.

A client's state comes first in its group, then its rows.  A task holds the state
of one client, sized by the model, and one Arrow batch of rows; no row carries a
copy of the state.  Samples that are stored in buckets of their client are not
shuffled again: the state travels to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.tables import shared_dir

#: What a client's work gets: its key, its state rows (None without any) and its row batches.
Work = Callable[[tuple, pa.RecordBatch | None, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Stored:
    """A table in buckets of its keys; ``rows`` reads it without a shuffle by them."""

    def __init__(self, spark: SparkSession, name: str, by: list[str], buckets: int):
        self.spark, self.name, self.by, self.buckets = spark, name, by, buckets

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        path = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").first().data_type
        self.spark.sql(f"DROP TABLE {self.name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame, what: str, by: list[str], buckets: int | None = None) -> Stored:
    """Writes df to the shared folder in buckets of ``by``, one sorted file each; as many as a shuffle has partitions."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{what.replace('-', '_')}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *by)
    dealt.write.bucketBy(n, *by).sortBy(*by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return Stored(spark, name, by, n)


def beside(rows: DataFrame, state: DataFrame, by: list[str], work: Work, schema: T.StructType | str, order: list[Column] | None = None, buckets: int | None = None) -> DataFrame:
    """Runs ``work`` once per key: key, state rows, then the other columns of its rows in Arrow batches.

    State and row columns travel in structs of their own, so their names may be
    alike.  ``order`` sorts the rows of a key.  ``buckets`` says that rows are
    stored in so many buckets of ``by``: then the state is dealt to them and the
    rows stay; otherwise both are shuffled by key once.  Keys without rows still run.
    """
    if buckets and rows.sparkSession.conf.get("spark.sql.unionOutputPartitioning", "true") != "true":
        buckets = None  # a union would not keep the buckets
    own = lambda df: [c for c in df.columns if c not in by]
    turns = [(c, f"_o{i}") for i, c in enumerate(order or [])]
    head = state.select(*[F.col(k).cast(rows.schema[k].dataType).alias(k) for k in by], F.lit(0).alias("_kind"), F.struct(*own(state)).alias("_state"))
    body = rows.select(*by, F.lit(1).alias("_kind"), F.struct(*own(rows)).alias("_row"), *[c.alias(n) for c, n in turns])
    head = head.repartition(buckets, *by) if buckets else head
    both = head.unionByName(body, allowMissingColumns=True)
    both = both if buckets else both.repartition(*by)
    ordered = both.sortWithinPartitions(*by, "_kind", *[n for _, n in turns])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first: list[pa.RecordBatch] = []
        for batch in batches:
            heads = int((batch.column("_kind").to_numpy() == 0).sum())
            if heads:
                held.append(_unpacked(batch.slice(0, heads), "_state"))
            if heads < batch.num_rows:
                first.append(_unpacked(batch.slice(heads), "_row"))
                break

        def rest() -> Iterator[pa.RecordBatch]:
            yield from first
            for batch in batches:
                if (batch.column("_kind").to_numpy() == 0).any():
                    raise RuntimeError("state came after rows: the rows were not sorted as planned")
                yield _unpacked(batch, "_row")

        whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        yield from work(key, whole[0] if whole else None, rest())

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return ordered.select(*by, "_kind", "_state", "_row").groupBy(*by).applyInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    struct = batch.column(column)
    return pa.RecordBatch.from_arrays(struct.flatten(), [struct.type.field(i).name for i in range(struct.type.num_fields)])


def wide(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as arrays of doubles."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, dtype=np.float64).ravel()))


def repeated(key: tuple, n: int) -> list[pa.Array]:
    """The key's columns for n result rows."""
    return [pa.repeat(k, n) for k in key]
