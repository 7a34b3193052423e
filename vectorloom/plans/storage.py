"""Tables that rounds leave behind: state snapshots, resumed work, signatures."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.tables import settle, shared_dir

__all__ = ["Journal", "compatible", "load_snapshot", "remaining", "save_snapshot", "settle", "shared_dir", "signature", "signature_of", "upsert"]

def save_snapshot(state: DataFrame, base: str, dataset: str, method: str, seed: int, signature: str) -> None:
    """Appends the state of rounds, one folder per dataset, method, seed, signature and round."""
    keyed = state.withColumns({"dataset": F.lit(dataset), "method": F.lit(method), "seed": F.lit(seed), "signature": F.lit(signature)})
    keyed.write.mode("append").partitionBy("dataset", "method", "seed", "signature", "round").parquet(base)


def load_snapshot(spark: SparkSession, base: str, **keys: object) -> DataFrame:
    """State of the given dataset, method, seed, signature and round; other folders aren't read."""
    df = spark.read.parquet(base)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def signature(config: dict) -> str:
    """Ten digits of the SHA-1 of a configuration in canonical JSON."""
    import hashlib

    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]


def signature_of(json_text: Column) -> Column:
    """The same of a column that holds canonical JSON."""
    return F.substring(F.sha1(json_text), 1, 10)


class Journal:
    """Whole rounds in a folder: a round's tables are written aside and appear by one rename."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def publish(self, round_: int, tables: dict[str, DataFrame]) -> None:
        """Publishes a round; one that is there already stays."""
        aside = f"{self.folder}/.writing-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{aside}/{name}")
        if self.has(round_) or not self._files.rename(self._at(aside), self._at(f"{self.folder}/round={round_}")):
            self._files.delete(self._at(aside), True)

    def has(self, round_: int, name: str = "") -> bool:
        return self._files.exists(self._at(f"{self.folder}/round={round_}/{name}".rstrip("/")))

    def last(self) -> int:
        """The last published round, 0 if none is; what was being written counts nothing."""
        if not self._files.exists(self._at(self.folder)):
            return 0
        names = [str(f.getPath().getName()) for f in self._files.listStatus(self._at(self.folder))]
        return max((int(n.removeprefix("round=")) for n in names if n.startswith("round=")), default=0)

    def read(self, round_: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/round={round_}/{name}")


def remaining(expected: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is expected and not yet done."""
    return expected.join(completed.select(*keys).distinct(), keys, "left_anti")


def compatible(a: dict, b: dict, defaults: dict) -> bool:
    """Whether two run configurations agree, absent keys having their defaults."""
    keys = a.keys() | b.keys() | defaults.keys()
    return all(a.get(k, defaults.get(k)) == b.get(k, defaults.get(k)) for k in keys)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal keys; the rest of the table stays."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)
