"""Sources by name, with the settings of datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import prep
from vectorloom.sources import binary, nested, text


@dataclass(frozen=True)
class Spec:
    """A dataset: which source reads it, from where, and how its samples are prepared."""

    name: str
    source: str
    path: str
    normalisation: str = "none"  # l2, standardize or none
    least: int = 2
    most_train: int | None = None
    most_test: int | None = None
    test_share: float = 0.3
    seed: int = 0
    options: dict = field(default_factory=dict)


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "spoken_letters": text.spoken_letters,
    "smartphone": text.smartphone,
    "sensor_log": text.sensor_log,
    "activity_monitor": text.activity_monitor,
    "watch_series": text.watch_series,
    "phone_events": lambda spark, path, **options: phone_windows(spark, path, **options),
    "federation": nested.federation,
    "images": lambda spark, path, **options: image_clients(spark, path, **options),
    "hand_movements": binary.hand_movements,
    "daily_activities": binary.daily_activities,
    "table": lambda spark, path, **_: spark.read.parquet(path),
}


def phone_windows(spark: SparkSession, path: str, gyroscope: str, step: float = 0.05, width: int = 128, stride: int = 64, by_device: bool = False) -> DataFrame:
    """Windows of a phone's acceleration and the gyroscope interpolated at its times: client, sample, y, x.

    Both series are deduplicated by time; the joined one is taken about every
    ``step`` seconds and cut into windows of ``width`` rows that have one class.
    """
    key = F.concat_ws("/", "user", "device") if by_device else F.col("user")
    read = lambda p: prep.first_per(text.phone_events(spark, p).withColumn("series", F.concat_ws("/", "user", "device")).withColumn("client", key), ["series", "sec"], ["x"])
    acc, gyro = read(path), read(gyroscope)
    axes = ["gx", "gy", "gz"]
    for i, axis in enumerate(axes):
        turn = gyro.select("series", "sec", F.get("x", F.lit(i)).alias("v"))
        acc = prep.interpolate(acc, turn, "series", "sec", "v").withColumnRenamed("interpolated", axis)
    both = acc.where(" AND ".join(f"{a} IS NOT NULL" for a in axes)).withColumn("x", F.concat("x", F.array(*axes)))
    labelled = prep.first_seen_labels(both, "sec", "gt", "y")
    sparse = prep.downsample(labelled, "series", ["sec"], F.col("sec"), step)
    cut = prep.windows(sparse.select("client", "series", "sec", "x", "y"), "series", ["sec"], width, stride, "x", "y", strict=True)
    names = sparse.select("series", "client").distinct()
    return cut.join(names, "series").select("client", F.xxhash64("series", "start").alias("sample"), F.col("label").cast("int").alias("y"), "x")


def image_clients(spark: SparkSession, path: str, labels: str, clients: int = 8, halves: int = 10, seed: int = 0) -> DataFrame:
    """Images dealt to clients by a Dirichlet draw over their classes: client, sample, y, x."""
    return prep.dirichlet_clients(binary.images(spark, path, labels), "sample", "y", clients, halves, seed).select("client", "sample", "y", "x")


def load_specs(spark: SparkSession, path: str) -> list[Spec]:
    """Dataset settings from a JSON file with a list ``datasets``; absent fields keep defaults."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("datasets").alias("d")).select("d.*").collect()  # a settings file
    known = Spec.__dataclass_fields__.keys()
    return [Spec(**{k: v for k, v in r.asDict(recursive=True).items() if k in known and v is not None}) for r in rows]


def seeded(spec: Spec, seed: int) -> Spec:
    return replace(spec, seed=seed)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table read from ``path``, made and written there first if it isn't there yet.

    A folder that a crash left half-written has no mark of success and is written
    anew.  Callers put all that the table depends on into the path.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load(spark: SparkSession, spec: Spec) -> DataFrame:
    """Samples of a dataset, split, filtered, capped and normalised: client, split, sample, y, x."""
    if spec.source not in SOURCES:
        raise ValueError(f"unknown source {spec.source!r}")
    rows = SOURCES[spec.source](spark, spec.path, **spec.options)
    rows = prep.valid_clients(rows, spec.least)
    if "split" not in rows.columns:
        rows = prep.split_train_test(rows, ["client", "y"], "sample", spec.test_share, spec.seed)
    for part, most, seed in (("train", spec.most_train, spec.seed), ("test", spec.most_test, f"{spec.seed}-test")):
        if most is not None:
            capped = prep.stratified_cap(rows.where(F.col("split") == part), "client", "y", "sample", most, seed)
            rows = rows.where(F.col("split") != part).unionByName(capped)
    if spec.normalisation == "l2":
        rows = prep.l2_normalise(rows)
    elif spec.normalisation == "standardize":
        rows = prep.standardise(rows, ["client"], F.col("split") == "train")
    elif spec.normalisation != "none":
        raise ValueError(f"unknown normalisation {spec.normalisation!r}")
    return rows
