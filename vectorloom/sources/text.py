"""Sources in text files: CSV, white-space matrices, series of sensor lines, zipped lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators import prep
from vectorloom.operators.relational import ordinals
from vectorloom.sources.archive import archive_lines


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.btrim(p).try_cast("double"))


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated features with a 1-based label at the end; lines of fewer than two fields go."""
    parts = F.filter(F.transform(F.split("value", ","), F.btrim), lambda p: p != "")
    rows = spark.read.text(path).select(parts.alias("p"), F.col("_metadata.file_name").alias("file")).where(F.size("p") >= 2)
    return rows.select("file", (F.element_at("p", -1).cast("double").cast("int") - 1).alias("y"), _numbers(F.slice("p", F.lit(1), F.size("p") - 1)).alias("x"))


def spoken_letters(spark: SparkSession, root: str, clients: int = 8, halves: int = 10, seed: int = 0) -> DataFrame:
    """Two files, four speakers' parts to train and the fifth to test, dealt to clients by Dir(halves / 2)."""
    parts = [labelled_csv(spark, f"{root}/{name}").withColumn("split", F.lit(split)) for name, split in (("isolet1+2+3+4.data", "train"), ("isolet5.data", "test"))]
    rows = parts[0].unionByName(parts[1]).withColumn("sample", F.xxhash64("file", "y", "x"))
    return prep.dirichlet_clients(rows, "sample", "y", clients, halves, seed, ["split"]).select("client", "split", "sample", "y", "x")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated numbers, one row per line, with the line's ordinal from 1."""
    lines = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("at"), F.split(F.btrim("value"), r"\s+").alias("p")).where(F.element_at("p", 1) != "")
    return ordinals(lines.select("at", _numbers(F.col("p")).alias("x")), "at", "row").drop("at")


def smartphone(spark: SparkSession, root: str) -> DataFrame:
    """Feature, label and subject files aligned by line, for train and test; clients are subjects."""
    out = None
    for part in ("train", "test"):
        x = matrix(spark, f"{root}/{part}/X_{part}.txt")
        y = matrix(spark, f"{root}/{part}/y_{part}.txt").select("row", (F.col("x")[0].cast("int") - 1).alias("y"))
        who = matrix(spark, f"{root}/{part}/subject_{part}.txt").select("row", F.concat(F.lit("subject_"), F.col("x")[0].cast("int").cast("string")).alias("client"))
        rows = x.join(y, "row").join(who, "row").select("client", F.lit(part).alias("split"), F.col("row").alias("sample"), "y", "x")
        out = rows if out is None else out.unionByName(rows)
    return out


def sensor_log(spark: SparkSession, path: str, label: int = 23, skip: tuple[int, ...] = (), separator: str = r"\s+") -> DataFrame:
    """Logs of columns with a class column, 0 being no class; clients are files."""
    p = F.split(F.btrim("value"), separator)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("sample"), p.alias("p")).where(F.size("p") > label)
    kept = F.filter(F.transform(F.slice("p", 1, label), lambda v, i: F.struct(i.alias("i"), v.try_cast("double").alias("v"))), lambda c: ~c["i"].isin(*skip) if skip else F.lit(True))
    rows = lines.select(F.regexp_extract("file", r"([0-9]+)", 1).alias("n"), "sample", F.col("p")[label].try_cast("double").cast("int").alias("y"), F.transform(kept, lambda c: c["v"]).alias("x"))
    return prep.drop_null_class(rows.where("y IS NOT NULL")).select(F.concat(F.lit("subject_"), "n").alias("client"), "sample", "y", "x")


def activity_monitor(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated columns, the second the class and the rest features; NaN takes its column's mean."""
    p = F.split(F.btrim("value"), r"\s+")
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("client"), F.monotonically_increasing_id().alias("sample"), p.alias("p")).where(F.size("p") > 2)
    x = _numbers(F.slice("p", F.lit(3), F.size("p") - 2))
    rows = lines.select("client", "sample", F.col("p")[1].cast("int").alias("y"), x.alias("x")).where("y != 0")
    return prep.impute_mean(prep.compact_labels(rows, "y", "k").drop("y").withColumnRenamed("k", "y"), ["client"])


def phone_events(spark: SparkSession, path: str) -> DataFrame:
    """Timed three-axis readings with user, device and class; rows without a class go."""
    cols = ["Arrival_Time", "x", "y", "z", "User", "Device", "gt"]
    raw = spark.read.csv(path, header=True).select(*cols).na.drop()
    rows = raw.where(F.lower("gt") != "null")
    return rows.select(F.col("User").alias("user"), F.col("Device").alias("device"), (F.col("Arrival_Time").cast("double") / 1000).alias("sec"), F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("x"), "gt")


def watch_series(spark: SparkSession, path: str, modality: str = "phone/accel") -> DataFrame:
    """Lines ``id,label,time,x,y,z;`` in an archive; broken lines go, labels count by first sight."""
    p = F.split(F.rtrim(F.rtrim("value"), F.lit(";")), ",")
    rows = archive_lines(spark, path, modality).select("member", "line", p.alias("p")).where(F.size("p") >= 6)
    typed = rows.select(F.concat(F.lit("user_"), F.btrim(F.col("p")[0])).alias("client"), F.struct("member", "line").alias("order"), F.btrim(F.col("p")[1]).alias("label"), F.col("p")[2].try_cast("bigint").alias("time"), _numbers(F.slice("p", 4, 3)).alias("x"))
    good = typed.where(~F.exists("x", lambda a: a.isNull()))
    return prep.first_seen_labels(good, "order", "label", "y").select("client", F.xxhash64("order").alias("sample"), "time", "y", "x")
