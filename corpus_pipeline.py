"""A training-data pipeline over documents: each stage's result is written and read again.

Stages take (spark, docs, sf_dir).  All but the last return the columns of
documents, with the rows that stay.

Every stage takes columns of documents by name and leaves others out, whatever
they are called.  Ids may be null or repeat: rows are told apart by a key of their
own.  Equal rows are judged alike, but for near copies, of which one stays, and the
mix, which chooses among documents of one source and length by a hash of their ids
(among equal ids by the rows' places).  A null or empty text has no letter, so it goes in the first stage; the
later ones keep it (an empty set is similar to nothing, holds no benchmark item, and
weighs nothing in the mix).  A null language is not learned from, a null source is a
source of its own.  An empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import decontaminate, jaccard, langid, mixing, sharding
from vectorloom.llm.common import BROADCAST_IDS, bucket_of, materialise, semi

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Column of a key of the row itself; ids may be null or repeat.
ROW = "_row"
#: A document goes if its language has less than this mean posterior over its letters; letters of unlearned scripts count 0.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts in no language that was learned.

    The posterior compares learned languages only, so the text's likelihood must
    also come near that of held-out documents of the language.  Every document is
    labelled once; those held out give the bounds, and all are then held against them.
    """
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    judged = [*COLUMNS, "lang_pred", "score", "likelihood"]
    named = materialise(langid.identify(docs.select(*COLUMNS), model, carry=COLUMNS).select(*judged), "pipeline-named")
    least = langid.least_likelihoods(named.where(held_out)).select(F.col("lang").alias("lang_pred"), "least")
    named = named.join(F.broadcast(least), "lang_pred", "left")  # one row per language
    likely = F.coalesce(F.col("likelihood") >= F.col("least"), F.lit(True))
    return named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & likely).select(*COLUMNS)


def keyed(docs: DataFrame, what: str) -> DataFrame:
    """docs with a key that every row has of its own, written once so that later reads agree on it."""
    return materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), f"pipeline-{what}-rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar documents: that of the smallest doc_id.

    A null doc_id comes after all others; among equal ones the first row stays.
    Different texts that share a doc_id are different documents.
    """
    rows = keyed(docs, "jaccard")
    classes = materialise(jaccard.similar(rows.select(F.col(ROW).alias("doc_id"), "text")), "pipeline-classes")
    named = classes.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    gone = materialise(classes.select(F.col("doc_id").alias(ROW)).join(first.select(F.col("first")[ROW].alias(ROW)), ROW, "left_anti"), "pipeline-gone")
    return semi(rows, gone, ROW, "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the rows that hold an item of the benchmark, whatever their doc_id."""
    index = decontaminate.build(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = keyed(docs, "decontamination")
    found = decontaminate.find_leaks(rows.select(F.col(ROW).alias("doc_id"), "text"), index)
    leaks = materialise(found.select(F.col("doc_id").alias(ROW)).distinct(), "pipeline-leaks")
    return semi(rows, leaks, ROW, "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that every source comes to its target."""
    rows = keyed(docs, "mix")
    plan = materialise(mixing.mix(rows, carry=[ROW]).where("copies > 0").select(ROW, "copies"), "pipeline-mix")
    small = plan.count() <= BROADCAST_IDS
    joined = rows.join(F.broadcast(plan) if small else plan, ROW)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every document, and every repeat of it, into one of 24 shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    dims = [sharding.label_cell(F.col("source")), sharding.label_cell(F.col("lang")), sharding.level(F.col("size")), sharding.level(F.col("n_chars"))]
    return sharding.shard_by_curve(rows, dims, ["text_crc32", "doc_id", "size"], 24).select("doc_id", "source", "lang", "size", "shard", "slot")


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", source_mix), ("sharding", shards)]
#: SQL cannot express the model of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
