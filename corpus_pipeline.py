"""The corpus pipeline: five stages from raw documents to a mixed training corpus.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; run()
writes it as Parquet in the shared scratch folder and reads it back as the next stage's docs.  All
stages but the last return the columns of ``documents``; the last adds copies and the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftworks.llm import toxicity as toxic
from siftworks.llm.decontamination import drop_leaking
from siftworks.llm.mixing import mix, n_words
from siftworks.llm.near_dedup import drop_near_duplicates
from siftworks.llm.pii import find_pii, redact
from siftworks.llm.queries import toxic_labels
from siftworks.llm.scratch import Scratch, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest labelled examples call toxic."""
    small_batches(spark)
    return toxic.drop_toxic(docs, toxic.train(docs, toxic_labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    small_batches(spark)
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text."""
    scratch = Scratch(spark)
    clean = redact(find_pii(docs, scratch))
    scratch.hold()
    if "n_chars" in docs.columns:
        changed = F.size("pii_spans") > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document for the mix; documents that get none go."""
    scratch = Scratch(spark)
    row = "__siftworks_row"
    tagged = scratch.table("tagged", docs.withColumn(row, F.monotonically_increasing_id()))
    scratch.hold()
    mixed = mix(tagged.select(F.col(row).alias("id"), "source", n_words(F.col("text")).alias("size"))).where("copies > 0")
    added = ("size", "source_size", "target", "copies", "taken")
    kept = tagged.select(row, *(c for c in docs.columns if c not in added))
    return kept.join(mixed.select(F.col("id").alias(row), *added), row).drop(row)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]
ORACLE_SQL = None  # no stage can be written in SQL; tests hold each against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    scratch.hold()
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
