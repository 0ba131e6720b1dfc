"""Journals of publications: tolerant and strict reading, replay, and replay as a stream.

The stream keeps the last write of each key.  Its state is one row for each key, its offsets and
state are in the checkpoint folder, so a stopped stream goes on where it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftworks.operators.lineage import shared_folder
from siftworks.operators.ordered import replay


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value, complete) of a journal, one file; a last line without its line feed is not complete.

    The file is read in splits, so a journal of any size is many tasks.  line_no orders the lines: the
    start of a line's split and its place there.  Only the last byte is looked at by itself.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    text = spark.read.text(path, lineSep="\n").select(place.alias("line_no"), "value")
    if _ends_whole(spark, path):
        return text.where("value <> ''").withColumn("complete", F.lit(True))
    last = text.agg(F.max("line_no").alias("_last"))  # one row
    return text.join(F.broadcast(last)).where("value <> ''").select("line_no", "value", (F.col("line_no") < F.col("_last")).alias("complete"))


def _ends_whole(spark: SparkSession, path: str) -> bool:
    """Whether the file is empty or its last byte is a line feed."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(sc._jsc.hadoopConfiguration())
    size = system.getFileStatus(where).getLen()
    if not size:
        return True
    stream = system.open(where)
    try:
        stream.seek(size - 1)
        return stream.read() == ord("\n")
    finally:
        stream.close()


def strict(journal: DataFrame, schema: str) -> DataFrame:
    """Complete lines as records; a complete line that is no record fails."""
    read = journal.where("complete").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    # The optimiser may ask this of a line before it knows that the line is complete.
    good = read.withColumn("_ok", F.assert_true(~F.col("complete") | F.col("r").isNotNull() & F.col("r._bad").isNull(), F.lit("journal line is corrupt")))
    return good.where("_ok is null").select("line_no", "r.*").drop("_bad")


def tolerant(journal: DataFrame, schema: str) -> DataFrame:
    """Lines that are records; others are passed over."""
    read = journal.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return read.where("r is not null and r._bad is null").select("line_no", "r.*").drop("_bad")


def last_state(records: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key."""
    return replay(records, keys, ["line_no"], [c for c in records.columns if c not in (*keys, "line_no")])


def last_writes(stream: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A stream's last value of each key: one row of state per key."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of each user and type, by a stream over the event table run until it has read everything."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if batch.inputFiles()[0].count("events.parquet/") else f"{sf_dir}/events*.parquet")
    where = f"{shared_folder(spark)}/siftworks/replayed-{uuid.uuid4().hex}"
    last = last_writes(stream, ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    put = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{where}/rows")  # noqa: E731  the whole state, written again
    query = last.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(last.schema).parquet(f"{where}/rows")
