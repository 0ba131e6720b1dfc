"""Cutting the lineage of iterative jobs in the folder that the cluster names, and bounds of what passes to Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="siftworks-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; where it is mounted, it goes when the process ends."""
    path = f"{shared_folder(spark)}/siftworks/{uuid.uuid4().hex}"
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), True)
    return path


def small_batches(spark: SparkSession) -> SparkSession:
    """Have Spark pass no more than 1 MB, or one row, to Python at a time in this session, for rows that are large themselves."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder now and read from there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
