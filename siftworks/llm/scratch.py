"""Shared scratch tables: intermediate results that cut lineage and survive lost executors.

They are Parquet below the folder that the session names in ``spark.checkpoint.dir``, which the
driver and all executors share.  Where the session names none a temporary folder is used on one
machine (tests), and anything else is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# What passes to Python at a time: a batch ends at this many rows or bytes, whichever is first.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
# While a table is written also: what it shuffled goes as soon as it is written, for nothing reads it again.
_WRITING = {**_BATCHES, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_local: list[str] = []


def small_batches(spark: SparkSession) -> SparkSession:
    """Have Spark pass few rows to Python at a time in this session: a batch of whole texts is then
    a few megabytes, or one text, in the executor, in its Python worker and on the way back."""
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    return spark


def _root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="siftworks-"))
    return "file://" + _local[0]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended: what it left in a mounted folder can still go
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


_open: "weakref.WeakSet[Scratch]" = weakref.WeakSet()


class Scratch:
    """A folder of tables.  Leaving the ``with`` block drops every table but those kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{_root(spark).rstrip('/')}/siftworks/{uuid.uuid4().hex}"
        self._names: set[str] = set()
        self._kept: set[str] = set()
        _open.add(self)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write df now and return it as read back."""
        where = f"{self.path}/{name}"
        before = {key: self.spark.conf.get(key) for key in _WRITING}
        try:
            for key, value in _WRITING.items():
                self.spark.conf.set(key, value)
            df.write.parquet(where)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        self._names.add(name)
        return self.spark.read.schema(df.schema).parquet(where)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """table() that outlives the block (for a result; it is small next to its input)."""
        out = self.table(name, df)
        self._kept.add(name)
        _results.append(self)
        return out

    def hold(self) -> None:
        """Keep all present tables until the process ends: a lazy result reads them."""
        self._kept |= self._names
        _results.append(self)

    def hold_only(self, *names: str) -> None:
        """Keep these tables beyond the block, and no others."""
        self._kept = set(names)
        _results.append(self)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._names:
                _delete(self.spark, f"{self.path}/{name}")
                self._names.discard(name)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(self._names - self._kept))
        if not self._kept:
            _delete(self.spark, self.path)


_results: list[Scratch] = []


@atexit.register
def _clean() -> None:
    for s in {id(s): s for s in [*_results, *_open]}.values():
        try:
            _delete(s.spark, s.path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass
