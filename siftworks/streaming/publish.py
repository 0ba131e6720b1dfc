"""All-or-none publication of assets into a folder, in two phases, with a log that readers trust.

An asset is a set of files (rows), each with a destination, its content and the digest it should
have.  A publication is a transaction with a name of the caller's:

1. prepared: its rows are written below ``staged`` and read back; every content is hashed again.
2. judged: an asset with a wrong digest fails, one that meets another content at a destination is a
   conflict, one whose files are all there already is skipped; the rest is written below ``data``.
   An asset is judged whole: none of its files is published without the others.
3. committed: a marker with the next number is put into ``log``, atomically and only if no other
   writer has put one there.  A writer that comes second judges again, now against the first one's
   files.  Readers read what markers name, nothing else.

A run that dies before the marker leaves nothing that readers see; the same transaction, run again,
starts over.  One that has its marker does nothing.  So a stream's batches, named by their numbers,
are published once each, whatever is restarted.

Putting the marker is a hard link on a mounted folder and a rename elsewhere, which must fail if the
target is there (HDFS does; object stores without that need a table format instead).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

STATUSES = ("published", "skipped", "conflict", "failed")


class Publisher:
    """Publishes into one folder; any number of them, in any processes, may do so at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(sc._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/log"))

    def _mounted(self, path: str) -> str | None:
        return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else None

    def _put(self, name: str, value: dict) -> bool:
        """Write value whole and give it its name, unless the name is taken."""
        draft, target = f"{self.folder}/log/.{uuid.uuid4().hex}", f"{self.folder}/log/{name}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if here := self._mounted(target):
                try:
                    os.link(self._mounted(draft), here)
                except FileExistsError:
                    return False
                return True
            return bool(self._fs.rename(self._path(draft), self._path(target)))
        finally:
            self._fs.delete(self._path(draft), False)

    def commits(self) -> list[dict]:
        """Markers in order; they number the transactions, not the rows."""
        found = []
        for status in self._fs.listStatus(self._path(f"{self.folder}/log")):
            if status.getPath().getName().startswith("commit-"):
                stream = self._fs.open(status.getPath())
                try:
                    found.append(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                finally:
                    stream.close()
        return sorted(found, key=lambda c: c["version"])

    def _read(self, kind: str, commits: list[dict], schema: str) -> DataFrame:
        where = [f"{self.folder}/data/{c['run']}/{kind}" for c in commits if kind == "status" or c["published"]]
        return self.spark.read.schema(schema).parquet(*where) if where else self.spark.createDataFrame([], schema)

    def published(self) -> DataFrame:
        """(asset, destination, content, digest, txn) of all committed transactions."""
        return self._read("files", self.commits(), "asset string, destination string, content binary, digest string, txn string")

    def statuses(self) -> DataFrame:
        """(asset, status, txn): what became of each asset in each committed transaction."""
        return self._read("status", self.commits(), "asset string, status string, txn string")

    def _judge(self, staged: DataFrame, before: DataFrame) -> DataFrame:
        """staged with the status of each row's asset."""
        wrong = ~F.sha2(F.coalesce("content", F.lit(b"")), 256).eqNullSafe(F.lower("digest"))
        first = staged.groupBy("destination").agg(F.min("asset").alias("first"), F.count_distinct(F.lower("digest")).alias("contents"))
        there = before.groupBy("destination").agg(F.min("digest").alias("there"))
        told = staged.join(first, "destination").join(there, "destination", "left")
        # Where assets of the transaction bring several contents to a destination the least asset goes first.
        clash = F.coalesce(F.col("there") != F.lower("digest"), F.lit(False)) | (F.col("asset") != F.col("first")) & (F.col("contents") > 1)
        by_asset = told.groupBy("asset").agg(F.bool_or(wrong).alias("wrong"), F.bool_or(clash).alias("clash"), F.bool_and(F.col("there").isNotNull()).alias("all"))
        status = F.when(F.col("wrong"), "failed").when(F.col("clash"), "conflict").when(F.col("all"), "skipped").otherwise("published")
        return by_asset.select("asset", status.alias("status"))

    def publish(self, files: DataFrame, txn: str, pause: Callable[[str], None] = lambda phase: None) -> str:
        """files (asset, destination, content, digest of SHA-256) -> "committed", or "known" if txn had its marker.

        Rows need an asset and a destination; others are an error.  pause is called after each phase, for tests.
        """
        if any(c["txn"] == txn for c in self.commits()):
            return "known"
        rows = files.select(F.col("asset").cast("string"), F.col("destination").cast("string"), F.col("content").cast("binary"), F.col("digest").cast("string"))
        staged_at = f"{self.folder}/staged/{uuid.uuid4().hex}"
        checked = rows.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a file to publish has no {c}"))).otherwise(F.col(c)) for c in ("asset", "destination")})
        checked.write.parquet(staged_at)
        staged = self.spark.read.schema(rows.schema).parquet(staged_at)
        pause("prepared")
        try:
            while True:
                commits = self.commits()
                if any(c["txn"] == txn for c in commits):
                    return "known"
                run = uuid.uuid4().hex
                before = self._read("files", commits, "asset string, destination string, content binary, digest string, txn string").select("destination", "digest")
                status_at = f"{self.folder}/data/{run}/status"
                self._judge(staged, before).withColumn("txn", F.lit(txn)).write.parquet(status_at)
                status = self.spark.read.parquet(status_at)
                good = staged.join(status.where("status = 'published'").select("asset"), "asset", "left_semi").select("asset", "destination", "content", F.lower("digest").alias("digest"), F.lit(txn).alias("txn"))
                # A file that is there, or that several assets share, is written once at most.
                new = good.select("asset", "destination").join(before.select("destination").distinct(), "destination", "left_anti").groupBy("destination").agg(F.min("asset").alias("asset"))
                good.dropDuplicates(["asset", "destination"]).join(new, ["asset", "destination"]).select("asset", "destination", "content", "digest", "txn").write.parquet(f"{self.folder}/data/{run}/files")
                n = status.where("status = 'published'").count()
                pause("judged")
                version = commits[-1]["version"] + 1 if commits else 1
                if self._put(f"commit-{version:012d}.json", {"version": version, "txn": txn, "run": run, "published": n}):
                    return "committed"
                self._fs.delete(self._path(f"{self.folder}/data/{run}"), True)  # another writer was first: judge again
        finally:
            self._fs.delete(self._path(staged_at), True)

    def publish_stream(self, stream: DataFrame, name: str, checkpoint: str):
        """A query that publishes each micro-batch of stream (asset, destination, content, digest) once."""

        def put(batch: DataFrame, number: int) -> None:
            Publisher(batch.sparkSession, self.folder).publish(batch, f"{name}-{number}")

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
