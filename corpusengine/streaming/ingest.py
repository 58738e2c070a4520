"""Files and requests as streams into tables, each batch stored once whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusengine.sources.files import admit_uploads
from corpusengine.streaming.sessions import audited

#: What a binary file scan gives; ``content`` is read only where it is asked for.
FILE = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of ``folder`` as a stream of (filename, size_bytes, created_at, path); files of no bytes give no row."""
    found = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"), "path")


def store_batches(stream: DataFrame, parts: Mapping[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Starts a query that stores, for every batch, each of ``parts`` of it in ``folder``/<part>/batch=<number>.

    A batch that is played again, as after a lost driver, has its old number and overwrites
    what it left, whole or half. So every row of the stream is stored once. All parts of a
    batch are there when the checkpoint names the next one.
    """

    def store(batch: DataFrame, number: int) -> None:
        for name, part in parts.items():
            part(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """What ``store_batches`` has stored of ``part``, with its ``batch``; a batch at work may show."""
    return spark.read.parquet(f"{folder}/{part}")


def ingest_uploads(stream: DataFrame, folder: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Uploads by batch: ``accepted``, and ``rejected`` with their reason."""
    return store_batches(stream, {"accepted": lambda b: admit_uploads(b)[0], "rejected": lambda b: admit_uploads(b)[1]}, folder, checkpoint, trigger)


def store_audit(requests: DataFrame, prefixes: list[str], folder: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Requests of a stream on audited paths, in ``audit``."""
    return store_batches(requests, {"audit": lambda b: audited(b, prefixes)}, folder, checkpoint, trigger)
