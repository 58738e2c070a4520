"""Session helpers shared by all operators: tables, scratch storage, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that the innermost ``scratch_scope`` deletes when it ends.
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    executors live in this process (tests, one machine) a temporary folder is made and
    remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at files that survive the loss of any executor, and Catalyst sees
    the real size, so that its own size check decides about broadcasts. Inside a
    ``scratch_scope`` the files go when the scope ends, unless ``keep`` says that what the
    scope returns still reads them; then the scope around it takes them over.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not keep and (paths := _scope.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``materialize`` wrote inside, as nothing outside may read it any more."""
    token = _scope.set(paths := [])
    try:
        yield
    finally:
        _scope.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Arrow hand at most ``rows`` whole texts at once to Python workers, so that long texts stay within their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)
