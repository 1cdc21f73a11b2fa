"""Shared intermediate storage for the training-data operators.

Intermediates are Parquet directories below ``spark.checkpoint.dir``: they cut
lineage, survive lost executors and are visible to every executor.  A folder of
our own is made only by a local master without that setting (tests); a cluster
without it is an error.

Texts travel to Python in batches of :data:`BATCH_ROWS` rows: two tasks that hold
10,000 whole texts each, on both sides, would not leave an executor of 3 GB room.

Every intermediate is deleted when the application ends.  A caller who knows
when a result has been written can collect the paths made for it with
:func:`collecting` and delete them earlier.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_collector: ContextVar[list[str] | None] = ContextVar("paths made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one for a local master without that setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="flowlattice-")
        spark.conf.set("spark.checkpoint.dir", configured)
        _delete_on_exit(spark, configured)
    return configured.rstrip("/")


#: Rows of an Arrow batch where rows hold whole texts; Spark's default suits narrow rows.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself; batches between the JVM and Python become small unless the session sets their size itself."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":  # the default
        conf.set(_BATCH, BATCH_ROWS)
    return df


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    hadoop, files = _path(spark, path)
    files.mkdirs(hadoop.getParent())
    files.mkdirs(hadoop)  # only existing paths are remembered
    files.deleteOnExit(hadoop)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    session = f"{shared_dir(spark)}/flowlattice/{spark.sparkContext.applicationId}"
    _delete_on_exit(spark, session)
    path = f"{session}/{label}-{uuid.uuid4().hex}"
    held = _collector.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that are made inside the block, by this thread or task alone."""
    paths: list[str] = []
    token = _collector.set(paths)
    try:
        yield paths
    finally:
        _collector.reset(token)


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete a job's shuffle files once its action has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system API."""
    hadoop, files = _path(spark, path)
    files.delete(hadoop, True)
