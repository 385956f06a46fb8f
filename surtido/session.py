"""Session factory and the one place that knows where shared data may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def build_session(app_name: str = "surtido", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; extra settings override."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_settings(shuffled_bytes: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings for ``build_session`` that keep shuffle partitions near ``partition_bytes``.

    Adaptive execution only merges partitions, so their number has to start
    high enough for the largest shuffle of the run.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, -(-shuffled_bytes // partition_bytes))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master with the setting unset
    (tests); on a cluster a missing setting is an error, never a machine-local
    fallback.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="surtido-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the application's own part of the shared folder."""
    folder = _FOLDER.get()
    if folder is None:
        folder = f"{shared_root(spark).rstrip('/')}/surtido-{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary_results(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block are deleted when it ends.

    For jobs that run again and again in one session; frames computed inside
    must not be used after the block.
    """
    folder = scratch_path(spark, "run")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing the rows as a table in the shared folder and reading it back.

    Used where a result is read several times, or where later steps rely on
    values (row ids, partition ids) that must not be computed twice. Survives
    the loss of executors, and later reads prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
