"""Session-level helpers: the shared folder, cutting lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame is broadcast only when its rows are known to be at most so many, and at most so many bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without the setting, as in a trial, falls back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
        path = tempfile.mkdtemp(prefix="assaygrid-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the stored tables of this application: for when no result that reads them is needed any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives the loss of executors and fixes the outcome of range partitioning. What was shuffled for it is removed
    when it is written, so that a job of many stored tables holds the shuffles of one.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame | None) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more."""
    for df in stored:
        if df is not None and df.stored_at in _WRITTEN:
            _WRITTEN.remove(df.stored_at)
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast when ``rows`` (a proven upper bound) of ``row_bytes`` each allow it, else leave the choice to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df
