"""Cutting lineage through storage that every executor shares, and size-checked broadcasts.

Loops and operators that read an intermediate result more than once write it to the folder named
by ``spark.checkpoint.dir``.  A lost executor then costs a re-read, never a lost result.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: list[str] = []
#: Largest side, in bytes as estimated from its counted rows, that an operator may broadcast.
BROADCAST_BYTES = 64 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Read from ``spark.checkpoint.dir``; only a local session without that setting gets a
    temporary folder of its own, because there all executors live in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="plexus-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], True)
    return _OWN_ROOT[0]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a fresh shared Parquet table and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/plexus-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plexus_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a materialized table that no later plan reads."""
    path = getattr(df, "_plexus_path", None)
    if path is not None:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now.

    It deletes them when the driver's collector finds the plans unused, which on a driver with
    little to do may be after the disks of a long query are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only while ``rows * row_bytes`` stays under the bound.

    Beyond it the frame is returned as it is and the join shuffles both sides.
    """
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df

