"""What the operators share: the cluster's shared folder, written tables, Arrow slices, 64-bit mixing."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of an Arrow slice that is turned into Python objects at once (a single row may be larger).
SLICE_BYTES = 8 << 20

_area: contextvars.ContextVar[str | None] = contextvars.ContextVar("working area", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the session's spark.checkpoint.dir (or the checkpoint folder that was set on the
    context). Where neither is set, a temporary folder is made on a master in one process
    (``local[...]``); any other master raises, as executors would write to disks of their own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        was = sc._jsc.sc().getCheckpointDir()
        root = was.get() if was.isDefined() else None
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sparrowhawk-')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/") if "://" in root or root.startswith("file:") else f"file://{root.rstrip('/')}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the working area, or else the shared folder; nothing is created yet."""
    return f"{_area.get() or shared_root(spark) + '/sparrowhawk'}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def working_area(spark: SparkSession, name: str):
    """Within it, tables are written below one new folder, which is deleted at the end: write results elsewhere before."""
    path = shared_path(spark, name)
    mark = _area.set(path)
    try:
        yield path
    finally:
        _area.reset(mark)
        delete(spark, path)


def delete(spark: SparkSession, uri: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder (or path) and read again.

    This cuts the lineage: later steps read files that survive a lost executor. The folder
    may be deleted once nothing that reads it is still to run: ``discard`` does so for tables
    that later written tables have replaced, ``working_area`` for all of a step's.
    """
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._written_at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, size: int = SLICE_BYTES):
    """Arrow batches cut into slices of at most size bytes or one row, so that few Python objects exist at once."""
    for batch in batches:
        stack = [batch]
        while stack:
            part = stack.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                stack += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def open_store(uri: str):
    """(pyarrow file system, path) of a URI; works on executors for any scheme pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
