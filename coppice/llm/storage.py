"""Working tables in the folder that driver and executors share.

A job that needs a result more than once writes it as Parquet and reads it
again.  That cuts the lineage, survives the loss of executors and, unlike a
local checkpoint, leaves nothing on one machine.  Tables stay as long as results may
read them; ``working_tables`` tells which a piece of work made, for ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SET = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker; texts vary too much in length for a number of rows.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES, for good: plans read it when they run.  A lower one stays."""
    now = str(spark.conf.get(_BATCH, "64m")).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    size = int(now[: -1 if unit else None]) << unit
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a new local one in local mode and an error elsewhere."""
    root = spark.conf.get(_SET, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_SET} to a folder that the driver and all executors share")
        root = getattr(spark, "_coppice_root", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="coppice-")
            spark._coppice_root = root
    return root.rstrip("/")


def mapped(df: DataFrame, scan, schema) -> DataFrame:
    """``df`` through a function over its Arrow batches, which are of bounded size."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(scan, schema)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in getattr(spark, "_coppice_made", ()):
        made.append(path)
    return path


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of all tables that are made within."""
    made: list[str] = []
    spark._coppice_made = [*getattr(spark, "_coppice_made", ()), made]
    try:
        yield made
    finally:
        spark._coppice_made = [x for x in spark._coppice_made if x is not made]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df``, written to the shared folder once and read back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table that is small by contract; past ``bound`` rows that is an error, not a cut."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows; raise the bound or pass a smaller table")
    return rows
