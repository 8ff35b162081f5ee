"""Working tables, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset, a local folder in local mode and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark, "_coppice_work", None) or "file://" + tempfile.mkdtemp(prefix="coppice-work-")
        spark._coppice_work = root
    return root.rstrip("/")


def clear_work(spark: SparkSession) -> int:
    """Delete the working tables this session has written; results that still read them can't be used after that.  How many there were."""
    made = getattr(spark, "_coppice_kept", [])
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._coppice_kept = []
    return len(made)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: the lineage ends here, and a lost executor loses nothing."""
    path = f"{work_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.sparkSession._coppice_kept = [*getattr(df.sparkSession, "_coppice_kept", []), path]
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
