"""Tables as scans for work that is heavy for each row, and folders for tables in between."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt anew: a small table in one row group would be the work of
    one task. Larger scans have more splits than that and are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getParent().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share, spark.checkpoint.dir; on one machine, where that may be
    unset, in a folder of our own. What is there goes when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spanforge-")
    path = f"{base.rstrip('/')}/spanforge-{uuid.uuid4().hex}"
    for p in (path, f"{path}.json"):
        atexit.register(_remove, spark, p)
    return path
