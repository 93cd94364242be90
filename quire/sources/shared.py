"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    The cluster names it in spark.checkpoint.dir.  Only where that is unset, as in tests on
    one machine, a temporary folder is made and named as the session's checkpoint folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if "://" in named or named.startswith("file:"):
        return named
    # Without a scheme it lies in the cluster's default file system.
    default = sc._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"file://{named}" if default.startswith("file:") else default.rstrip("/") + named


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name within the shared folder."""
    base = shared_dir(spark)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: what is used twice is computed once, outlives
    executors and holds none of their memory."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
