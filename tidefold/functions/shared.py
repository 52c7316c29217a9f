"""The folder that all executors of a cluster share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from tidefold.errors import SetupError


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, so that Spark and pyarrow mean the same place on every machine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file:///") else found


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise SetupError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidefold-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found.rstrip("/"))
