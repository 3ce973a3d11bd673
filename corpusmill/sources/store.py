"""Files of a store that driver and executors share, opened by byte ranges inside tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def uri(path: str) -> str:
    """path as a URI; Spark's own `file:/x` and plain local paths included."""
    if "://" in path:
        return path
    return "file://" + os.path.abspath(path.removeprefix("file:"))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return fs.FileSystem.from_uri(uri(path))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in spark.checkpoint.dir; a local session without it gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", uri(base))
    return f"{uri(base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, by Spark's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
