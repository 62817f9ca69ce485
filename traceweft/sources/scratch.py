"""Paths for files that a run makes for itself: the session's shared folder, or a local one where there is no cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="traceweft-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it only a session that is this very process may use a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path; what is written there goes when the JVM ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # what does not exist is not noted for deletion
    files.deleteOnExit(folder)
    return f"{folder.toString()}/{name}"
