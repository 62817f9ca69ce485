"""Intermediate tables in the folder that the whole cluster shares.

A table written here cuts lineage and survives the loss of any executor. The folder is the session's
``spark.checkpoint.dir``. Only a session whose master is this very process may do without that setting; a
cluster without it is refused, for a folder of the driver's is none of its executors'.

Tables that a result still reads stay until ``release`` is called, or the JVM ends.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from traceweft.sources.scratch import shared_folder

#: In a plain folder Hadoop starts a ``chmod`` for each file that it makes, and a JVM in the midst of a fork counts twice
#: as memory is measured. So tables go without checksum files there (Parquet's pages hold checksums) and without a mark.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Every set of tables that is not released yet, oldest first.
_live: list[Tables] = []


class Tables:
    """Tables of one run of one operator; ``keep`` writes one, ``drop`` removes it when nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.at: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.options(compression="zstd", **PLAIN).parquet(path)
        if self not in _live:
            _live.append(self)
            self._on(self.base, "deleteOnExit")  # works for what exists only
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Lets Spark's cleaner remove the shuffle files behind tables that are written.

        It follows the driver's garbage collection, which may be half an hour away; until then the files of
        every finished step would take disk on all executors.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self._on(self.at.pop(name), "delete", True)

    def _on(self, where: str, do: str, *more) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        getattr(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), do)(path, *more)


def mark() -> int:
    """A place in the history of working tables, for ``release``."""
    return len(_live)


def release(since: int = 0, but: Tables | None = None) -> None:
    """Deletes the working tables of all operators called after a mark, but for one; for when their results are written or collected."""
    for t in [t for t in _live[since:] if t is not but]:
        t._on(t.base, "delete", True)
        _live.remove(t)
