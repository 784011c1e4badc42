"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs at most the tasks it was running.
Tables belong to a Scratch, whose owner deletes them once every result that
reads them has been written; nothing else deletes them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """The tables of one call, or of several calls whose results are written together.

    Operators take one as an argument. Without it they make their own, whose
    tables stay, like Spark's own checkpoints, until the folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._written: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written table."""
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self._written.append((made, path))
        return made

    def discard(self, made: DataFrame) -> None:
        """Delete the table that write() returned ``made`` for."""
        for entry in [e for e in self._written if e[0] is made]:
            self._written.remove(entry)
            self._delete(entry[1])

    def release(self) -> None:
        """Delete every table; call it once all that reads them has been written."""
        while self._written:
            self._delete(self._written.pop()[1])

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()
