"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a new local folder where that is unset and all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        folder = getattr(sc, "_kronograph_folder", None)
        if folder is None:
            folder = sc._kronograph_folder = "file://" + tempfile.mkdtemp(prefix="kronograph")
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Written:
    """A table written to the shared folder; drop() deletes it, else it goes when the driver ends.

    write(path) does the writing where df is a stream.
    """

    def __init__(self, df: DataFrame, name: str, write: Callable[[str], None] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/kronograph-{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        atexit.register(self._quietly)
        (write or df.write.parquet)(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)

    def _quietly(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended; the folder's owner clears it
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).read()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
