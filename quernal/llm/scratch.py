"""Intermediate tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only in local mode, where there is one machine, is a
folder of our own made if that is unset.  Every table is plain Parquet, so a lost executor costs a re-read, not a
recomputation.  Operators drop the tables that nothing reads any more; what returned DataFrames read goes with
:func:`clean`, or when the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one of our own only where none is named, in local mode."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{_SETTING} names no folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        folder = tempfile.TemporaryDirectory(prefix="quernal-")
        atexit.register(folder.cleanup)
        _own_root[app] = f"file://{folder.name}"
    return _own_root[app]


def _folder(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _folder(spark, path)
    return files.exists(at)


def application_root(spark: SparkSession) -> str:
    """The folder of this application's tables; it is deleted when the application ends."""
    root = f"{shared_root(spark)}/quernal-{spark.sparkContext.applicationId}"
    path, files = _folder(spark, root)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application; DataFrames that operators returned can't be read afterwards."""
    path, files = _folder(spark, application_root(spark))
    files.delete(path, True)


class Scratch:
    """Named Parquet tables of one operator call, under one folder of the shared root."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{application_root(spark)}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name`` and read it back: lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no returned DataFrame reads any more."""
        path, files = _folder(self.spark, f"{self.root}/{name}")
        files.delete(path, True)
