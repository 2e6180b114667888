"""Folders of tables on whatever file system the path names: existence, small files, deletion, and scratch tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


class Folder:
    """A folder by Hadoop's file system API, so that a home may be local, HDFS or an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def qualified(self) -> str:
        path, files = self._at()
        return files.makeQualified(path).toString()

    def exists(self, name: str = "") -> bool:
        path, files = self._at(name)
        return files.exists(path)

    def names(self) -> list[str]:
        path, files = self._at()
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def modified(self, name: str) -> int:
        path, files = self._at(name)
        return files.getFileStatus(path).getModificationTime()

    def size(self) -> int:
        path, files = self._at()
        return files.getContentSummary(path).getLength() if files.exists(path) else 0

    def delete(self, name: str = "") -> None:
        path, files = self._at(name)
        files.delete(path, True)

    def read(self, name: str) -> str | None:
        """A small text file, or None."""
        path, files = self._at(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a small text file whole, only if there is none of that name; False if there is.

        It is written under another name first.  Locally a hard link gives it its own, elsewhere a rename that doesn't
        overwrite: either fails if another writer was faster.
        """
        path, files = self._at(name)
        files.mkdirs(path.getParent())
        new, _ = self._at(f"{name}.{uuid.uuid4().hex}.new")
        stream = files.create(new, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        try:
            if files.getUri().getScheme() == "file":
                plain = [files.makeQualified(p).toUri().getPath() for p in (new, path)]
                try:
                    os.link(*plain)
                except FileExistsError:
                    return False
                return True
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, path, options)
            except Py4JJavaError as error:
                if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                    return False
                raise
            return True
        finally:
            files.delete(new, False)


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the one that the session names in spark.checkpoint.dir.  In
    local mode a folder of our own serves if none is named.  It goes when the application ends."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    app = spark.sparkContext.applicationId
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{_SETTING} names no folder that the driver and all executors share")
        if app not in _own:
            made = tempfile.TemporaryDirectory(prefix="quernal-tables-")
            atexit.register(made.cleanup)
            _own[app] = f"file://{made.name}"
        named = _own[app]
    root = Folder(spark, f"{named.rstrip('/')}/quernal-tables-{app}")
    if not root.exists():
        path, files = root._at()
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root.path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`scratch` writes inside are deleted at the end: for calls that need none of them afterwards."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            Folder(spark, path).delete()


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's intermediate tables and read it back: what several branches of a plan read is made once."""
    spark = df.sparkSession
    out = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(out)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)
