"""Incremental maintenance: which files changed and which went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: str) -> Column:
    return F.sha2(F.col(content).cast("binary"), 256)


def suspects(walk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of walk (path, size, mtime_nanos, ...) whose size or time isn't that of the manifest: only these are read."""
    old = manifest.select(F.col("path").alias("old_path"), F.col("size").alias("old_size"), F.col("mtime_nanos").alias("old_mtime"))
    same = F.expr("path = old_path and size = old_size and mtime_nanos = old_mtime")
    return walk.join(old, same, "left_anti")


def classify(walk: DataFrame, manifest: DataFrame) -> DataFrame:
    """walk (path, size, mtime_nanos, hash), manifest (same) -> (path, state): new, clean, touched or changed.

    A file of equal size and time is clean unseen; else its hash decides, so a lazy ``hash`` column is read only there.
    """
    old = manifest.select("path", F.col("size").alias("old_size"), F.col("mtime_nanos").alias("old_mtime"), F.col("hash").alias("old_hash"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_nanos") == F.col("old_mtime"))
    state = F.when(F.col("old_hash").isNull(), "new").when(same, "clean").when(F.col("hash") == F.col("old_hash"), "touched").otherwise("changed")
    return walk.join(old, "path", "left").select("path", state.alias("state"))


def deleted(walk: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(walk, "path", "left_anti").select("path")
