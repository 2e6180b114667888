"""Source trees: listed and read by tasks, folders and files being rows.

Spark's own file listing hides names that begin with ``_`` or ``.``, so it can't be used for source trees.  Trees are folders
that the driver and all executors mount.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.plans.storage import scratch
from quernal.sources.corpus import detect_language

MOST_BYTES = 1_000_000
FILES_A_TASK = 200
#: Entries of folders that a task looks at in one go.
ENTRIES = 20_000
# Folders that are never entered, and what names patterns to ignore.
SKIPPED = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".cache", ".quernal", "target")
IGNORE_FILES = (".gitignore", ".quernalignore")
TEXT = (".md", ".markdown", ".json", ".yaml", ".yml")
SCHEMES = ("http://", "https://", "ssh://", "git://", "git+ssh://", "file://")
CODE = (".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".rs", ".go", ".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".rb")


def extensions(include_text: bool = False, more: tuple[str, ...] = ()) -> tuple[str, ...]:
    return tuple(sorted({*CODE, *(TEXT if include_text else ()), *more}))


@lru_cache(4096)
def _glob(pattern: str) -> re.Pattern:
    """``**`` is anything, ``*`` anything but a slash, ``?`` any one character; a leading ``**/`` may be nothing."""
    anywhere = pattern.startswith("**/")
    parts = re.split(r"(\*\*|\*|\?)", pattern.removeprefix("**/") if anywhere else pattern)
    meaning = {"**": ".*", "*": "[^/]*", "?": "."}
    return re.compile(("(?:.*/)?" if anywhere else "") + "".join(meaning.get(part, re.escape(part)) for part in parts))


def matches(pattern: str, path: str) -> bool:
    """A trailing slash is a prefix from the root, a slash inside anchors the pattern, else it may begin anywhere."""
    if pattern.endswith("/"):
        return path.startswith(pattern.rstrip("/"))
    return bool(_glob(pattern if "/" in pattern else f"**/{pattern}").fullmatch(path))


def is_ignored(path: str, is_dir: bool, patterns: list[str]) -> bool:
    """The last pattern that matches decides; files start ignored and known extensions are let in by the first patterns."""
    ignored = not is_dir
    for pattern in patterns:
        if matches(pattern.lstrip("!"), path + "/" if is_dir else path):
            ignored = not pattern.startswith("!")
    return ignored


def _patterns(folder: str) -> list[str]:
    """What the ignore files in a folder say."""
    found: list[str] = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                found += [p for line in f if (p := line.strip()) and not p.startswith("#")]
        except OSError:
            pass
    return found


def _listed(root: str, wanted: tuple[str, ...], folder: str, patterns: list[str], most: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, list[str]]]]:
    """Files below a folder and the folders that are left to list, once some ``most`` entries have been looked at."""
    files: list[tuple[str, int, int]] = []
    open_, seen = [(folder, patterns)], 0
    while open_ and seen < most:
        at, patterns = open_.pop()
        patterns = patterns + _patterns(os.path.join(root, at))
        try:
            entries = list(os.scandir(os.path.join(root, at)))
        except OSError:
            continue
        seen += len(entries)
        for entry in entries:
            path = f"{at}/{entry.name}" if at else entry.name
            if entry.is_symlink():
                continue
            if entry.is_dir():
                if entry.name not in SKIPPED and not is_ignored(path, True, patterns):
                    open_.append((path, patterns))
            elif entry.name.endswith(wanted) and not is_ignored(path, False, patterns):
                try:
                    stat = entry.stat()
                except OSError:  # gone since the folder was listed
                    continue
                files.append((path, stat.st_size, stat.st_mtime_ns))
    return files, open_


def walk(spark: SparkSession, root: str, wanted: tuple[str, ...]) -> DataFrame:
    """(file_path, size, mtime_nanos) of the files of a tree that have a wanted extension; links are not followed.

    The tree is listed from its root in rounds.  Folders that are open are rows, each with the ignore patterns that hold in
    it, and are dealt out to tasks; a task goes down from its folders until it has looked at some ENTRIES, and gives back
    what it has found and the folders that it hasn't come to.  So a small tree is one round, a large one is listed by all
    tasks, and nothing but a count comes to the driver.
    """

    def lists(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for row in batch.to_pylist():
                files, open_ = _listed(root, wanted, row["file_path"], row["patterns"], ENTRIES)
                listed = [(p, s, t, None) for p, s, t in files] + [(p, None, None, patterns) for p, patterns in open_]
                for start in range(0, len(listed), ENTRIES):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed[start : start + ENTRIES], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["file_path", "size", "mtime_nanos", "patterns"])

    schema = "file_path string, size bigint, mtime_nanos bigint, patterns array<string>"
    open_ = spark.createDataFrame([("", None, None, [p for e in wanted for p in (f"!**/*{e}", f"!*{e}")])], schema)
    found = None
    while True:
        level = scratch(open_.mapInArrow(lists, schema))
        files = level.where("size is not null").drop("patterns")
        found = files if found is None else found.unionByName(files)
        left = level.where("size is null")
        n = left.count()
        if not n:
            return found
        open_ = left.repartition(min(n, max(spark.sparkContext.defaultParallelism, n // 64)), "file_path")


def read_file(root: str, path: str) -> str | None:
    """A file's text; None if it is over a megabyte, not UTF-8 or can't be read."""
    try:
        with open(os.path.join(root, path), "rb") as f:
            raw = f.read(MOST_BYTES + 1)
        return raw.decode("utf-8") if len(raw) <= MOST_BYTES else None
    except (OSError, UnicodeDecodeError):
        return None


def read_files(files: DataFrame, root: str) -> DataFrame:
    """files (file_path, size, mtime_nanos, language) of a tree -> with ``content``, null where :func:`read_file` gives none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), FILES_A_TASK):
                part = batch.slice(start, FILES_A_TASK)
                texts = pa.array([read_file(root, path) for path in part.column("file_path").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "content"])

    kept = files.select("file_path", "size", "mtime_nanos", "language")
    return kept.mapInArrow(read, "file_path string, size bigint, mtime_nanos bigint, language string, content string")


def read_tree(spark: SparkSession, root: str, include_text: bool = False, with_content: bool = True) -> DataFrame:
    """(file_path, size, mtime_nanos, language[, content]) of a source tree; with their content, files that have none (over a
    megabyte, not UTF-8) are left out."""
    if not os.path.exists(root):
        raise ValueError(f"no such path: {root}")
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    root = os.path.realpath(root)
    rows = walk(spark, root, extensions(include_text)).withColumn("language", detect_language(F.col("file_path")))
    if not with_content:
        return rows
    return read_files(rows.repartition(spark.sparkContext.defaultParallelism, "file_path"), root).where("content is not null")


def is_git_url(handle: str) -> bool:
    return handle.startswith(SCHEMES) or ("@" in handle and ":" in handle and not handle.startswith("/"))


@contextmanager
def cloned(url: str, ref: str | None = None, within: str | None = None) -> Iterator[str]:
    """A shallow clone in a temporary folder, which goes at the end.  Executors read it, so on a cluster it is an error if
    ``within`` doesn't name a mounted folder that they share with the driver."""
    spark = SparkSession.getActiveSession()
    if within is None and spark is not None and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("clones need a folder that the driver and all executors share")
    with tempfile.TemporaryDirectory(dir=within) as folder:
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", *(["--branch", ref] if ref else []), "--", url, folder], check=True)
        yield folder


def normalise_path(root: str, path: str) -> str:
    """Relative to the root if the path exists inside it, else unchanged."""
    real, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    return os.path.relpath(real, base) if os.path.exists(real) and real.startswith(base + os.sep) else path
