"""Chunks: greedy line packing (native) and structural chunks with definitions (a parser per language, in Python).

Line chunking is a fold over the lines' byte lengths inside the row; a chunk is put together from its own lines, so
multibyte text stays exact and the time is linear in the text.  Only structural chunking, which needs a parser, runs
Python, once per file, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernal.operators import structure

TARGET = 1500
CHUNK = "file_path string, chunk_no int, start_byte int, end_byte int, start_line int, end_line int, language string, content string, symbols array<struct<name:string,kind:string,line:int>>"


def _lines(text: Column) -> Column:
    return F.when(text.rlike(r"\S"), F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def line_bounds(lines: Column, target: int = TARGET) -> Column:
    """Lines of a text -> array<struct<s, e, first, n>>: byte ranges of whole lines packed up to ``target`` bytes, which tile
    the text, with the first line of each (from 0) and how many they are."""
    start = F.struct(F.array().cast("array<struct<at:int,line:int>>").alias("ends"), F.lit(0).alias("cur"), F.lit(0).alias("at"), F.lit(0).alias("line"))

    def add(acc: Column, n: Column) -> Column:
        full = (acc["cur"] > 0) & (acc["cur"] + n > target)
        return F.struct(
            F.when(full, F.concat(acc["ends"], F.array(F.struct(acc["at"].alias("at"), acc["line"].alias("line"))))).otherwise(acc["ends"]).alias("ends"),
            F.when(full, n).otherwise(acc["cur"] + n).alias("cur"), (acc["at"] + n).alias("at"), (acc["line"] + 1).alias("line"),
        )

    def bounds(acc: Column) -> Column:
        ends = F.concat(acc["ends"], F.array(F.struct(acc["at"].alias("at"), acc["line"].alias("line"))))
        starts = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"))), acc["ends"])
        return F.zip_with(starts, ends, lambda s, e: F.struct(s["at"].alias("s"), e["at"].alias("e"), s["line"].alias("first"), (e["line"] - s["line"]).alias("n")))

    packed = F.aggregate(F.transform(lines, lambda x: F.octet_length(x)), start, add, bounds)
    return F.filter(packed, lambda b: b["n"] > 0)


def chunk_lines(files: DataFrame, target: int = TARGET) -> DataFrame:
    """files (file_path, content[, language]) -> chunks in file order, each with its byte range and 1-based lines."""
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    rows = files.select("file_path", language.alias("language"), _lines(F.col("content")).alias("lines"))
    rows = rows.select("file_path", "language", "lines", line_bounds(F.col("lines"), target).alias("bounds"))
    cut = F.transform("bounds", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["first"].alias("first"), b["n"].alias("n"), F.array_join(F.slice("lines", b["first"] + 1, b["n"]), "").alias("content")))
    rows = rows.select("file_path", "language", F.posexplode(cut).alias("chunk_no", "b"))
    start = F.col("b.first") + 1
    symbols = F.array().cast("array<struct<name:string,kind:string,line:int>>").alias("symbols")
    return rows.select("file_path", "chunk_no", F.col("b.s").alias("start_byte"), F.col("b.e").alias("end_byte"), start.alias("start_line"), (start + F.col("b.n") - 1).alias("end_line"), "language", F.col("b.content").alias("content"), symbols)


def _structural(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_path", pa.string()), ("chunk_no", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("language", pa.string()), ("content", pa.string()), ("symbols", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())])))])
    for batch in batches:
        rows = [chunk | {"file_path": f["file_path"], "language": f["language"]} for f in batch.to_pylist() for chunk in structure.chunks(f["content"], f["language"])]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def chunk_files(files: DataFrame) -> DataFrame:
    """files (file_path, content, language) -> chunks: structural where a parser finds structure, else by lines."""
    return files.select("file_path", "content", "language").where(F.col("content").rlike(r"\S")).mapInArrow(_structural, CHUNK)
