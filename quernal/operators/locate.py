"""Symbols and places: definitions, references, the chunk at a line, context around a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernal.functions.ranking import is_trivial_doc
from quernal.functions.tokens import identifiers
from quernal.operators.lexical import KEY

MOST_CONTEXT = 200
#: Lines of a file that one task orders at most.
SPAN = 100_000


def symbol_defs(chunks: DataFrame) -> DataFrame:
    return chunks.select(*KEY, F.explode("symbols").alias("s")).select(F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), F.col("s.line").cast("int").alias("line"), *KEY)


def symbol_refs(chunks: DataFrame) -> DataFrame:
    """(name, key): each identifier of a chunk, lower-cased, that the chunk doesn't define itself."""
    named = F.array_distinct(F.transform(identifiers("content"), lambda t: F.lower(t)))
    own = F.transform("symbols", lambda s: s["name"]) if "symbols" in chunks.columns else F.array().cast("array<string>")
    return chunks.select(F.explode(F.array_except(named, own)).alias("name"), *KEY)


def symbol(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """names (name) -> (name, role, kind, line, key): definitions, and references at their chunk's first line with the
    kind of the first definition, or unknown."""
    return symbol_among(names, symbol_defs(chunks), symbol_refs(chunks), chunks)


def symbol_among(names: DataFrame, defs: DataFrame, refs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """The same from tables of all definitions and references; without ``chunks`` the latter have their ``line``."""
    asked = names.select(F.lower("name").alias("name")).distinct()
    defs = defs.join(asked, "name", "left_semi")
    refs = refs.join(asked, "name", "left_semi")
    if chunks is not None:
        refs = refs.join(chunks.select(*KEY, F.col("start_line").cast("int").alias("line")), list(KEY))
    first = defs.groupBy("name").agg(F.min(F.struct(*KEY, "line", "kind")).alias("d")).select("name", F.col("d.kind").alias("kind"))
    refs = refs.join(first, "name", "left").select("name", F.lit("ref").alias("role"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "line", *KEY)
    return defs.select("name", F.lit("def").alias("role"), "kind", "line", *KEY).unionByName(refs)


def _nearest_before(rows: DataFrame, by: list[str], pos: str, values: dict[str, Column], reach: int) -> DataFrame:
    """rows with the greatest of each value over the rows of their group before them by ``pos``, which may be as near as
    ``reach``; one running pass over each group's order."""
    frame = Window.partitionBy(*by).orderBy(pos).rangeBetween(Window.unboundedPreceding, -reach)
    return rows.select("*", *[F.max(v).over(frame).alias(c) for c, v in values.items()])


def resolve(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """anchors (aid, file_path, line) -> (aid, file_path, chunk_no, exact): the chunk that holds the line, else the
    nearest that isn't only comments; ties prefer symbols, then the later chunk.

    An as-of join: lines and the ends of chunks are put in one order of their file, and running extremes tell each line the
    chunks next to it, so the work is that of a sort.  Chunks of a file are in order of their first and last lines, as every
    chunker makes them.  Files are cut into spans of SPAN lines; what a span doesn't hold comes from the nearest one that
    does, by the same pass over spans, so no task gets more than a span of a file, or one row for each of its spans.
    """
    has = F.size("symbols") > 0 if "symbols" in chunks.columns else F.lit(False)
    slim = chunks.select(*KEY, F.col("start_line").cast("bigint").alias("s"), F.col("end_line").cast("bigint").alias("e"), has.cast("int").alias("has"), (~is_trivial_doc(F.col("content"))).alias("real"))
    known = F.struct("e", "s", "has", "chunk_no", "real")
    no_chunk, no_line = F.lit(None).cast(slim.select(known.alias("k")).schema["k"].dataType), F.lit(None).cast("bigint").alias("anchor")
    ends = slim.select("file_path", F.col("e").alias("pos"), no_line, known.alias("end"), no_chunk.alias("start"))
    starts = slim.select("file_path", F.col("s").alias("pos"), no_line, no_chunk.alias("end"), known.alias("start"))
    asked = anchors.select(F.struct("aid", "line").alias("of"), "file_path", F.col("line").cast("bigint").alias("pos"))
    lines = asked.select("file_path", "pos").distinct()  # anchors at one line are one event, however many there are
    lines = lines.select("file_path", "pos", F.col("pos").alias("anchor"), no_chunk.alias("end"), no_chunk.alias("start"))
    events = ends.unionByName(starts).unionByName(lines).withColumns({"span": F.floor(F.col("pos") / SPAN), "back": -F.col("pos")})
    end, start = F.col("end"), F.col("start")
    # what is greatest in these is the first chunk that ends behind or at the line, the best before it, the best behind it
    behind = {"after": F.when(end.isNotNull(), F.struct((-end["e"]).alias("x"), (-end["chunk_no"]).alias("y"), end["s"].alias("s")))}
    later = {"next": F.when(start["real"], F.struct((-start["s"]).alias("x"), start["has"].alias("has"), (-start["chunk_no"]).alias("y")))}
    earlier = {"before": F.when(end["real"], F.struct(end["e"].alias("x"), end["has"].alias("has"), end["s"].alias("s"), (-end["chunk_no"]).alias("y")))}
    found = _nearest_before(events, ["file_path", "span"], "back", behind | later, 1)
    found = _nearest_before(found, ["file_path", "span"], "back", {"at": behind["after"]}, 0)
    found = _nearest_before(found, ["file_path", "span"], "pos", earlier, 1).where("anchor is not null").select("file_path", "span", "anchor", "after", "at", "next", "before")
    spans = events.groupBy("file_path", "span").agg(*[F.max(v).alias(c) for c, v in (behind | later | earlier).items()]).withColumn("back", -F.col("span"))
    spans = _nearest_before(spans.select("file_path", "span", "back", *[F.col(c).alias(f"own_{c}") for c in ("after", "next", "before")]), ["file_path"], "back", {"far_after": F.col("own_after"), "far_next": F.col("own_next")}, 1)
    spans = _nearest_before(spans, ["file_path"], "span", {"far_before": F.col("own_before")}, 1).select("file_path", "span", "far_after", "far_next", "far_before")
    found = found.join(spans, ["file_path", "span"]).select("file_path", F.col("anchor").alias("pos"), *[F.coalesce(c, f"far_{c}").alias(c) for c in ("after", "next", "before")], F.coalesce("at", "far_after").alias("at"))
    met = asked.join(found, ["file_path", "pos"]).select("of.aid", "of.line", "file_path", "after", "at", "next", "before")
    line = F.col("line")
    held = F.col("after").isNotNull() & (F.col("after.s") <= line)
    edge = F.col("at").isNotNull() & (-F.col("at.x") == line)
    gap_next, gap_before = -F.col("next.x") - line, line - F.col("before.x")
    # equal gaps: the one with symbols, then the later one, which begins behind the line
    first = F.col("before").isNull() | (gap_next < gap_before) | ((gap_next == gap_before) & (F.col("next.has") >= F.col("before.has")))
    near = F.when(F.col("next").isNotNull() & first, -F.col("next.y")).otherwise(-F.col("before.y"))
    number = F.when(held, -F.col("after.y")).when(edge, -F.col("at.y")).otherwise(near)
    return met.select("aid", "file_path", number.cast(chunks.schema["chunk_no"].dataType).alias("chunk_no"), F.coalesce(held, F.lit(False)).alias("exact")).where("chunk_no is not null")


def at_line(chunks: DataFrame, line: int) -> DataFrame:
    """(key, exact) of the chunk at one line of the one file that the chunks are of: what :func:`resolve` finds."""
    has = F.size("symbols") > 0 if "symbols" in chunks.columns else F.lit(False)
    start, end = F.col("start_line"), F.col("end_line")
    grade = F.when((start <= line) & (end > line), 0).when(end == line, 1).when(~is_trivial_doc(F.col("content")), 2)
    near = F.when(grade == 2, F.greatest(start - line, line - end, F.lit(0))).otherwise(0)
    rows = chunks.select(*KEY, grade.alias("grade"), near.alias("gap"), F.when(grade == 2, has.cast("int")).otherwise(0).alias("has"), F.when(grade == 2, start).otherwise(0).alias("at"))
    best = rows.where("grade is not null").orderBy("grade", "gap", F.desc("has"), F.desc("at"), "chunk_no").limit(1)
    return best.select(*KEY, (F.col("grade") == 0).alias("exact"))


def symbols_at(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(aid, file_path, line) -> what :func:`symbol` says of every name the chunk there declares."""
    at = resolve(anchors, chunks).join(symbol_defs(chunks).select("name", *KEY), list(KEY)).select("aid", "name").distinct()
    return at.join(symbol(at, chunks), "name")


def chunk_ranges(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path", "start_line", "end_line").distinct()


def context(found: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """found (file_path, start_line, end_line, ...) with ``context``: n lines above, ..., the lines, ..., n below.

    Markers stand only where there is context; null without the file; n is clamped to 0..200 and 0 leaves only the lines.
    """
    n = max(0, min(n, MOST_CONTEXT))
    lines = F.split(F.regexp_replace(F.regexp_replace("whole", "\r\n", "\n"), "\n$", ""), "\n")
    rows = found.join(files.select("file_path", F.col("content").alias("whole")), "file_path", "left").withColumn("lines", lines)
    start, end = F.col("start_line"), F.least(F.col("end_line"), F.size("lines"))
    low = F.greatest(start - n, F.lit(1))
    above, mid = F.slice("lines", low, start - low), F.slice("lines", start, F.greatest(end - start + 1, F.lit(0)))
    below = F.slice("lines", end + 1, F.lit(n))
    dots = F.array(F.lit("..."))
    none = F.array().cast("array<string>")
    text = F.array_join(F.concat(F.when(F.size(above) > 0, F.concat(above, dots)).otherwise(none), mid, F.when(F.size(below) > 0, F.concat(dots, below)).otherwise(none)), "\n")
    return rows.select(*found.columns, F.when(F.col("whole").isNotNull(), text).alias("context"))
