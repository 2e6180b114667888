"""An index on disk: immutable segments, tombstones, and a log of numbered commits.

``home`` has a folder for each kind of table with a folder for each segment in it (``chunks/segment=3``), ``commits`` with a
small JSON file for each version, and ``ids`` where writers reserve segment numbers.

* A writer adds a segment, the rows of new and changed files, and a list of the documents that are dead with it; nothing
  that is there is written again.  Readers read the segments that a commit names and leave dead documents out.
* A commit names its segments and keeps what queries need of the whole: documents, tokens, dead ones, and each segment's
  languages as ranges of document numbers.  Its file is created only if it isn't there yet, so of two writers one wins.  The
  loser takes its own changes on top of the winner's if they touch other files, else it raises :class:`Conflict`.
* Readers keep to the commit they have opened.  The commit that counts is the one of the greatest number: there is no
  pointer to swap, so never a moment without one.
* :meth:`Store.collect_garbage` deletes commits of a certain age, but the last, and the segments only they name.

On local file systems and HDFS creating a file only if absent is atomic; an object store needs conditional writes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.operators import blocks, lexical
from quernal.plans.storage import Folder, scratch

VERSION = 3
KEY = list(lexical.KEY)
SYMBOLS = "array<struct<name:string,kind:string,line:int>>"
#: Tables of a segment.  ``part`` columns are folders.
SCHEMAS = {
    "chunks": f"doc bigint, file_path string, chunk_no int, start_byte int, end_byte int, start_line int, end_line int, language string, content string, symbols {SYMBOLS}",
    "embedded": "doc bigint, file_path string, chunk_no int, language string, vector array<struct<bucket:int,weight:double>>",
    "names": "name string, kind string, line int, doc bigint, file_path string, chunk_no int, role string",
    "postings": f"{blocks.SCHEMA}, bucket int",
    "df": "term string, df bigint, tokens bigint",
    "dead": "doc bigint",
    "manifest": "path string, size bigint, mtime_nanos bigint, hash string, gone boolean, first_doc bigint, last_doc bigint",
}
#: Those of them that an index for words alone does without.
DERIVED = ("embedded", "names")
PARTS = {"names": ["role"], "postings": ["bucket"]}
#: A document's number: bits of its place in a part of its segment, of the part, and of the segment.
ROW_BITS, PART_BITS = 24, 20
#: Buckets of a segment's postings; segments of less text than this have one (numbered -1).
BUCKETS, WHOLE = 64, 1 << 20
#: Text of a part of a segment, about, where there are fewer parts than cores; and where there are more.
SMALL_PART, LARGE_PART = 1 << 21, 1 << 28
#: Dead documents that are broadcast at most (8 bytes each); more are left out by a shuffled join.
BROADCAST_DEAD = 1_000_000
#: Terms of a batch that are looked for by value in their buckets; more are met by a join with what every task holds.
MOST_TERMS = 2000


class Conflict(RuntimeError):
    """Another writer has changed the same files, or merged the segments, since this one began."""


class Commit(NamedTuple):
    number: int
    root: str | None
    #: (id, documents, bucketed, [(language, first doc, last doc)]) in the order in which they came.
    segments: tuple[tuple[int, int, bool, tuple[tuple[str | None, int, int], ...]], ...]
    n: int
    tokens: int
    dead: int
    at: float
    #: The last batch of each stream that is in.
    batches: dict[str, int] = {}  # noqa: RUF012
    #: Tables that some segment was written without.
    lacks: tuple[str, ...] = ()

    @property
    def ids(self) -> list[int]:
        return [s[0] for s in self.segments]

    @property
    def avg_len(self) -> float:
        return self.tokens / self.n if self.n else 0.0


class Delta(NamedTuple):
    """What a writer adds: a segment (with its n, tokens less those of the dead), dead documents, segments that go."""

    segment: tuple[int, int, bool, tuple[tuple[str | None, int, int], ...]]
    n: int
    tokens: int
    dead: int
    replaced: tuple[int, ...] = ()
    lacks: tuple[str, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.folder = spark, Folder(spark, home)
        self.home = self.folder.qualified()

    # -- commits --------------------------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in Folder(self.spark, f"{self.home}/commits").names() if name.endswith(".json") and name.removesuffix(".json").isdigit())

    def commit(self, number: int) -> Commit | None:
        """A commit that can be read and whose segments are all there; else None."""
        try:
            found = json.loads(self.folder.read(f"commits/{number:020d}.json") or "")
            if found["version"] != VERSION:
                return None
            segments = tuple((s["id"], s["docs"], s["bucketed"], tuple((x[0], x[1], x[2]) for x in s["languages"])) for s in found["segments"])
            commit = Commit(number, found["root"], segments, found["n"], found["tokens"], found["dead"], found["at"], found.get("batches", {}), tuple(found.get("lacks", ())))
        except (ValueError, KeyError, TypeError, IndexError, Py4JJavaError):
            return None
        there = all(self.folder.exists(f"{table}/segment={i}/_SUCCESS") for i in commit.ids for table in SCHEMAS if table not in commit.lacks)
        return commit if there else None

    def latest(self) -> Commit | None:
        numbers = self.numbers()
        return self.commit(numbers[-1]) if numbers else None

    def append(self, base: Commit | None, delta: Delta, root: str | None, touched: Callable[[], DataFrame] | None = None, batch: tuple[str, int] | None = None) -> Commit:
        """Commit ``delta`` on ``base``, or on what others have committed since, if that is about other files.  A ``batch`` of
        a stream that is in already is not committed again."""
        known = self.numbers()
        number = known[-1] if known else 0
        if base is None and number and self.commit(number) is not None:
            raise Conflict("another writer has made the first commit")
        if base is not None and base.number != number:
            base = self._rebased(base, delta, touched)
            number = base.number
        while True:
            if batch and base and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            batches = (base.batches if base else {}) | (dict([batch]) if batch else {})
            kept = tuple(s for s in base.segments if s[0] not in delta.replaced) if base else ()
            n, tokens, dead = (base.n, base.tokens, base.dead) if base else (0, 0, 0)
            if delta.replaced and base:
                new = Commit(number + 1, root, (*kept, delta.segment), delta.n, delta.tokens, 0, time.time(), batches, delta.lacks)
            else:
                lacks = tuple(sorted({*delta.lacks, *(base.lacks if base else ())}))
                new = Commit(number + 1, root, (*kept, delta.segment), n + delta.n, tokens + delta.tokens, dead + delta.dead, time.time(), batches, lacks)
            named = [{"id": s[0], "docs": s[1], "bucketed": s[2], "languages": s[3]} for s in new.segments]
            text = json.dumps({"version": VERSION, "root": root, "segments": named, "n": new.n, "tokens": new.tokens, "dead": new.dead, "at": new.at, "batches": batches, "lacks": new.lacks})
            if self.folder.create(f"commits/{new.number:020d}.json", text):
                return new
            if base is None:
                raise Conflict("another writer has made the first commit")
            base = self._rebased(base, delta, touched)
            number = base.number

    def _rebased(self, base: Commit, delta: Delta, touched: Callable[[], DataFrame] | None) -> Commit:
        """What was committed since ``base``, if ``delta`` holds on it as well."""
        now = self.latest()
        if now is None or delta.replaced or touched is None or not set(base.ids) <= set(now.ids):
            raise Conflict("segments have been merged or replaced since this writer began")
        others = [i for i in now.ids if i not in base.ids]
        if delta.segment[0] in others or not self.table("manifest", others).join(touched(), "path", "left_semi").isEmpty():
            raise Conflict("another writer has changed the same files")
        return now

    def collect_garbage(self, older_than: float) -> int:
        """Delete commits that are more than so many seconds old, but the last, and segments that no other names."""
        numbers, now = self.numbers(), time.time()
        commits = {n: self.commit(n) for n in numbers}
        keep = [n for n in numbers if n == numbers[-1] or (commits[n] and now - commits[n].at <= older_than)]
        live = {i for n in keep if commits[n] for i in commits[n].ids}
        for n in numbers:
            if n not in keep:
                self.folder.delete(f"commits/{n:020d}.json")
        gone = 0
        for name in Folder(self.spark, f"{self.home}/ids").names():
            # a segment without a commit may be in the making: its age counts from its reservation
            if name.isdigit() and int(name) not in live and now - self.folder.modified(f"ids/{name}") / 1000 > older_than:
                for table in SCHEMAS:
                    self.folder.delete(f"{table}/segment={name}")
                self.folder.delete(f"ids/{name}")
                gone += 1
        return gone

    # -- reading --------------------------------------------------------------------------------------------------

    def table(self, name: str, segments: Iterable[int]) -> DataFrame:
        """Rows of a table in some segments, dead ones included, with their ``segment``."""
        paths = [f"{self.home}/{name}/segment={i}" for i in segments]
        schema = f"{SCHEMAS[name]}, segment bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.home}/{name}").parquet(*paths)

    def alive(self, commit: Commit) -> Callable[[DataFrame], DataFrame]:
        """Leaves out the rows of dead documents."""
        if not commit.dead:
            return lambda rows: rows
        dead = self.table("dead", commit.ids).select("doc")
        dead = F.broadcast(dead) if commit.dead <= BROADCAST_DEAD else dead
        return lambda rows: rows.join(dead, "doc", "left_anti")

    def live(self, name: str, commit: Commit) -> DataFrame:
        """Rows of live documents; of the manifest, the last row of each path that isn't gone."""
        if name in commit.lacks:
            raise ValueError(f"this index was built for words alone: it has no table {name}")
        rows = self.table(name, commit.ids)
        if name != "manifest":
            return self.alive(commit)(rows).drop("segment")
        if len(commit.segments) == 1:
            return rows.where("not gone").drop("segment")
        order = F.create_map(*[F.lit(x).cast("bigint") for i, s in enumerate(commit.ids) for x in (s, i)])
        columns = [c for c in rows.columns if c not in ("path", "segment")]
        last = rows.groupBy("path").agg(F.max_by(F.struct(*columns), order[F.col("segment")]).alias("last"))
        return last.select("path", "last.*").where("not gone")

    def ranges(self, commit: Commit, languages: list[str] | None, paths: list[str] | None) -> list[tuple[int, int]]:
        """Documents in any of the languages or at any of the paths, as ranges of numbers: segments are in order of
        language and path, so there is a range for each language and segment, or path, language and segment."""
        found = [(first, last) for s in commit.segments for language, first, last in s[3] if language in (languages or [])]
        if paths:
            rows = self.table("chunks", commit.ids).where(F.col("file_path").isin(paths)).groupBy("segment", "language", "file_path")
            found += [(r.a, r.b) for r in rows.agg(F.min("doc").alias("a"), F.max("doc").alias("b")).collect()]
        return found

    def blocks(self, commit: Commit, buckets: Iterable[int], terms: list[str] | None) -> DataFrame:
        """Posting blocks in the buckets (and of the terms, if they are given): other folders aren't listed among the reads."""
        rows = self.table("postings", commit.ids).where(F.col("bucket").isin(-1, *buckets))
        if terms is not None and len(terms) > MOST_TERMS:  # blocks of other terms in the same buckets aren't passed on
            return rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
        return rows if terms is None else rows.where(F.col("term").isin(terms))

    # -- writing --------------------------------------------------------------------------------------------------

    def reserved(self) -> int:
        """A segment number that no other writer has."""
        taken = [int(n) for n in Folder(self.spark, f"{self.home}/ids").names() if n.isdigit()]
        number = max(taken, default=0) + 1
        while not self.folder.create(f"ids/{number}", ""):
            number += 1
        return number

    def _write(self, name: str, segment: int, rows: DataFrame) -> None:
        rows.write.partitionBy(*PARTS.get(name, [])).parquet(f"{self.home}/{name}/segment={segment}")

    def _written(self, name: str, segment: int) -> DataFrame:
        return self.table(name, [segment]).drop("segment")

    def write(self, chunks: DataFrame, derive: dict[str, Callable[[DataFrame], DataFrame]], manifest: DataFrame, minus: DataFrame | None = None, replaced: tuple[int, ...] = ()) -> Delta:
        """Write a segment of chunks and what ``derive`` (embedded, names) makes of them; nothing is committed yet.

        Without one of these the segment lacks its table.  ``manifest`` (path, size, mtime_nanos, hash, gone) are the files it is about (with first_doc and last_doc where those of
        another segment stay), ``minus`` (doc, file_path, content) the documents that die with it.
        """
        segment = self.reserved()
        size, n = chunks.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)), F.count("*")).first()
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(1, min(-(-size // SMALL_PART), cores), -(-size // LARGE_PART))
        order = ["language", "file_path", "chunk_no"]
        rows = chunks.repartitionByRange(parts, *order) if parts > 1 else chunks.coalesce(1)
        rows = rows.sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at"))
        part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        doc = F.lit(segment << (ROW_BITS + PART_BITS)) + F.shiftleft(part, ROW_BITS) + row
        fits = (part < 1 << PART_BITS) & (row < 1 << ROW_BITS)
        rows = rows.withColumn("doc", F.when(fits, doc).otherwise(F.raise_error(F.lit("a part of a segment has too many chunks")).cast("bigint")))
        self._write("chunks", segment, rows.select(*[c.split()[0] for c in SCHEMAS["chunks"].split(", ")]))
        kept = self._written("chunks", segment)
        post = blocks.built(kept)
        bucketed, died = size >= WHOLE, 0
        if minus is not None:
            # in order, so that blocks hold what a range has and not one document
            minus = minus.select("doc", "file_path", "content")
            minus = scratch(minus.repartitionByRange("doc").sortWithinPartitions("doc"))
            lost, died = blocks.built(minus), minus.count()
        found: dict[str, object] = {}

        def write_postings() -> None:
            if bucketed:  # a large bucket takes several files, each with some parts' ranges
                salt = F.pmod(F.shiftright("range", ROW_BITS - blocks.SHIFT), F.lit(max(1, n >> 18)))
                rows = post.withColumn("bucket", blocks.bucket_column("term", BUCKETS)).repartition("bucket", salt)
            else:
                rows = post.withColumn("bucket", F.lit(-1)).coalesce(1)
            self._write("postings", segment, rows.sortWithinPartitions("bucket", "term", "range"))
            kept_blocks = self._written("postings", segment)
            df = kept_blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum(blocks.n_tokens(kept_blocks)).alias("tokens"))
            if minus is not None:
                df = df.unionByName(lost.groupBy("term").agg((-F.sum("n")).alias("df"), (-F.sum(blocks.n_tokens(lost))).alias("tokens")))
            self._write("df", segment, (df.repartitionByRange(max(1, parts // 4), "term") if bucketed else df.coalesce(1)).sortWithinPartitions("term"))
            found["tokens"] = self._written("df", segment).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

        def write_manifest() -> None:
            docs = kept.groupBy(F.col("file_path").alias("path")).agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
            rows = manifest.join(docs, "path", "left")
            known = [F.coalesce(new, c).alias(c) if c in manifest.columns else F.col(new).alias(c) for new, c in (("a", "first_doc"), ("b", "last_doc"))]
            rows = rows.select("path", "size", "mtime_nanos", "hash", "gone", *known)
            self._write("manifest", segment, rows.coalesce(parts).sortWithinPartitions("path"))

        def write_languages() -> None:
            by = kept.groupBy("language").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).collect()
            found["languages"] = tuple((r.language, r.a, r.b) for r in sorted(by, key=lambda r: r.a))

        def write_dead() -> None:
            self._write("dead", segment, minus.select("doc").coalesce(1).sortWithinPartitions("doc") if minus is not None else self.spark.createDataFrame([], "doc bigint").coalesce(1))

        jobs = [write_postings, write_manifest, write_languages, write_dead, *[lambda name=name, make=make: self._write(name, segment, make(kept)) for name, make in derive.items()]]
        with ThreadPoolExecutor(len(jobs)) as pool:
            for job in [pool.submit(job) for job in jobs]:
                job.result()
        return Delta((segment, n, bucketed, found["languages"]), n - died, found["tokens"], died, replaced, tuple(t for t in DERIVED if t not in derive))


def within(ranges: list[tuple[int, int]] | None, doc: Column | None = None) -> Column | None:
    """Whether a document is in one of the ranges; None without a selector."""
    if ranges is None:
        return None
    doc = F.col("doc") if doc is None else doc
    found = F.lit(False)
    for first, last in ranges:
        found = found | doc.between(first, last)
    return found


def within_blocks(ranges: list[tuple[int, int]] | None) -> Column | None:
    """The same of blocks that may hold such a document."""
    if ranges is None:
        return None
    found = F.lit(False)
    for first, last in ranges:
        found = found | F.col("range").between(first >> blocks.SHIFT, last >> blocks.SHIFT)
    return found
