"""The search index: segments of relations on disk, and the query operations over them.

A refresh lists the tree without reading it, reads only files whose size or time is new, and analyses and embeds only what
really changed.  What comes of that is a new segment beside those that are there, with the documents that are dead since;
an unchanged tree writes nothing.  See :mod:`quernal.plans.store` for commits, snapshots and conflicts.
"""

from __future__ import annotations

import functools
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernal.functions import batches
from quernal.functions.ranking import query_symbols
from quernal.functions.tokens import identifiers
from quernal.operators import blocks, chunking, dense, fusion, incremental, lexical, locate, savings
from quernal.plans.storage import Folder, scratch, scratch_root, temporary
from quernal.plans.store import BUCKETS, DERIVED, MOST_TERMS, SYMBOLS, Commit, Conflict, Store, within, within_blocks
from quernal.sources.files import normalise_path, read_files, read_tree

KEY = list(lexical.KEY)
MANIFEST = "path string, size bigint, mtime_nanos bigint, hash string"
#: Times that a refresh begins anew because others have changed the same files meanwhile.
ATTEMPTS = 5
#: Files that are replaced, and documents that are found, up to which they are looked up by value; more meet in a join.
MOST_VALUES = 1000
#: Symbols up to which their ranges of names are read; of more, all names are.
MOST_RANGES = 100
#: Queries whose terms every task holds; more are joined with the blocks.
MOST_QUERIES = 10_000
#: Postings of all terms of a batch from which on top-k is pruned: below it, scoring them all takes less.
PRUNE_FROM = 10_000_000_000


def names_of(chunks: DataFrame) -> DataFrame:
    """(name, kind, line, doc, key, role): definitions, references, and words behind a definition keyword, in one pass."""
    kind = "array<struct<role:string,name:string,kind:string,line:int>>"
    entry = lambda role, name, kind, line: F.struct(F.lit(role).alias("role"), name.alias("name"), kind.cast("string").alias("kind"), line.cast("int").alias("line"))
    none, start = F.lit(None), F.col("start_line")
    named = F.array_distinct(F.transform(identifiers("content"), lambda t: F.lower(t)))
    own = F.transform("symbols", lambda s: s["name"])
    defs = F.transform("symbols", lambda s: entry("def", s["name"], s["kind"], s["line"])).cast(kind)
    refs = F.transform(F.array_except(named, own), lambda t: entry("ref", t, none, start)).cast(kind)
    declared = F.transform(fusion.declared_names("content"), lambda t: entry("declared", t, none, none)).cast(kind)
    rows = chunks.select("doc", *KEY, F.inline(F.concat(defs, refs, declared)))
    parts = max(1, chunks.rdd.getNumPartitions() // 4)
    rows = rows.repartitionByRange(parts, "role", "name") if parts > 1 else rows.coalesce(1)
    return rows.select("name", "kind", "line", "doc", *KEY, "role").sortWithinPartitions("role", "name", "doc")


class SearchIndex:
    """A snapshot of an index, with the operations over it.

    A search runs small jobs at once, for its terms and best documents; what it returns is a DataFrame.  With a ``ledger`` (a
    path) each search is run once more when it is asked for, to log what it saved.
    """

    def __init__(self, spark: SparkSession, store: Store, commit: Commit, encoder: dense.Encoder | None = None, ledger: str | None = None, root: str | None = None):
        self.spark, self.store, self.commit, self.encoder, self.ledger, self.root = spark, store, commit, encoder or dense.HashEncoder(), ledger, root
        self.alive = store.alive(commit)

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The live relations: chunks, embedded, manifest, and declared, defs and refs by role; those that it has."""
        found = {t: self.store.live(t, self.commit) for t in ("chunks", "embedded", "manifest") if t not in self.commit.lacks}
        if "names" in self.commit.lacks:
            return found
        names = self.store.live("names", self.commit)
        by_role = {"declared": names.where("role = 'declared'").select("name", "doc", *KEY), "defs": names.where("role = 'def'").drop("role"), "refs": names.where("role = 'ref'").drop("role", "kind")}
        return found | by_role

    @staticmethod
    def _derive(encoder: dense.Encoder, lacks: tuple[str, ...] = ()) -> dict:
        made = {"embedded": lambda kept: encoder.encode(kept, "content", ["doc", *KEY, "language"]), "names": names_of}
        return {table: make for table, make in made.items() if table not in lacks}

    @classmethod
    def of_chunks(cls, chunks: DataFrame, encoder: dense.Encoder | None = None, home: str | None = None, root: str | None = None, batch: tuple[str, int] | None = None, only_words: bool = False, **more) -> SearchIndex:
        """An index of a table of chunks, in ``home`` or, without one, among the session's intermediate tables.  One for words
        alone (``mode="bm25"``) has no vectors and names: other searches of it are a ValueError."""
        spark, encoder = chunks.sparkSession, encoder or dense.HashEncoder()
        store = Store(spark, home or f"{scratch_root(spark)}/index-{uuid.uuid4().hex}")
        symbols = F.col("symbols").cast(SYMBOLS) if "symbols" in chunks.columns else F.array().cast(SYMBOLS).alias("symbols")
        chunks = scratch(chunks.withColumn("symbols", symbols))
        files = chunks.groupBy(F.col("file_path").alias("path")).agg(F.sum(F.octet_length("content")).alias("size"))
        files = files.select("path", "size", F.lit(None).cast("bigint").alias("mtime_nanos"), F.lit(None).cast("string").alias("hash"), F.lit(False).alias("gone"))
        base = store.latest()
        delta = store.write(chunks, cls._derive(encoder, DERIVED if only_words else ()), files, replaced=tuple(base.ids) if base else ())
        return cls(spark, store, store.append(base, delta, root, batch=batch), encoder, root=root, **more)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, include_text: bool = False, **more) -> SearchIndex:
        with temporary(spark):
            chunks = scratch(chunking.chunk_files(read_tree(spark, root, include_text)))
            if chunks.isEmpty():
                raise ValueError(f"no supported files under {root}")
            return cls.of_chunks(chunks, root=root, **more)

    # -- persistence ----------------------------------------------------------------------------------------------

    @staticmethod
    def state(spark: SparkSession, home: str) -> Commit | None:
        """The last commit, if it can be read and all tables of its segments are there."""
        return Store(spark, home).latest()

    @classmethod
    def open(cls, spark: SparkSession, home: str, version: int | None = None, **more) -> SearchIndex | None:
        """The last commit or a certain one, or None: a cache that is missing or broken is never an error."""
        store = Store(spark, home)
        commit = store.latest() if version is None else store.commit(version)
        return None if commit is None else cls(spark, store, commit, **({"root": commit.root} | more))

    def save(self, home: str) -> SearchIndex:
        """A copy of the live chunks as an index of one segment, in place of what is in ``home``."""
        return SearchIndex.of_chunks(self.store.live("chunks", self.commit).drop("doc"), self.encoder, home, self.root, only_words=bool(self.commit.lacks), ledger=self.ledger)

    @classmethod
    def refresh(cls, spark: SparkSession, root: str, home: str, include_text: bool = False, **more) -> SearchIndex:
        """Bring the index up to the tree; see the module.  If another refresh has changed the same files meanwhile, this one
        begins anew from there."""
        for attempt in range(ATTEMPTS):
            try:
                with temporary(spark):
                    return cls._refreshed(spark, root, home, include_text, **more)
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
        raise AssertionError

    @classmethod
    def _refreshed(cls, spark: SparkSession, root: str, home: str, include_text: bool, encoder: dense.Encoder | None = None, **more) -> SearchIndex:
        encoder, store = encoder or dense.HashEncoder(), Store(spark, home)
        base = store.latest()
        walk = scratch(read_tree(spark, root, include_text, with_content=False).select(F.col("file_path").alias("path"), "size", "mtime_nanos", "language"))
        old = scratch(store.live("manifest", base)) if base else spark.createDataFrame([], f"{MANIFEST}, gone boolean, first_doc bigint, last_doc bigint")
        suspects = incremental.suspects(walk, old)
        gone = incremental.deleted(walk, old)
        # content and hash are of one reading; a file that changes after the walk has another time at the next one
        read = read_files(suspects.select(F.col("path").alias("file_path"), "size", "mtime_nanos", "language"), root)
        read = scratch(read.select("*", incremental.content_hash("content").alias("hash")))
        if base and read.isEmpty() and gone.isEmpty():
            return cls(spark, store, base, encoder, root=root, **more)
        hashed = read.select(F.col("file_path").alias("path"), "size", "mtime_nanos", "hash")
        dirty = scratch(incremental.classify(hashed, old).where(F.col("state").isin("new", "changed")).select(F.col("path").alias("file_path")))
        chunks = scratch(chunking.chunk_files(read.join(dirty, "file_path", "left_semi").where("content is not null")))
        if base is None and chunks.isEmpty():
            raise ValueError(f"no supported files under {root}")
        clean = hashed.join(dirty.withColumnRenamed("file_path", "path"), "path", "left_anti").join(old.select("path", "first_doc", "last_doc"), "path", "left")
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("first_doc", "bigint"), ("last_doc", "bigint"))]
        files = clean.unionByName(hashed.join(dirty.withColumnRenamed("file_path", "path"), "path", "left_semi").select("*", *none)).withColumn("gone", F.lit(False))
        files = scratch(files.unionByName(gone.join(old, "path").select("path", "size", "mtime_nanos", "hash", *none, F.lit(True).alias("gone"))))
        replaced = dirty.unionByName(gone.select(F.col("path").alias("file_path")))
        delta = store.write(chunks, cls._derive(encoder, base.lacks if base else ()), files, cls._dying(store, base, old, replaced) if base else None)
        commit = store.append(base, delta, root, lambda: files.select("path"))
        return cls(spark, store, commit, encoder, root=root, **more)

    def upsert(self, chunks: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> SearchIndex:
        """Files of a table put in the place of those of the same path, and files that go (file_path): a segment and a commit
        on top of this snapshot's."""
        files = chunks.groupBy(F.col("file_path").alias("path")).agg(F.sum(F.octet_length("content")).alias("size"))
        rows = files.select("path", "size", F.lit(False).alias("gone"))
        if gone is not None:
            rows = rows.unionByName(gone.select(F.col("file_path").alias("path"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("gone")))
        rows = scratch(rows.select("path", "size", F.lit(None).cast("bigint").alias("mtime_nanos"), F.lit(None).cast("string").alias("hash"), "gone"))
        symbols = F.col("symbols").cast(SYMBOLS) if "symbols" in chunks.columns else F.array().cast(SYMBOLS).alias("symbols")
        chunks = chunks.withColumn("symbols", symbols)
        replaced = rows.select(F.col("path").alias("file_path"))
        minus = self._dying(self.store, self.commit, self.store.live("manifest", self.commit), replaced)
        delta = self.store.write(chunks, self._derive(self.encoder, self.commit.lacks), rows, minus)
        commit = self.store.append(self.commit, delta, self.root, lambda: rows.select("path"), batch)
        return SearchIndex(self.spark, self.store, commit, self.encoder, self.ledger, self.root)

    @staticmethod
    def _dying(store: Store, base: Commit, old: DataFrame, replaced: DataFrame) -> DataFrame:
        """Live chunks of files that are replaced: few files by their ranges of documents, so that little is read."""
        files = old.where("first_doc is not null").join(replaced.withColumnRenamed("file_path", "path"), "path", "left_semi")
        few = files.select("path", "first_doc", "last_doc").limit(MOST_VALUES + 1).collect()
        chunks = store.live("chunks", base)
        if len(few) > MOST_VALUES:
            return chunks.join(replaced, "file_path", "left_semi")
        return chunks.where(within([(r.first_doc, r.last_doc) for r in few]) & F.col("file_path").isin([r.path for r in few]))

    @classmethod
    def compact(cls, spark: SparkSession, home: str, **more) -> SearchIndex:
        """Merge all segments into one without the dead; vectors are kept.  A commit that comes between is a conflict."""
        store = Store(spark, home)
        base = store.latest()
        if base is None:
            raise ValueError(f"no index in {home}")
        derive = {} if base.lacks else {"embedded": lambda kept: kept.select("doc", *KEY, "language").join(store.live("embedded", base).select(*KEY, "vector"), KEY).select("doc", *KEY, "language", "vector"), "names": names_of}
        files = scratch(store.live("manifest", base).select("path", "size", "mtime_nanos", "hash", F.lit(False).alias("gone")))
        delta = store.write(store.live("chunks", base).drop("doc"), derive, files, replaced=tuple(base.ids))
        commit = store.append(base, delta, base.root)
        return cls(spark, store, commit, **({"root": base.root} | more))

    @staticmethod
    def collect_garbage(spark: SparkSession, home: str, older_than: float) -> int:
        return Store(spark, home).collect_garbage(older_than)

    @staticmethod
    def clear(spark: SparkSession, home: str) -> None:
        Folder(spark, home).delete()

    # -- queries --------------------------------------------------------------------------------------------------

    def _asked(self, query: str, alpha: float | None = None) -> DataFrame:
        return self.spark.createDataFrame([(0, query, alpha)], "qid int, query string, alpha double")

    def chosen(self, languages: list[str] | None, paths: list[str] | None, lenient: bool = False) -> list[tuple[int, int]] | None:
        """The documents in any of the languages or at any of the paths, as ranges of their numbers; None without a filter."""
        if not languages and not paths:
            return None
        return self.store.ranges(self.commit, languages, paths) or (None if lenient else [])

    def search(self, query: str, k: int = 5, mode: str = "hybrid", alpha: float | None = None, languages: list[str] | None = None, paths: list[str] | None = None, context: int | None = None, lenient_filters: bool = False) -> DataFrame:
        """Ranked chunks; a blank query finds nothing.  A filter that matches nothing gives no rows, or with
        ``lenient_filters`` counts as none.  ``context`` adds a column with so many lines above and below."""
        if k < 1:
            raise ValueError("k must be at least 1")
        if mode not in ("hybrid", "semantic", "bm25"):
            raise ValueError(f"unknown mode: {mode}")
        asked = self._asked(query, alpha)
        with temporary(self.spark):
            found = self._ranked(asked if query.strip() else asked.limit(0), k, mode, self.chosen(languages, paths, lenient_filters)).drop("qid")
            best, schema = found.collect(), found.schema
        return self._finished(best, schema, "search", context)

    def _finished(self, best: list, schema: StructType, call: str, context: int | None) -> DataFrame:
        """The best, at most k rows, with the chunks they name, read by their files."""
        chunks = self.store.live("chunks", self.commit).where(F.col("file_path").isin(sorted({r.file_path for r in best}))).drop("doc")
        rows = self.spark.createDataFrame(best, schema).join(chunks, KEY)
        if self.ledger:
            rows = scratch(rows)
            self.log_call(rows, call, float(int(time.time())))
        return (rows if context is None else self.with_context(rows, context)).orderBy("rank")

    def with_context(self, found: DataFrame, n: int) -> DataFrame:
        """found with ``context``: its lines and n around them, read from the tree; null where the file can't be read."""
        if self.root is None:
            return found.withColumn("context", F.lit(None).cast("string"))
        paths = found.select("file_path").distinct().select("file_path", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "bigint"), ("mtime_nanos", "bigint"), ("language", "string"))])
        return locate.context(found, read_files(paths, self.root).where("content is not null"), n)

    def words(self, queries: DataFrame, k: int, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """The lexical leg: (qid, key, score, rank, source).  Only buckets of the queries' terms are read."""
        if k < 1:
            raise ValueError("k must be at least 1")
        kind = queries.schema["qid"].dataType.simpleString()
        some = queries.select("qid", "query").limit(MOST_QUERIES + 1).collect()
        if len(some) <= MOST_QUERIES:
            tokens = batches.Tokens()
            weights = self._weights([(r.qid, term, n) for r in some for term, n in tokens.count(r.query).items()])
            postings, terms = sum(df for _, _, df, _ in weights), sorted({t for _, t, _, _ in weights})
            near = within_blocks(ranges)
            post = self.store.blocks(self.commit, sorted({blocks.bucket_of(t, BUCKETS) for t in terms}), terms)
            post = post if near is None else post.where(near)
            if postings < PRUNE_FROM:
                held = blocks.Weights([(q, t, w, True) for q, t, _, w in weights])
                found = blocks.gathered(held, kind, post, self.commit.avg_len, k, self._dead(), ranges)
            else:
                found = self._pruned(self.spark.createDataFrame(weights, f"qid {kind}, term string, df bigint, w double"), post, k, ranges)
        else:
            found = self._many_words(queries, k, ranges)
        return self._keyed(found, k, len(some) * k <= MOST_VALUES)

    def _weights(self, asked: list[tuple]) -> list[tuple]:
        """asked (qid, term, times) -> (qid, term, df, w) of the terms that some live document has."""
        terms = sorted({t for _, t, _ in asked})
        df: dict[str, int] = {}
        rows = self.store.table("df", self.commit.ids).select("term", "df")
        rows = rows.where(F.col("term").isin(terms)) if len(terms) <= MOST_TERMS else rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
        for r in rows.collect() if terms else []:  # a row for each term and segment
            df[r.term] = df.get(r.term, 0) + r.df
        n = self.commit.n
        return [(q, t, df[t], times * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)) for q, t, times in asked if df.get(t, 0) > 0]

    def _many_words(self, queries: DataFrame, k: int, ranges: list[tuple[int, int]] | None) -> DataFrame:
        """The same for queries that no single process should hold."""
        terms = scratch(lexical.query_terms(queries))
        buckets = [r.b for r in terms.select(blocks.bucket_column("term", BUCKETS).alias("b")).distinct().collect()]
        df = self.store.table("df", self.commit.ids).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        near = within_blocks(ranges)
        post = self.store.blocks(self.commit, buckets, None)
        return self._pruned(scratch(blocks.weighed(terms, df, self.commit.n)), post if near is None else post.where(near), k, ranges)

    def _pruned(self, weights: DataFrame, post: DataFrame, k: int, ranges: list[tuple[int, int]] | None) -> DataFrame:
        inside = within(ranges)
        alive = self.alive if inside is None else lambda rows: self.alive(rows.where(inside))
        return blocks.pruned(weights, post, self.commit.avg_len, k, scratch, alive, self._dead(), ranges)

    def _dead(self) -> DataFrame | None:
        return self.store.table("dead", self.commit.ids).select("doc") if self.commit.dead else None

    def _keyed(self, found: DataFrame, k: int, few: bool) -> DataFrame:
        """found (qid, doc, score), the best and their ties, with keys and ranks; few documents are looked up by number."""
        kind = found.schema["qid"].dataType.simpleString()
        found = found if few else scratch(found)
        some = found.limit(MOST_VALUES + 1).collect()
        keys = self.store.table("chunks", self.commit.ids).select("doc", *KEY)
        if len(some) > MOST_VALUES:
            return lexical.top_k(found.join(keys, "doc").drop("doc"), k, "bm25")
        named = {r.doc: (r.file_path, r.chunk_no) for r in keys.where(F.col("doc").isin(sorted({r.doc for r in some}))).collect()} if some else {}
        ranked, place = [], {}
        for r in sorted(some, key=lambda r: (-round(r.score, 9), named[r.doc])):
            place[r.qid] = place.get(r.qid, 0) + 1
            if place[r.qid] <= k:
                ranked.append((r.qid, *named[r.doc], r.score, place[r.qid], "bm25"))
        return self.spark.createDataFrame(ranked, f"qid {kind}, file_path string, chunk_no int, score double, rank int, source string")

    def batch(self, queries: DataFrame, k: int, mode: str = "hybrid", ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """queries (qid, query[, alpha]) -> (qid, file_path, chunk_no, score, rank, source), all queries in one plan;
        ``ranges`` are those of :meth:`chosen`.  With a ledger each query is a line of it."""
        found = self._ranked(queries, k, mode, ranges)
        if self.ledger:
            found = scratch(found)
            rows = found.join(self.tables["chunks"].select(*KEY, "content"), KEY)
            savings.records(queries, rows, self.file_sizes(), "search", float(int(time.time()))).coalesce(1).write.mode("append").json(self.ledger)
        return found

    def _ranked(self, queries: DataFrame, k: int, mode: str, ranges: list[tuple[int, int]] | None) -> DataFrame:
        inside = within(ranges)
        pick = lambda t: t if inside is None else t.where(inside)
        depth = fusion.DEPTH * k if mode == "hybrid" else k
        if mode == "bm25":
            return self.words(queries, depth, ranges)
        if self.commit.lacks:
            raise ValueError(f"this index was built for words alone: {mode} needs vectors")
        meaning = dense.semantic_topk(queries, pick(self.tables["embedded"]), depth, self.encoder)
        if mode == "semantic":
            return meaning
        with ThreadPoolExecutor(2) as legs:  # neither fills a cluster alone
            meaning = legs.submit(copy_context().run, scratch, meaning)
            words = legs.submit(copy_context().run, self.words, queries, depth, ranges)
            return fusion.hybrid_topk(queries, pick(self._declared(queries)), meaning.result(), words.result(), k)

    def _declared(self, queries: DataFrame) -> DataFrame:
        """Declared names that a symbol of the queries may begin: of few symbols each is a range of the sorted names."""
        symbols = queries.select(F.explode(query_symbols(F.col("query"))).alias("s")).distinct().limit(MOST_RANGES + 1).collect()
        names = self.tables["declared"]
        if len(symbols) > MOST_RANGES:
            return names
        ranges = [F.col("name").between(r.s, r.s + "\U0010ffff") for r in symbols]
        return names.where(functools.reduce(lambda a, b: a | b, ranges, F.lit(False)))

    def _place(self, file_path: str) -> str:
        """A path as the index has it, however it is written."""
        return normalise_path(self.root, file_path) if self.root else file_path

    def _at(self, file_path: str, line: int) -> DataFrame:
        """(file_path, chunk_no, exact): the chunk at a line."""
        return locate.at_line(self.tables["chunks"].where(F.col("file_path") == file_path), line)

    def find_related(self, file_path: str, line: int, k: int = 5, context: int | None = None) -> DataFrame:
        """Chunks of the same language most like the one at a line, without itself, by the vectors that are kept."""
        file_path = self._place(file_path)
        embedded = self.tables["embedded"]
        asked = embedded.where(F.col("file_path") == file_path).join(self._at(file_path, line), KEY)
        row = asked.select(*KEY, "language", "vector").first()
        if row is None:
            return self.search("", k)
        kind = embedded.schema["vector"].dataType.simpleString()
        asked = self.spark.createDataFrame([(0, row.language, row.file_path, row.chunk_no, row.vector)], f"qid int, language string, but_path string, but_no int, vector {kind}")
        same = embedded if row.language is None else embedded.where(F.col("language") == row.language)
        found = dense.semantic_topk(asked, same, k, self.encoder).drop("qid")
        return self._finished(found.collect(), found.schema, "find_related", context)

    def symbol(self, name: str) -> DataFrame:
        return self._symbols([name])

    def _symbols(self, names: list[str]) -> DataFrame:
        """Names are looked for by value, so that sorted files tell which of their parts to read."""
        low = sorted({n.lower() for n in names})
        asked = self.spark.createDataFrame([(n,) for n in low], "name string")
        named = lambda t: self.tables[t].where(F.col("name").isin(low))
        return locate.symbol_among(asked, named("defs"), named("refs"))

    def symbols_at(self, file_path: str, line: int) -> DataFrame:
        file_path = self._place(file_path)
        own = self.tables["defs"].where(F.col("file_path") == file_path)
        names = [r.name for r in self._at(file_path, line).join(own, KEY).select("name").distinct().collect()]
        return self._symbols(names).select("name", F.lit(0).alias("aid"), "role", "kind", "line", *KEY)

    def with_content(self, rows: DataFrame) -> DataFrame:
        """Symbol rows with the chunk each is in."""
        return rows.join(self.tables["chunks"].select(*KEY, "start_line", "end_line", "content"), KEY)

    def stats(self) -> DataFrame:
        chunks = self.tables["chunks"]
        by = chunks.where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
        listed = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
        return chunks.agg(F.countDistinct("file_path").alias("indexed_files"), F.count("*").alias("total_chunks")).crossJoin(listed)

    def file_sizes(self) -> DataFrame:
        """(file_path, size): bytes of each file."""
        return self.tables["manifest"].select(F.col("path").alias("file_path"), "size")

    def log_call(self, found: DataFrame, call: str, ts: float) -> None:
        """Append one line to the savings ledger, if the index has one."""
        if self.ledger:
            savings.record(found, self.file_sizes(), call, ts).coalesce(1).write.mode("append").json(self.ledger)
