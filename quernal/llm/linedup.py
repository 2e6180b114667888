"""Line dedup: an exact set-similarity join over the lines of all documents.

A line is the set of its distinct words (A-Z lower-cased); two lines match where the Jaccard similarity of their sets
is at least ``percent``.  A line is removed if a line that comes earlier, by (doc_id, line number), matches it.

* Words are ordered by rarity.  Counts of all words of all documents are summed into a table of fixed size indexed by
  word hash (an upper bound of a word's count); any total order keeps the join exact, this one puts rare words first.
* Lines with equal sets are found by a partially aggregated group-by; all but the earliest are removed and only the
  earliest goes on.
* Prefix filter: matching lines share one of their first ``n - ceil(t n) + 1`` words.  Prefix words are joined with the
  length filter, the positional filter and a parity-bitmap bound on the overlap in the join condition, so the join's
  output is close to the matches.
* Near copies don't square: first each line meets only the earliest line that shares one of KEYS min-hash values of the
  set with it, and in the prefix join only lines still without a match look for earlier ones.
* Candidates are verified on whole sets, recomputed from the texts that hold them.

Defined cases: lines without a word are never removed and match nothing; a null text stays null; a row with a null
doc_id has no place in the order and stays as it is; rows that repeat a doc_id are one document, whose line n is removed
in all of them; a text whose lines are all removed becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm import kernel
from quernal.llm.scratch import Scratch
from quernal.llm.text import WORD, once, packed, table

SKETCH_BITS = 18
#: Min-hash values of a line's set by which near copies find the earliest of them before the prefix join.
KEYS = 2
#: Rows of (doc_id, line) that are broadcast at most; beyond it the same join is shuffled.
BROADCAST_ROWS = 2_000_000
FAN_IN = 32

_LINE = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("size", pa.int64()), ("bitmap", pa.int64()), ("bitmap2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for _, _, data, offsets in kernel.blocks(batch.column("text")):
            total += np.bincount(_slot(kernel.words(data, offsets).hashes), minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def word_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all words of all texts by hash slot, added up in a tree; the driver gets one array of fixed size."""
    counts = texts.select("text").mapInArrow(_count, "counts binary")
    parts = texts.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        counts = counts.repartition(parts).mapInArrow(_add, "counts binary")
    rows = counts.collect()
    return sum((np.frombuffer(row.counts, np.int64) for row in rows), np.zeros(1 << SKETCH_BITS, np.int64))


class Lines:
    """Distinct words of each line of a block of texts, each line's sorted by the order ``rank`` gives."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray):
        cut = np.flatnonzero(data == 10) + 1
        bounds = np.unique(np.concatenate([offsets, cut]))
        words = kernel.words(data, bounds)
        n = len(bounds) - 1
        owner = np.repeat(np.arange(n), np.diff(words.first))
        key = (rank[_slot(words.hashes)].astype(np.uint64) << np.uint64(32)) | (words.hashes & np.uint64(0xFFFFFFFF))
        order = np.lexsort((key, owner)) if n > 0xFFFF else np.argsort((owner.astype(np.uint64) << np.uint64(48)) | (key & np.uint64(0xFFFFFFFFFFFF)), kind="stable")
        words_in_order, owner = words.hashes[order], owner[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words_in_order[1:] != words_in_order[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, owner = words_in_order[fresh], owner[fresh]
        self.first = np.searchsorted(owner, np.arange(n + 1))
        self.sizes = np.diff(self.first)
        at = bounds[:-1]
        # the text a line is of is the last one that begins at or before it; its number counts from 0 there
        self.text = np.searchsorted(offsets[:-1], at, "right") - 1
        self.number = np.arange(n) - np.searchsorted(at, offsets[:-1])[self.text] if n else np.zeros(0, np.int64)


def _lines(rank, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank.value
        for batch in batches:
            for row, stop, data, offsets in kernel.blocks(batch.column("text")):
                x = Lines(data, offsets, ranks)
                full = np.flatnonzero(x.sizes)
                if not len(full):
                    continue
                sizes, first = x.sizes[full], x.first[full]
                # 128 parity bits: what two sets have in common cancels out, so bits that differ are at most words that do
                bits, high = np.uint64(1) << (x.tokens & np.uint64(63)), (x.tokens & np.uint64(64)) != 0
                sums = [kernel.fold(v, x.first, np.add)[full].view(np.int64) for v in (x.tokens, kernel.mix(x.tokens + np.uint64(77)))]
                bitmap, bitmap2 = (kernel.fold(np.where(high == side, bits, np.uint64(0)), x.first, np.bitwise_xor)[full].view(np.int64) for side in (False, True))
                length = sizes - (percent * sizes + 99) // 100 + 1
                ends = np.cumsum(length)
                pick = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(first, length)
                tokens = x.tokens[pick]
                starts = np.concatenate([[0], ends]).astype(np.int32)
                ids = batch.column("doc_id")[row:stop].take(pa.array(x.text[full]))
                keys = np.stack([kernel.fold(kernel.mix(x.tokens + np.uint64(1001 + i)), x.first, np.minimum)[full] + np.uint64(i) for i in range(KEYS)], axis=1)
                columns = [ids, pa.array(x.number[full]), pa.array(sums[0]), pa.array(sums[1]), pa.array(sizes), pa.array(bitmap), pa.array(bitmap2), pa.ListArray.from_arrays(starts, tokens.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, KEYS * len(full) + 1, KEYS, dtype=np.int32), keys.ravel().view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=_LINE)

    return run


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank = np.zeros(1 << SKETCH_BITS, np.uint16)
    for batch in batches:
        for row, stop, data, offsets in kernel.blocks(batch.column("text")):
            x = Lines(data, offsets, rank)
            full = np.flatnonzero(x.sizes)
            own = pa.array([np.sort(x.tokens[x.first[i] : x.first[i + 1]]).tobytes() for i in full], pa.binary())
            ids = batch.column("doc_id")[row:stop].take(pa.array(x.text[full]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(x.number[full]), own], names=["doc_id", "line", "tokens"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, at), (right, to) = (kernel.binaries(batch.column(side)) for side in ("left", "right"))
            both = kernel.common(left, at, right, to)
            good = 100 * both >= percent * (np.diff(at) + np.diff(to) - both)
            yield batch.select(["yd", "yl"]).filter(pa.array(good))

    return run


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


class _Verifier:
    def __init__(self, texts: DataFrame, percent: int, scratch: Scratch):
        self.texts, self.percent, self.scratch = texts, percent, scratch

    def matched(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (xd, xl, yd, yl) -> the (doc_id, line) of each y that matches its x."""
        pairs = self.scratch.table(pairs, f"{name}-pairs")
        ends = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).unionByName(pairs.select(F.col("yd").alias("d"), F.col("yl").alias("l")))
        lines = self.scratch.table(ends.distinct(), f"{name}-lines")
        docs = self.scratch.table(lines.select("d").distinct(), f"{name}-docs")
        held = self.texts.join(_small(docs), F.col("doc_id") == F.col("d"), "left_semi")
        sets = held.mapInArrow(_line_sets, "doc_id long, line long, tokens binary").join(_small(lines), F.expr("doc_id = d and line = l"), "left_semi")
        sets = self.scratch.table(sets.distinct(), f"{name}-sets")
        x, y = sets.select(F.col("doc_id").alias("ad"), F.col("line").alias("al"), F.col("tokens").alias("left")), sets.select(F.col("doc_id").alias("bd"), F.col("line").alias("bl"), F.col("tokens").alias("right"))
        both = pairs.join(x, F.expr("xd = ad and xl = al")).join(y, F.expr("yd = bd and yl = bl")).select("yd", "yl", "left", "right")
        found = both.mapInArrow(_confirm(self.percent), "yd long, yl long").distinct().select(F.col("yd").alias("doc_id"), F.col("yl").alias("line"))
        found = self.scratch.table(found, f"{name}-found")
        for done in ("pairs", "lines", "docs", "sets"):
            self.scratch.drop(f"{name}-{done}")
        return found


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with doc_id and text -> (doc_id, line) of the lines that an earlier line matches; lines count from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # 16-bit ranks, monotone in the count
    rank = spark.sparkContext.broadcast((np.log2(word_counts(texts) + 1.0) * 1000).astype(np.uint16))
    schema = "doc_id long, line long, set_a long, set_b long, size long, bitmap long, bitmap2 long, prefix array<long>, keys array<long>"
    lines = scratch.table(texts.mapInArrow(_lines(rank, percent), schema), "lines")
    equal = lines.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "line")).alias("e"), F.count("*").alias("n")).where("n > 1")
    # written, here and below, so that the join shuffles both sides itself and the engine can split a very common key
    equal = scratch.table(equal.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "e"), "equal")
    copies = lines.join(equal, F.expr("set_a = a and set_b = b and (doc_id > e.doc_id or (doc_id = e.doc_id and line > e.line))")).select("doc_id", "line").distinct()
    copies = scratch.table(copies, "copies")
    first = lines.join(_small(copies.withColumnsRenamed({"doc_id": "cd", "line": "cl"})), F.expr("doc_id = cd and line = cl"), "left_anti")
    verify = _Verifier(texts, percent, scratch)

    alike = f"""100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)
        and {100 + percent} * (x.size + y.size - bit_count(x.bitmap ^ y.bitmap) - bit_count(x.bitmap2 ^ y.bitmap2)) >= {2 * percent} * (x.size + y.size)"""
    earlier = "(x.doc_id < y.doc_id or (x.doc_id = y.doc_id and x.line < y.line))"
    named = [F.col("x.doc_id").alias("xd"), F.col("x.line").alias("xl"), F.col("y.doc_id").alias("yd"), F.col("y.line").alias("yl")]

    keyed = first.select(F.explode("keys").alias("key"), "doc_id", "line", "size", "bitmap", "bitmap2")
    hubs = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "line", "size", "bitmap", "bitmap2")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", "h.*")
    hubs = scratch.table(hubs, "hubs")
    pairs = hubs.alias("x").join(keyed.alias("y"), F.expr(f"x.key = y.key and {earlier} and {alike}")).select(*named).distinct()
    found = verify.matched(pairs, "hubs")

    known = _small(found.withColumnsRenamed({"doc_id": "fd", "line": "fl"}))
    entries = first.join(known, F.expr("doc_id = fd and line = fl"), "left")
    # packed, since they are what is shuffled: place is the line and whether it still has no match, span size and position
    entries = entries.select("doc_id", "line", "size", "bitmap", "bitmap2", F.col("fd").isNull().cast("long").alias("open"), F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("token", "doc_id", (F.col("line") * 2 + F.col("open")).alias("place"), F.shiftleft("size", 32).bitwiseOR(F.col("pos").cast("long")).alias("span"), "bitmap", "bitmap2")
    # every column is read on both sides, so that both share one shuffle; hence also the test of y's open flag with x's
    size, pos = lambda t: f"shiftright({t}.span, 32)", lambda t: f"({t}.span & 4294967295)"
    packed_alike = alike.replace("x.size", size("x")).replace("y.size", size("y"))
    near = f"""x.token = y.token and (x.doc_id < y.doc_id or (x.doc_id = y.doc_id and x.place < y.place - 1)) and (x.place & 1) + 2 * (y.place & 1) >= 2 and {packed_alike}
        and {100 + percent} * least({size("x")} - {pos("x")}, {size("y")} - {pos("y")}) >= {percent} * ({size("x")} + {size("y")})"""
    packed_named = [F.col("x.doc_id").alias("xd"), F.shiftright("x.place", 1).alias("xl"), F.col("y.doc_id").alias("yd"), F.shiftright("y.place", 1).alias("yl")]
    distance = F.expr("bit_count(x.bitmap ^ y.bitmap) + bit_count(x.bitmap2 ^ y.bitmap2)").cast("int").alias("distance")
    pairs = scratch.table(entries.alias("x").join(entries.alias("y"), F.expr(near)).select(*packed_named, distance).distinct(), "candidates")
    # a line needs one match: the likeliest candidate first, the others only for lines that it leaves
    likeliest = pairs.groupBy("yd", "yl").agg(F.min(F.struct("distance", "xd", "xl")).alias("best")).select("best.xd", "best.xl", "yd", "yl")
    later = verify.matched(likeliest, "best")
    done = later.withColumnsRenamed({"doc_id": "fd", "line": "fl"})
    rest = pairs.join(done, F.expr("yd = fd and yl = fl"), "left_anti").select("xd", "xl", "yd", "yl")
    later = later.unionByName(verify.matched(rest, "rest"))
    for done in ("candidates", "lines", "equal", "hubs"):
        scratch.drop(done)
    return copies.unionByName(found).unionByName(later).distinct()


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with doc_id and text -> (row, text, n_lines, removed): texts without their removed lines.

    ``row`` packs every column of docs; ``removed`` lists line numbers from 0, in order.
    """
    gone = removed_lines(docs, percent)
    gone = Scratch(docs.sparkSession).table(gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone")
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("whole"))
    # a document may have lost any number of lines: what is broadcast is bounded by lines, not by rows
    lost = gone.agg(F.count("*") + F.sum(F.size("gone"))).first()[0] or 0
    rows = rows.join(F.broadcast(gone) if lost <= BROADCAST_ROWS else gone, F.col("id") == F.col("gone_id"), "left")
    # cut once, and what stays found by a set difference: linear in the lines, however many of them go
    rows = rows.select("row", "whole", "gone", once(F.split("whole", "\n")).alias("parts"))
    stays = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("parts").cast("long") - 1), "gone")
    left = F.array_join(F.transform(stays, lambda i: F.get("parts", i.cast("int"))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(left)
    n_lines = F.when(F.col("whole").isNull(), 0).otherwise(F.size("parts")).cast("long")
    return rows.select("row", text.alias("text"), n_lines.alias("n_lines"), F.coalesce("gone", F.array().cast("array<long>")).alias("removed"))


def strip(docs: DataFrame, percent: int = 80, keep_emptied: bool = True) -> DataFrame:
    """docs with their removed lines gone from ``text``, and no other change to columns; documents that have no word left
    because of that go too unless ``keep_emptied``."""
    done = dedup_lines(docs, percent)
    if not keep_emptied:
        done = done.select("row", once(F.col("text")).alias("text"), "removed").where((F.size("removed") == 0) | F.col("text").rlike(WORD))
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document with its later matching lines removed."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "text")
