"""Posting blocks and exact top-k over them that leaves most postings unread.

Documents have whole numbers, and every 2**SHIFT of them in a row are a range.  A block holds what one term has in one
range: the documents (as offsets in the range), term frequencies and lengths, and what bounds its scores, the greatest
frequency and the least length.  Blocks are built where the documents are, in order of their numbers, so no posting is
shuffled; they are stored in buckets by a hash of the term, so that a query reads the buckets of its terms alone.

:func:`exhaustive` scores every posting of the queries' terms, :func:`gathered` does so in numpy, where blocks of a range
meet as they are: some ten times as fast, and no posting is a row that is shuffled.  :func:`pruned` gives the same top k (Turtle and Flood's MaxScore, with Ding and
Suel's block bounds, as joins): documents of a query's strongest terms are scored whole first, and the k-th of these scores
is a threshold.  Terms that together can't reach it are no reason to look at a document, so only postings of the others are
read, but for blocks whose own bound falls short; what the left-out terms add is looked up only for documents that may
still get there.  A query of which that would leave out little is scored exhaustively.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernal.functions import batches
from quernal.functions.tokens import path_stem
from quernal.operators.lexical import K1, B

SHIFT = 10
SCHEMA = "term string, range bigint, n int, most_tf int, least_len int, docs array<int>, tfs array<int>, lens array<int>"
#: Postings of a query's strongest terms, for each wanted result, that the first threshold comes from; documents of them
#: that are scored whole, for each wanted result.
SEED_POSTINGS, SEED_DOCS = 50, 4
#: How many times as many postings a query has as pruning leaves, for it to be pruned.
WORTH = 3
#: Queries times documents that are scored at once in a task (8 bytes each, a few times over).
CELLS = 1 << 19
#: Weights of queries' terms that every task holds when documents are pruned (some 200 bytes each); more meet in joins.
MOST_HELD = 500_000
#: Scores that differ by less are equal, as everywhere in ranking.
SLACK = 1e-9

Alive = Callable[[DataFrame], DataFrame]


def bucket_of(term: str, buckets: int) -> int:
    return crc32(term.encode()) % buckets


def bucket_column(term: str | Column, buckets: int) -> Column:
    """The same as an expression."""
    return (F.crc32((F.col(term) if isinstance(term, str) else term).cast("binary")) % buckets).cast("int")


def _flushed(number: int, held: dict[str, tuple[list[int], list[int]]], lengths: np.ndarray) -> pa.RecordBatch:
    sizes = np.fromiter((len(docs) for docs, _ in held.values()), np.int64, len(held))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    docs = np.fromiter(chain.from_iterable(docs for docs, _ in held.values()), np.int32, int(offsets[-1]))
    tfs = np.fromiter(chain.from_iterable(tfs for _, tfs in held.values()), np.int32, int(offsets[-1]))
    lens = lengths[docs]
    listed = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)) for values in (docs, tfs, lens)]
    columns = [pa.array(list(held)), pa.array(np.full(len(held), number)), pa.array(sizes.astype(np.int32)), pa.array(np.maximum.reduceat(tfs, offsets[:-1])), pa.array(np.minimum.reduceat(lens, offsets[:-1]))]
    return pa.RecordBatch.from_arrays([*columns, *listed], names=["term", "range", "n", "most_tf", "least_len", "docs", "tfs", "lens"])


def _blocks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, current, held = batches.Tokens(), None, {}
    lengths = np.zeros(1 << SHIFT, np.int32)
    for part in batches.parts(found):
        for doc, content, stem in zip(*(part.column(c).to_pylist() for c in ("doc", "content", "stem")), strict=True):
            if doc >> SHIFT != current:
                if held:
                    yield _flushed(current, held, lengths)
                current, held = doc >> SHIFT, {}
            counts = tokens.count(content)
            for token, n in tokens.count(stem).items():
                counts[token] += 2 * n  # the lexical index reads the file's stem twice, behind the content
            at = doc & (1 << SHIFT) - 1
            lengths[at] = sum(counts.values())
            for token, n in counts.items():
                got = held.get(token)
                if got is None:
                    held[token] = ([at], [n])
                else:
                    got[0].append(at)
                    got[1].append(n)
    if held:
        yield _flushed(current, held, lengths)


def built(chunks: DataFrame) -> DataFrame:
    """chunks (doc, file_path, content), best in order of doc -> blocks; documents out of order only make more of them."""
    return chunks.select("doc", "content", path_stem("file_path").alias("stem")).mapInArrow(_blocks, SCHEMA)


def n_tokens(blocks: DataFrame) -> Column:
    """The tokens of a block, of which a corpus's sum gives the average length."""
    return F.aggregate("tfs", F.lit(0).cast("bigint"), lambda total, tf: total + tf)


def impact(tf: Column, length: Column, avg_len: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (avg_len or 1.0)))


def weighed(terms: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """terms (qid, term, mult) and df (term, df) -> (qid, term, df, w): what a term's impact counts in its query."""
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.join(df.where("df > 0"), "term").select("qid", "term", "df", (F.col("mult") * idf).alias("w"))


def _scored(blocks: DataFrame, weights: DataFrame, avg_len: float, alive: Alive) -> DataFrame:
    """(qid, doc, score) over the postings of the given terms."""
    each = blocks.join(weights, "term").select("qid", "w", "range", F.inline(F.arrays_zip("docs", "tfs", "lens")))
    each = each.select("qid", F.shiftleft("range", SHIFT).bitwiseOR(F.col("docs").cast("bigint")).alias("doc"), (F.col("w") * impact(F.col("tfs"), F.col("lens"), avg_len)).alias("s"))
    return alive(each).groupBy("qid", "doc").agg(F.sum("s").alias("score"))


def best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query and all that tie with the last of them."""
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc())
    return scores.select("*", F.rank().over(order).alias("place")).where(F.col("place") <= k).drop("place")


def exhaustive(weights: DataFrame, blocks: DataFrame, avg_len: float, k: int, alive: Alive = lambda rows: rows) -> DataFrame:
    """(qid, doc, score): see :func:`best`."""
    return best(_scored(blocks, weights, avg_len, alive), k)


class Weights:
    """Weights of the terms of some queries, which every task holds."""

    def __init__(self, rows: list[tuple[object, str, float, bool]], least: dict[object, float] | None = None):
        """rows (qid, term, w, strong); with ``least``, the score that a query's documents must reach, terms that aren't
        strong are no reason to look at a document."""
        terms, qids = sorted({t for _, t, _, _ in rows}), list(dict.fromkeys(q for q, _, _, _ in rows))
        self.terms, self.qids = pa.array(terms, pa.string()), qids
        place, number = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(qids)}
        listed = sorted((place[t], number[q], w, strong) for q, t, w, strong in rows)
        self.queries, self.weights = np.array([q for _, q, _, _ in listed], np.int64), np.array([w for _, _, w, _ in listed])
        self.strong = np.array([strong for _, _, _, strong in listed], bool)
        self.first = np.searchsorted([t for t, _, _, _ in listed], np.arange(len(terms) + 1))
        self.least = None if least is None else np.array([least[q] for q in qids])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, sizes[i] of them."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _impact(tf: np.ndarray, length: np.ndarray, avg_len: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (avg_len or 1.0)))


def _best_of(weights: Weights, held: list[tuple[np.ndarray, ...]], gone: list[np.ndarray], avg_len: float, k: int, ranges: list[tuple[int, int]] | None) -> pa.RecordBatch:
    """The k best documents (and ties) of each query in some blocks (range, term, n, most_tf, least_len and, of all in a
    row, docs, tfs, lens), without those that are ``gone``."""
    number, term, sizes, most_tf, least_len, docs, tfs, lens = (np.concatenate(x) for x in zip(*held, strict=True))
    (there, doc), n, starts = np.unique(docs, return_inverse=True), len(weights.qids), np.cumsum(sizes) - sizes
    impacts = _impact(tfs, lens, avg_len)
    fine = ~np.isin(there, np.concatenate(gone)) if gone else np.ones(len(there), bool)
    if ranges is not None:
        fine &= np.any([(there >= a) & (there <= b) for a, b in ranges], axis=0) if ranges else False
    times = np.diff(weights.first)[term]  # each block counts for all queries of its term
    block, at = np.repeat(np.arange(len(term)), times), _spread(weights.first[term], times)
    if weights.least is not None:  # a query passes over ranges whose blocks together can't reach its least
        ranges_of, own = np.unique(number, return_inverse=True)
        bound = _impact(most_tf, least_len, avg_len)[block] * weights.weights[at]
        cell = weights.queries[at] * len(ranges_of) + own[block]
        hope = np.bincount(cell, bound, n * len(ranges_of)) >= np.repeat(weights.least, len(ranges_of))
        weak = np.bincount(cell, np.where(weights.strong[at], 0.0, bound), n * len(ranges_of)).reshape(n, -1)
        at_doc = np.searchsorted(ranges_of, there >> SHIFT)
        block, at = block[hope[cell]], at[hope[cell]]

    def added(chosen: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Sums over the chosen pairs of a block and a query's term, in cells of queries and documents."""
        of, each = at[chosen], sizes[block[chosen]]
        posting = _spread(starts[block[chosen]], each)
        cell, gain = np.repeat(weights.queries[of] * len(there), each) + doc[posting], np.repeat(weights.weights[of], each) * impacts[posting]
        if only is not None:
            cell, gain = cell[only[cell]], gain[only[cell]]
        return np.bincount(cell, gain, n * len(there)).reshape(n, -1)

    if weights.least is None:
        scores = np.where(fine, added(np.arange(len(at))), 0.0)
    else:
        scores = np.where(fine, added(np.flatnonzero(weights.strong[at])), 0.0)
        scores[scores + weak[:, at_doc] < weights.least[:, None]] = 0.0
        left = np.flatnonzero(~weights.strong[at])
        left = left[(scores > 0).any(axis=1)[weights.queries[at[left]]]]
        if len(left):
            scores += added(left, (scores > 0).ravel())
        scores[scores < weights.least[:, None]] = 0.0
    rounded = np.round(scores, 9)
    cut = np.partition(rounded, -k, axis=1)[:, -k] if k < len(there) else np.zeros(n)
    query, column = np.nonzero((rounded >= cut[:, None]) & (scores > 0))
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(there[column]), pa.array(scores[query, column])], names=["no", "doc", "score"])


def _gathered(shared, avg_len: float, k: int, ranges: list[tuple[int, int]] | None):
    """Blocks in order of their ranges, the dead of a range as one without a term -> the k best documents (and ties) of
    each query among every few ranges."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        most, held, gone, size, last = max(1, CELLS // len(weights.qids)), [], [], 0, None
        for batch in found:
            terms = pc.index_in(batch.column("term"), weights.terms)
            batch = batch.filter(pc.or_(pc.is_valid(terms), pc.is_null(batch.column("term"))))
            if not len(batch):
                continue
            terms = pc.fill_null(pc.index_in(batch.column("term"), weights.terms), -1).to_numpy()
            numbers, n, most_tf, least_len = (batch.column(c).to_numpy() for c in ("range", "n", "most_tf", "least_len"))
            docs, tfs, lens = (batch.column(c).flatten().to_numpy() for c in ("docs", "tfs", "lens"))
            ends = np.cumsum(n)
            # only between ranges can what is held be scored: cut the batch where the range changes
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(numbers)) + 1):
                if numbers[some[0]] != last:
                    if size >= most:
                        if held:
                            yield _best_of(weights, held, gone, avg_len, k, ranges)
                        held, gone, size = [], [], 0
                    size, last = size + (1 << SHIFT), numbers[some[0]]
                at = slice(ends[some[0]] - n[some[0]], ends[some[-1]])
                whole, alive = (numbers[some[0]] << SHIFT) + docs[at], terms[some] >= 0
                posting = np.repeat(alive, n[some])
                if not alive.all():
                    gone.append(whole[~posting])
                if alive.any():
                    held.append((*(x[some][alive] for x in (numbers, terms, n, most_tf, least_len)), *(x[posting] for x in (whole, tfs[at], lens[at]))))
        if held:
            yield _best_of(weights, held, gone, avg_len, k, ranges)

    return run


def _gone(dead: DataFrame) -> DataFrame:
    """Dead documents (doc) as blocks without a term."""
    rows = dead.select(F.shiftright("doc", SHIFT).alias("range"), (F.col("doc") % (1 << SHIFT)).cast("int").alias("at"))
    rows = rows.groupBy("range").agg(F.collect_list("at").alias("docs"))
    none = F.lit(None).cast("string").alias("term")
    return rows.select("range", none, F.size("docs").alias("n"), F.lit(0).alias("most_tf"), F.lit(0).alias("least_len"), "docs", F.col("docs").alias("tfs"), F.col("docs").alias("lens"))


def gathered(weights: Weights, kind: str, blocks: DataFrame, avg_len: float, k: int, dead: DataFrame | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """The same as :func:`exhaustive` for weights that every task can hold, qid of the given type, without the ``dead``
    documents (doc) and within ``ranges``, if there are any.  Only documents with a strong term are found."""
    spark = blocks.sparkSession
    if not weights.qids:
        return spark.createDataFrame([], f"qid {kind}, doc bigint, score double")
    rows = blocks.select("range", "term", "n", "most_tf", "least_len", "docs", "tfs", "lens")
    rows = rows if dead is None else rows.unionByName(_gone(dead))
    rows = rows.repartition("range").sortWithinPartitions("range")
    found = rows.mapInArrow(_gathered(spark.sparkContext.broadcast(weights), avg_len, k, ranges), "no int, doc bigint, score double")
    qids = spark.createDataFrame(list(enumerate(weights.qids)), f"no int, qid {kind}")
    order = Window.partitionBy("no").orderBy(F.round("score", 9).desc())
    found = found.select("*", F.rank().over(order).alias("place")).where(F.col("place") <= k)
    return found.join(F.broadcast(qids), "no").select("qid", "doc", "score")


def _completed(found: DataFrame, weights: DataFrame, blocks: DataFrame, avg_len: float) -> DataFrame:
    """found (qid, doc, score) with what the given terms add to each."""
    asked = found.join(weights.select("qid", "term", "w"), "qid", "left").withColumn("range", F.shiftright("doc", SHIFT))
    at = F.array_position("docs", (F.col("doc") % (1 << SHIFT)).cast("int")).cast("int")
    met = asked.join(blocks.select("term", "range", "docs", "tfs", "lens"), ["term", "range"], "left").select("qid", "doc", "score", "w", "tfs", "lens", at.alias("at"))
    gain = F.when(F.col("at") > 0, F.col("w") * impact(F.get("tfs", F.col("at") - 1), F.get("lens", F.col("at") - 1), avg_len)).otherwise(0.0)
    return met.groupBy("qid", "doc").agg((F.first("score") + F.sum(gain)).alias("score"))


def pruned(weights: DataFrame, blocks: DataFrame, avg_len: float, k: int, table: Callable[[DataFrame], DataFrame], alive: Alive = lambda rows: rows, dead: DataFrame | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """The same as :func:`exhaustive`.  ``table`` writes and reads back what several branches need: a row for each query
    and term, or for each query and document that is looked at.  ``dead`` and ``ranges`` say what ``alive`` leaves out.

    Weights that every task can hold are scored in numpy, as in :func:`gathered`, so that no posting is a row of a join;
    more than MOST_HELD meet the blocks in joins.
    """
    bounds = blocks.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.max(impact(F.col("most_tf"), F.col("least_len"), avg_len)).alias("most"))
    strong = Window.partitionBy("qid").orderBy(F.col("ub").desc(), "term")
    ranked = weights.join(bounds, "term").select("*", (F.col("w") * F.col("most")).alias("ub"))
    ranked = table(ranked.select(
        "*", F.coalesce(F.sum("df").over(strong.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("ub").over(strong.rowsBetween(0, Window.unboundedFollowing)).alias("onward"), F.sum("ub").over(Window.partitionBy("qid")).alias("whole"),
    ))
    seed = F.col("before") < SEED_POSTINGS * k
    first = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    seeds = _scored(blocks, ranked.where(seed), avg_len, alive).select("*", F.row_number().over(first).alias("i")).where(F.col("i") <= SEED_DOCS * k).drop("i")
    seeds = _completed(table(seeds), ranked.where(~seed), blocks, avg_len)
    kth = seeds.select("*", F.row_number().over(first).alias("i")).where(F.col("i") == k).select("qid", (F.col("score") - SLACK * (1 + F.col("score"))).alias("least"))
    ranked = table(ranked.join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0))))
    ranked = ranked.select("*", F.sum("df").over(Window.partitionBy("qid")).alias("all"), F.sum(F.when(F.col("onward") >= F.col("least"), F.col("df")).otherwise(0)).over(Window.partitionBy("qid")).alias("some"))
    reason = (F.col("onward") >= F.col("least")) | (F.col("some") * WORTH > F.col("all"))
    if (held := ranked.select("qid", "term", "w", reason.alias("strong"), "least").limit(MOST_HELD + 1).collect()) and len(held) <= MOST_HELD:
        some = Weights([(r.qid, r.term, r.w, r.strong) for r in held], {r.qid: r.least for r in held})
        return best(table(gathered(some, weights.schema["qid"].dataType.simpleString(), blocks, avg_len, k, dead, ranges)), k)
    enough = F.col("w") * impact(F.col("most_tf"), F.col("least_len"), avg_len) + F.col("whole") - F.col("ub") >= F.col("least")
    met = blocks.join(ranked.where(reason).select("qid", "term", "w", "ub", "whole", "least"), "term").where(enough)
    each = met.select("qid", "w", "range", F.inline(F.arrays_zip("docs", "tfs", "lens")))
    each = each.select("qid", F.shiftleft("range", SHIFT).bitwiseOR(F.col("docs").cast("bigint")).alias("doc"), (F.col("w") * impact(F.col("tfs"), F.col("lens"), avg_len)).alias("s"))
    found = alive(each).groupBy("qid", "doc").agg(F.sum("s").alias("score"))
    rest = ranked.groupBy("qid").agg(F.sum(F.when(~reason, F.col("ub")).otherwise(0.0)).alias("rest"), F.first("least").alias("least"))
    found = table(found.join(rest, "qid").where(F.col("score") + F.col("rest") >= F.col("least")).select("qid", "doc", "score"))
    return best(_completed(found, ranked.where(~reason), blocks, avg_len), k)
