"""BM25: term frequencies, lengths, inverse document frequencies, scores, top-k.

A chunk is analysed once, in its row: its terms with their frequencies and its length.  Postings are those lists laid
out, so building an index shuffles nothing.  Scoring touches only postings of the queries' terms, and top-k is a ranked
window that the engine limits before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernal.functions import batches
from quernal.functions.tokens import path_stem, tokenize

KEY = ("file_path", "chunk_no")
K1, B = 1.5, 0.75
#: Pairs of a query and a term that are broadcast at most (some 60 bytes each); beyond it they are joined by shuffling.
BROADCAST_TERMS = 200_000
#: Queries times chunks that are scored at once in a task (8 bytes each, a few times over).
CELLS = 1 << 19


def _analyse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = batches.Tokens()
    for part in batches.parts(found):
        terms, lengths = [], []
        for content, stem in zip(part.column("content").to_pylist(), part.column("stem").to_pylist(), strict=True):
            counts = tokens.count(content)
            for token, n in tokens.count(stem).items():
                counts[token] += 2 * n  # the lexical index reads the file's stem twice, behind the content
            terms.append(list(counts.items()))
            lengths.append(sum(counts.values()))
        listed = batches.structs(terms, [("term", pa.string()), ("tf", pa.int64())])
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(lengths, pa.int64()), listed], names=["key", "len", "terms"])


def analysed(chunks: DataFrame, stems: bool = True) -> DataFrame:
    """(file_path, chunk_no, len, terms array<struct<term, tf>>), one row for each chunk; ``stems`` counts those of files."""
    stem = path_stem("file_path") if stems else F.lit(None).cast("string")
    rows = chunks.select(F.struct(*KEY).alias("key"), "content", stem.alias("stem"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_analyse, f"key {kind}, len bigint, terms array<struct<term:string,tf:bigint>>").select("key.*", "len", "terms")


def postings(analysed: DataFrame) -> DataFrame:
    """(term, file_path, chunk_no, tf, len): one row for each term of each chunk."""
    return analysed.select(*KEY, "len", F.inline("terms")).select("term", *KEY, "len", "tf")


def doc_lengths(analysed: DataFrame) -> DataFrame:
    return analysed.select(*KEY, "len")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avg_len); chunks without tokens count."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def term_idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, mult): a term counts as often as the query has it."""
    return queries.select("qid", F.explode(tokenize("query")).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("mult"))


def bm25_scores(queries: DataFrame, post: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, file_path, chunk_no, score) of the chunks with a term of the query."""
    terms = query_terms(queries)
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda rows: rows
    wanted = post.join(small(terms.select("term").distinct()), "term", "left_semi")
    idf = term_idf(wanted, stats).select("term", "idf")
    hit = post.join(small(terms.join(idf, "term")), "term").crossJoin(F.broadcast(stats.select("avg_len")))
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    return hit.groupBy("qid", *KEY).agg(F.sum(F.col("mult") * F.col("idf") * tf * (K1 + 1) / (tf + norm)).alias("score"))


def top_k(scores: DataFrame, k: int, source: str) -> DataFrame:
    """The best k of each query, ranked from 1 by (score descending, key); ties within 1e-9 go by key."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), *KEY)
    return scores.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k).withColumn("source", F.lit(source))


def _met(part: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among terms, tf) of the postings of the given terms."""
    lists = part.column("terms")
    values = lists.flatten()
    found = pc.index_in(values.field("term"), terms)
    there = pc.is_valid(found).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return rows[there], found.drop_null().to_numpy(), values.field("tf").to_numpy(zero_copy_only=False)[there]


def _slices(found: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def bm25_best(queries: DataFrame, analysed: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """The same as :func:`bm25_topk`, from chunks as :func:`analysed` has them: each task scores its chunks for all queries
    and sends on the k best (and ties) of every few, so no posting is a row.  Queries of more terms than tasks should hold are joined."""
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = query_terms(queries).limit(BROADCAST_TERMS + 1).collect()
    if len(asked) > BROADCAST_TERMS:
        return bm25_topk(queries, postings(analysed), stats, k)
    spark, kind = analysed.sparkSession, queries.schema["qid"].dataType.simpleString()
    n, avg_len = stats.select("n", "avg_len").first()
    terms, qids = sorted({r.term for r in asked}), list(dict.fromkeys(r.qid for r in asked))
    shared = spark.sparkContext.broadcast(pa.array(terms, pa.string()))

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value), np.int64)
        for part in _slices(found, 1000):
            df += np.bincount(_met(part, shared.value)[1], minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "df"])

    each = analysed.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")) if terms else None
    df = np.zeros(len(terms))
    for r in each.collect() if terms else []:
        df[r.term] = r.df
    place, number = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(qids)}
    listed = sorted((place[r.term], number[r.qid], r.mult) for r in asked)
    of = np.array([t for t, _, _ in listed], np.int64)
    weights = np.array([m for _, _, m in listed]) * np.log((n - df[of] + 0.5) / (df[of] + 0.5) + 1)
    held = spark.sparkContext.broadcast((np.array([q for _, q, _ in listed], np.int64), weights, np.searchsorted(of, np.arange(len(terms) + 1)), len(qids)))

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_of, weight, first, n_queries = held.value
        for part in _slices(found, max(1, CELLS // n_queries)):
            row, term, tf = _met(part, shared.value)
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * part.column("len").to_numpy()[row] / avg_len))
            times = np.diff(first)[term]
            at = np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
            scores = np.bincount(query_of[at] * len(part) + np.repeat(row, times), np.repeat(gain, times) * weight[at], n_queries * len(part)).reshape(n_queries, -1)
            rounded = np.round(scores, 9)
            cut = np.partition(rounded, -k, axis=1)[:, -k] if k < len(part) else np.zeros(n_queries)
            query, best = np.nonzero((rounded >= cut[:, None]) & (scores > 0))
            keys = [part.column(c).take(pa.array(best)) for c in KEY]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), *keys, pa.array(scores[query, best], pa.float64())], names=["no", *KEY, "score"])

    kinds = dict(analysed.dtypes)
    columns = ", ".join(f"{c} {kinds[c]}" for c in KEY)
    if not terms:
        return top_k(spark.createDataFrame([], f"qid {kind}, {columns}, score double"), k, "bm25")
    found = analysed.select(*KEY, "len", "terms").mapInArrow(score, f"no int, {columns}, score double")
    names = F.broadcast(spark.createDataFrame(list(enumerate(qids)), f"no int, qid {kind}"))
    return top_k(found.join(names, "no").select("qid", *KEY, "score"), k, "bm25")


def bm25_topk(queries: DataFrame, post: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    return top_k(bm25_scores(queries, post, stats).where("score > 0"), k, "bm25")
