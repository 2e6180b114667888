"""Embeddings: encoders to sparse unit vectors, exact similarity search of a batch of queries.

A stated set of queries is compared with all vectors in blocks: its matrix is broadcast, each task multiplies slices of
its vectors with it and sends on only the best k of all its vectors, so what is shuffled is a few rows for each query and
task.  Queries that are limited to a language are multiplied with its vectors only.  Products are single ones, whose error
is bounded; what may be among the best by that bound gets its score in doubles.  More than MOST_SHARED queries take several
passes over the vectors, so that driver and tasks hold no more of them at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.functions import batches
from quernal.functions.tokens import tokenize
from quernal.operators.lexical import KEY, top_k
from quernal.plans.storage import scratch

BUCKETS = 256
VECTOR = "array<struct<bucket:int,weight:double>>"
#: Identifiers whose buckets a task remembers, some 20 bytes each.
REMEMBERED = 200_000
#: Queries and vectors that are multiplied at once.
MOST_QUERIES, ROWS = 512, 2048
#: Queries of one pass over the vectors, about: they go through the driver and to all tasks, 2 kB each.
MOST_SHARED = 32_768
#: Pairs of a block whose scores are made one by one; beyond it the rows of their queries are multiplied once more, in doubles.
FEW = 4096


class Encoder(Protocol):
    """The extension point: texts to sparse unit vectors of ``size`` places."""

    size: int

    def encode(self, rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
        """rows -> (keys..., vector): one row for each, an empty vector for a text without tokens."""


def _buckets(word: bytes) -> bytes:
    """A byte for each token of an identifier."""
    word = word.lstrip(b"0123456789")
    return bytes(md5(token.encode(), usedforsecurity=False).digest()[0] for token in batches.split(word.decode())) if word else b""


def _hashed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, sizes, buckets = pa.array([], pa.binary()), np.zeros(0, np.int64), b""
    for part in batches.texts(found):
        rows, words, distinct = batches.words(part.column("text"))
        place = pc.index_in(distinct, known)
        new = distinct.filter(pc.is_null(place))
        own = [_buckets(word) for word in new.to_pylist()]
        number = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[pc.is_null(place).to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(new))
        all_sizes, all_buckets = np.concatenate([sizes, np.array([len(o) for o in own], np.int64)]), buckets + b"".join(own)
        first, word = np.cumsum(all_sizes) - all_sizes, number[words]
        times = all_sizes[word]
        at = np.repeat(first[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        cells = np.repeat(rows, times) * BUCKETS + np.frombuffer(all_buckets, np.uint8)[at]
        counts = np.bincount(cells, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS)
        row, bucket = np.nonzero(counts)
        norms = np.sqrt((counts * counts).sum(axis=1))
        values = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(counts[row, bucket] / norms[row])], names=["bucket", "weight"])
        offsets = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(offsets, values)], names=["key", "vector"])
        if len(new) and len(known) < REMEMBERED:  # the first ones of a task are the frequent ones
            known = pa.concat_arrays([known, new.slice(0, REMEMBERED - len(known))])
            sizes = all_sizes[: len(known)]
            buckets = all_buckets[: sizes.sum()]


class HashEncoder:
    """Counts of tokens by the first byte of their MD5, scaled to length one."""

    size = BUCKETS

    def encode(self, rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
        slim = rows.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))
        return slim.mapInArrow(_hashed, f"key {slim.schema['key'].dataType.simpleString()}, vector {VECTOR}").select("key.*", "vector")


class TableEncoder:
    """Mean of token vectors from a table (term, vector array<double>) of ``size`` places, scaled to length one."""

    def __init__(self, vectors: DataFrame, size: int):
        self.vectors, self.size = vectors, size

    @classmethod
    def load(cls, spark, path: str) -> TableEncoder:
        """A static embedding model kept as Parquet: rows (term, vector), all vectors of one length."""
        vectors = spark.read.parquet(path).select(F.lower("term").alias("term"), F.col("vector").cast("array<double>").alias("vector"))
        sizes = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if not sizes[0] or sizes[0] != sizes[1]:
            raise ValueError(f"not a table of equally long vectors: {path}")
        return cls(vectors.dropDuplicates(["term"]), sizes[0])

    def encode(self, rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
        named = rows.select(F.struct(*keys).alias("key"), F.col(text).alias("text")).distinct()
        tokens = named.select("key", F.explode(tokenize("text")).alias("term")).join(self.vectors, "term")
        sums = tokens.select("key", F.posexplode("vector").alias("bucket", "x")).groupBy("key", "bucket").agg(F.sum("x").alias("c"))
        lists = sums.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("v"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
        scaled = F.when(F.col("norm") > 0, F.transform("v", lambda x: F.struct(x["bucket"].alias("bucket"), (x["c"] / F.col("norm")).alias("weight"))))
        found = lists.select(F.col("key").alias("known"), scaled.alias("v"))
        return named.join(found, F.col("key") == F.col("known"), "left").select("key.*", F.coalesce("v", F.array().cast(VECTOR)).alias("vector"))


class SubwordEncoder:
    """Static embeddings of subwords: a text's words are cut by greedy longest match over a vocabulary, and the vectors of
    the pieces, times their weights, are averaged and scaled to length one.  A word that isn't in the vocabulary gets the
    vector of its parts; characters that no piece begins with are passed over.

    The vocabulary is held by every task, so its size is checked: at most MOST_NUMBERS numbers.
    """

    MOST_NUMBERS = 1 << 27

    def __init__(self, spark, pieces: list[str], vectors: np.ndarray, weights: np.ndarray | None = None):
        if vectors.size > self.MOST_NUMBERS or len(pieces) != len(vectors):
            raise ValueError("a vocabulary of so many numbers isn't held by tasks, or pieces and vectors differ in number")
        self.size = vectors.shape[1]
        scaled = vectors * (weights[:, None] if weights is not None else 1.0)
        number = {}
        for i, piece in enumerate(pieces):
            number.setdefault(piece.lower(), i)
        self.shared = spark.sparkContext.broadcast((number, max(map(len, number), default=0), scaled.astype(np.float32)))

    @classmethod
    def load(cls, spark, path: str) -> SubwordEncoder:
        """A Parquet table (piece, vector[, weight]), vectors of one length."""
        rows = spark.read.parquet(path)
        weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
        rows = rows.select("piece", F.col("vector").cast("array<double>").alias("vector"), weight.alias("weight"))
        n, least, most = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if not n or least != most or not least or n * least > cls.MOST_NUMBERS:
            raise ValueError(f"not a table of equally long vectors that tasks can hold: {path}")
        held = rows.orderBy("piece").toArrow()
        return cls(spark, held.column("piece").to_pylist(), np.array(held.column("vector").to_pylist()), np.array(held.column("weight").to_pylist()))

    @staticmethod
    def cut(word: str, number: dict[str, int], longest: int) -> list[int]:
        """Pieces of a word: at each place the longest that the vocabulary has."""
        out, at = [], 0
        while at < len(word):
            for stop in range(min(len(word), at + longest), at, -1):
                piece = number.get(word[at:stop])
                if piece is not None:
                    out.append(piece)
                    at = stop
                    break
            else:
                at += 1
        return out

    def encode(self, rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
        shared, words_of = self.shared, re.compile(r"[^\W_]+|_").findall

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, longest, vectors = shared.value
            known: dict[str, list[int]] = {}
            for part in batches.parts(found):
                out = []
                for content in part.column("text").to_pylist():
                    pieces: list[int] = []
                    for word in words_of((content or "").lower()):
                        own = known.get(word)
                        if own is None:
                            if len(known) >= batches.REMEMBERED:
                                known.clear()
                            own = known[word] = SubwordEncoder.cut(word, number, longest)
                        pieces += own
                    mean = np.zeros(vectors.shape[1])
                    if pieces:
                        which, times = np.unique(pieces, return_counts=True)
                        mean = times @ vectors[which].astype(np.float64)
                    norm = float(np.sqrt(mean @ mean))
                    out.append([(i, float(x / norm)) for i, x in enumerate(mean)] if norm > 0 else [])
                yield pa.RecordBatch.from_arrays([part.column("key"), batches.structs(out, [("bucket", pa.int32()), ("weight", pa.float64())])], names=["key", "vector"])

        slim = rows.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))
        return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, vector {VECTOR}").select("key.*", "vector")


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    values = vectors.flatten()
    rows = np.repeat(np.arange(len(vectors)), pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False))
    out[rows, values.field("bucket").to_numpy(zero_copy_only=False)] = values.field("weight").to_numpy(zero_copy_only=False)
    return out


class _Asked:
    """Queries of one pass: a matrix in order of their languages, the range of it that is limited to each language (None:
    to none), and the chunks that queries are not to find."""

    def __init__(self, asked: pa.Table, size: int):
        limits = [asked.column(c).to_pylist() for c in ("language", "but_path", "but_no")] if "language" in asked.column_names else [[None] * len(asked)]
        order = sorted(range(len(asked)), key=lambda i: (limits[0][i] is not None, limits[0][i] or ""))
        asked = asked.take(pa.array(order, pa.int64())).combine_chunks()
        self.qids, self.matrix = asked.column("qid").combine_chunks(), _matrix(asked.column("vector").combine_chunks(), size)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix))
        self.ranges: dict[str | None, tuple[int, int]] = {}
        self.hidden: dict[tuple, list[int]] = {}
        for place, i in enumerate(order):
            self.ranges[limits[0][i]] = (self.ranges.get(limits[0][i], (place,))[0], place + 1)
            if len(limits) > 1:
                self.hidden.setdefault((limits[1][i], limits[2][i]), []).append(place)


class _Best:
    """The k best rows that a task has met for each query: scores, best first, and places in ``keys``, which are in order, so
    that of equal scores the less place comes first."""

    def __init__(self, queries: int, k: int):
        self.k, self.keys = k, None
        self.scores, self.places = np.full((queries, k), -np.inf), np.full((queries, k), -1)

    def meet(self, keys: pa.Table) -> np.ndarray:
        """The places of more keys; those that are no longer among the best are forgotten."""
        held = np.unique(self.places[self.places >= 0])
        every = pa.concat_tables([self.keys.take(pa.array(held)), keys]) if len(held) else keys
        order = pc.sort_indices(every, sort_keys=[(c, "ascending") for c in KEY])
        self.keys = every.take(order).combine_chunks()
        now = np.empty(len(order), np.int64)
        now[order.to_numpy()] = np.arange(len(order))
        there = self.places >= 0
        self.places[there] = now[np.searchsorted(held, self.places[there])]
        return now[len(held) :]

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        touched, of = np.unique(query, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(touched)), self.k), of])
        place, score = np.concatenate([self.places[touched].ravel(), place]), np.concatenate([self.scores[touched].ravel(), score])
        order = np.lexsort((place, -np.round(score, 9), of))
        of, place, score = of[order], place[order], score[order]
        best = np.arange(len(of)) - np.searchsorted(of, np.arange(len(touched)))[of] < self.k
        self.places[touched], self.scores[touched] = place[best].reshape(-1, self.k), score[best].reshape(-1, self.k)


def _candidates(asked: np.ndarray, norms: np.ndarray, vectors: np.ndarray, single: np.ndarray, kth: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs that may come before the query's k-th so far.  Vectors are in order of their keys, so
    of those that tie with the k-th of this slice the first ones do."""
    near = asked.astype(np.float32) @ single.T
    near[hidden] = -np.inf
    # a sum of n single products is off by less than n + 2 roundings of the product of lengths
    error = (asked.shape[1] + 16) * 2.0**-23 * norms * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
    least = np.maximum(np.round(kth, 9) - error - 2e-9, np.finfo(np.float32).min).astype(np.float32)
    touched = np.flatnonzero(near.max(axis=1) >= least)
    hit = near[touched] >= least[touched, None]
    if np.count_nonzero(hit) <= FEW:
        query, row = np.nonzero(hit)
        return touched[query], row, np.einsum("ij,ij->i", asked[touched[query]], vectors[row])
    scores = asked[touched] @ vectors.T
    scores[~hit] = -np.inf
    if k < scores.shape[1]:
        rounded = np.round(scores, 9)
        last = np.partition(rounded, -k, axis=1)[:, -k, None]
        above, tied = rounded > last, rounded == last
        hit = above | tied & (np.cumsum(tied, axis=1) <= k - np.count_nonzero(above, axis=1)[:, None])
    query, row = np.nonzero(hit & np.isfinite(scores))
    return touched[query], row, scores[query, row]


def _nearest(shared, size: int, k: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = shared.value
        best = _Best(len(asked.matrix), k)
        for batch in found:
            if not len(batch):
                continue
            places = best.meet(pa.Table.from_batches([batch.select(list(KEY))]))
            order = np.argsort(places)  # rows by their keys
            hidden = [(place, i) for place, key in zip(places.tolist(), zip(*(batch.column(c).to_pylist() for c in KEY), strict=True), strict=True) for i in asked.hidden.get(key, ())] if asked.hidden else []
            hidden_places, hidden_queries = np.array(hidden, np.int64).reshape(-1, 2).T
            languages = np.array(batch.column("language").to_pylist(), object) if "language" in batch.schema.names else None
            for language, (begin, end) in asked.ranges.items():
                own = order if language is None else order[languages[order] == language]
                for start in range(0, len(own), ROWS):
                    rows = places[own[start : start + ROWS]]
                    vectors = _matrix(batch.column("vector").take(pa.array(own[start : start + ROWS])), size)
                    single = vectors.astype(np.float32)
                    at = np.minimum(np.searchsorted(rows, hidden_places), len(rows) - 1)
                    inside = rows[at] == hidden_places
                    for first in range(begin, end, MOST_QUERIES):
                        block = slice(first, min(end, first + MOST_QUERIES))
                        mine = inside & (hidden_queries >= block.start) & (hidden_queries < block.stop)
                        query, row, score = _candidates(asked.matrix[block], asked.norms[block], vectors, single, best.scores[block, -1], (hidden_queries[mine] - first, at[mine]), k)
                        best.add(query + first, rows[row], score)
        for first in range(0, len(asked.matrix) if best.keys is not None else 0, MOST_QUERIES):
            query, place = np.nonzero(best.places[first : first + MOST_QUERIES] >= 0)
            keys = best.keys.take(pa.array(best.places[first + query, place]))
            yield pa.RecordBatch.from_arrays([asked.qids.take(pa.array(first + query)), *(c.combine_chunks() for c in keys.columns), pa.array(best.scores[first + query, place])], names=["qid", *KEY, "score"])

    return run


def semantic_topk(queries: DataFrame, embedded: DataFrame, k: int, encoder: Encoder | None = None, stored: bool = False) -> DataFrame:
    """queries (qid, query), embedded (file_path, chunk_no, vector) -> the k most similar chunks of each query, always
    min(k, n) of them: chunks that share nothing score 0.

    If queries have ``language``, ``but_path`` and ``but_no``, only chunks of that language (any, where it is null) and
    not that chunk are found, and embedded needs a ``language``.  Queries that have their ``vector`` need no text.
    ``stored`` says that embedded is a table already, which several passes may read.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    encoder = encoder or HashEncoder()
    limits = [c for c in ("language", "but_path", "but_no") if c in queries.columns]
    columns = [*KEY, "vector", *(["language"] if limits else [])]
    asked = queries.select("qid", *limits, "vector") if "vector" in queries.columns else encoder.encode(queries, "query", ["qid", *limits])
    kinds = {f.name: f.dataType.simpleString() for f in [*embedded.schema, *asked.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("qid", *KEY)) + ", score double"

    def share(some: pa.Table):
        return queries.sparkSession.sparkContext.broadcast(_Asked(some, encoder.size))

    def ranked(shared) -> DataFrame:
        return top_k(embedded.select(*columns).mapInArrow(_nearest(shared, encoder.size, k), schema), k, "semantic")

    most = max(1, MOST_SHARED * BUCKETS // max(BUCKETS, encoder.size, k))  # longer vectors, or more results: fewer at once
    some = asked.limit(most + 1).toArrow()
    if some.num_rows <= most:
        return ranked(share(some))
    asked = scratch(asked)  # texts are encoded once, not in each pass
    if not stored:
        embedded = scratch(embedded.select(*columns))
    passes = -(-asked.count() // most)
    of_pass, found = F.pmod(F.xxhash64("qid"), F.lit(passes)), []
    for i in range(passes):
        shared = share(asked.where(of_pass == i).toArrow())
        found.append(scratch(ranked(shared)))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found)
