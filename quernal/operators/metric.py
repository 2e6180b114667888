"""Exact nearest neighbours by cosine that skip cells of vectors by the triangle inequality.

The angle between vectors is a metric.  Some PIVOTS vectors are drawn (by a hash of their ids), every vector is put into the
cell of its nearest pivot, and cells are stored in order with how far their vectors are from the pivot, least and most.  A query
at an angle t from a pivot is at least t - most and least - t away from all of its cell.  So the cells nearest by that bound
are looked at first, until they hold k vectors; the k-th of these is a threshold, and only cells whose bound is within it are
looked at afterwards.  What is left out can't be among the k nearest.

Vectors move once, when cells are made; a search sends queries, in blocks of BLOCK that every task holds, and gets back the k
best of each task.  On vectors without any structure no cell is out of reach, and a search is one product with all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernal.plans.storage import scratch

PIVOTS = 256
#: Queries of one block; rows that are compared with it at once.
BLOCK, ROWS = 10_000, 2048
#: Angles and similarities that differ by less are equal.
SLACK = 1e-9


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with 0."""
    lengths, values = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        return values.reshape(len(column), size)
    out = np.zeros((len(column), size))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero stays zero."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score, less id), where scores within SLACK are equal."""
    rounded = np.round(score, 9)
    at = np.flatnonzero(rounded >= np.partition(rounded, -k)[-k]) if len(rounded) > k else np.arange(len(rounded))
    return at[np.lexsort((ids[at], -rounded[at]))][:k]


class Cells:
    """Vectors (vec_id, embedding) in cells; zero vectors are a cell of their own, which is as similar (0) to any query."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS):
        self.spark = vectors.sparkSession
        kept = vectors.select("vec_id", "embedding").where("embedding is not null and vec_id is not null")
        drawn = kept.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("embedding").toArrow().column("embedding").combine_chunks()
        self.size = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
        self.pivots = _unit(_rows(drawn, self.size)) if len(drawn) else np.zeros((0, self.size))
        shared, size = self.spark.sparkContext.broadcast(self.pivots), self.size

        def assign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for start in range(0, len(batch), ROWS):
                    part = batch.slice(start, ROWS)
                    unit = _unit(_rows(part.column("embedding"), size))
                    near = unit @ shared.value.T if len(shared.value) else np.zeros((len(unit), 1))
                    cell = np.where(unit.any(axis=1), near.argmax(axis=1), -1)
                    angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle), part.column("vec_id"), part.column("embedding")], names=["cell", "angle", "vec_id", "embedding"])

        kinds = {c: t for c, t in kept.dtypes}
        rows = kept.mapInArrow(assign, f"cell int, angle double, vec_id {kinds['vec_id']}, embedding {kinds['embedding']}")
        # ranges of cells; a cell of very many vectors takes several parts
        self.table = scratch(rows.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell"))
        self.about = {r.cell: r for r in self.table.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()}
        self.kind = kinds["vec_id"]
        #: The share of (query, vector) pairs that the last search compared.
        self.share = 0.0

    def _bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, vectors in each, the least angle that a query is from a cell's vectors)."""
        cells = np.array(sorted(self.about), np.int64)
        sizes = np.array([self.about[c].n for c in cells.tolist()], np.int64)
        bound = np.zeros((len(asked), len(cells)))
        real = cells >= 0
        if real.any():
            to = _angles(asked, self.pivots[cells[real]])
            least, most = (np.array([getattr(self.about[c], name) for c in cells[real].tolist()]) for name in ("least", "most"))
            bound[:, real] = np.maximum(0, np.maximum(to - most, least - to) - SLACK)
        bound[:, ~real] = np.pi / 2  # zero vectors count as perpendicular
        bound[~asked.any(axis=1)] = 0  # and to a zero query everything does
        return cells, sizes, bound

    def _scanned(self, qids: pa.Array, asked: np.ndarray, cells: np.ndarray, visits: np.ndarray, k: int) -> DataFrame:
        """(no, vec_id, similarity): the best k of each task among the cells that each query visits."""
        wanted = cells[visits.any(axis=0)]
        shared, size = self.spark.sparkContext.broadcast((asked, {int(c): np.flatnonzero(visits[:, i]) for i, c in enumerate(cells.tolist())})), self.size

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, of_cell = shared.value
            for batch in found:
                numbers = batch.column("cell").to_numpy()
                for run_of in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                    for start in range(0, len(run_of), ROWS):
                        part = batch.slice(run_of[start], len(run_of[start : start + ROWS]))
                        queries, ids = of_cell[int(numbers[run_of[0]])], part.column("vec_id").to_numpy()
                        scores = asked[queries] @ _unit(_rows(part.column("embedding"), size)).T
                        best = [_best(score, ids, k) for score in scores]
                        if best:
                            who, at = np.repeat(queries, [len(b) for b in best]), np.concatenate(best)
                            place = np.repeat(np.arange(len(best)), [len(b) for b in best])
                            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(ids[at]), pa.array(scores[place, at])], names=["no", "vec_id", "similarity"])

        rows = self.table.where(F.col("cell").isin(wanted.tolist())).select("cell", "vec_id", "embedding")
        return rows.mapInArrow(run, f"no int, vec_id {self.kind}, similarity double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries (qid, asked) -> (qid, vec_id, similarity, rank), min(k, n) rows each, ties to the less vec_id."""
        if k < 1:
            raise ValueError("k must be at least 1")
        queries = queries.select("qid", "asked").where("asked is not null")
        blocks = -(-queries.count() // BLOCK)
        order = Window.partitionBy("no").orderBy(F.round("similarity", 9).desc(), "vec_id")
        ranked = lambda rows: rows.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
        found, compared, pairs = [], 0, 0
        for i in range(blocks):
            block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow().combine_chunks()
            if not block.num_rows or not self.about:
                continue
            qids, asked = block.column("qid").combine_chunks(), _unit(_rows(block.column("asked").combine_chunks(), self.size))
            cells, sizes, bound = self._bounds(asked)
            near = np.argsort(bound, axis=1, kind="stable")
            # the nearest cells, until those before hold k vectors
            held = np.cumsum(sizes[near], axis=1) - sizes[near]
            visits = np.zeros(bound.shape, bool)
            np.put_along_axis(visits, near, held < k, axis=1)
            first = scratch(ranked(self._scanned(qids, asked, cells, visits, k)).drop("rank"))
            kth = {r.no: r.s for r in first.groupBy("no").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
            reach = np.array([np.arccos(np.clip(kth[q] - 2 * SLACK, -1, 1)) if q in kth else np.pi for q in range(len(asked))])
            more = ~visits & (bound <= reach[:, None] + 2 * SLACK)
            rows = first if not more.any() else first.unionByName(self._scanned(qids, asked, cells, more, k))
            compared, pairs = compared + int(((visits | more) * sizes).sum()), pairs + len(asked) * int(sizes.sum())
            names = self.spark.createDataFrame(pa.table({"no": pa.array(np.arange(len(qids)), pa.int32()), "qid": qids}))
            result = ranked(rows).join(F.broadcast(names), "no").select("qid", "vec_id", "similarity", "rank")
            found.append(result if blocks == 1 else scratch(result))
        self.share = compared / pairs if pairs else 0.0
        if not found:
            return self.spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, vec_id {self.kind}, similarity double, rank int")
        return reduce(DataFrame.unionByName, found)


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries (qid, asked), vectors (vec_id, embedding) -> (qid, vec_id, similarity, rank): exact, for a stated query set."""
    return Cells(vectors).search(queries, k)
