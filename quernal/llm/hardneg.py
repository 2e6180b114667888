"""Hard-negative mining by segment summaries, exact.

Vectors of whole numbers are cut into segments, and of each segment its mean m and its deviation s is kept: of two vectors
the part of the inner product that a segment of w entries gives is w * m1 * m2, give or take w * s1 * s2.  So sums of
products of means and of deviations bound the score of a pair from both sides.  Anchors, a stated set of rows, are compared
with all rows in blocks of BLOCK anchors that every task holds.  In a task

* slices of rows, put in order of their label and first mean, have a summary of their own, the ranges of their segments'
  means and their greatest deviations: an anchor that no row of a slice can interest skips the slice;
* what is left is bounded pair by pair with the segments of each of LEVELS, coarse ones first, as long as that leaves
  fewer than DENSE of the slice's pairs; only pairs that pass are scored exactly.

A pair passes if its upper bound reaches what the anchor needs yet, the least of its windows' lower ends or of the worst
kept score, and its lower bound isn't over the windows' upper ends.  What a task sends on is the best few rows of each
anchor (and window); ties are never cut by anything but the id.

* Rows with a null id, a null label, a null vector, or a null or non-finite entry take no part.  Shorter vectors count as
  filled up with 0.  Rows that agree in id and score count once; of anchors that share an id the least (label, vector) is
  taken.
* Fewer positives or negatives than asked for: all there are.  A table without anchors, or an empty one, gives no rows.
* Columns of other names are ignored, whatever they are called.

Exact mining of a share of all rows compares that share with all rows; on vectors without any structure no bound prunes and
the time is that of the exact products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernal.llm import vectors
from quernal.llm.scratch import Scratch
from quernal.llm.text import table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score times 100 lies between these times the positive's.
LEAST, MOST = 30, 90
SCALE, LIMIT = 256, float(1 << 30)
#: Segments of a vector at each level, coarse ones first; vectors are filled up to a multiple of the last.
LEVELS = (4, 16)
#: Anchors of one pass over the rows; rows of a slice; anchors that meet a slice at once.
BLOCK, ROWS, ANCHORS = 16_384, 1024, 1024
#: The share of a slice's pairs from which on they are scored at once, as one matrix product.
DENSE = 0.1
PAIRS = "anchor_id bigint, vec_id bigint, score bigint"


def whole(column: pa.Array, size: int) -> np.ndarray:
    """floor(256 * x) of each entry, as doubles that hold whole numbers; held to +-2**30."""
    return np.floor(np.clip(SCALE * vectors.dense(column, size), -LIMIT, LIMIT))


class Summary:
    """Vectors with their segments' means and deviations, each scaled by the root of the segment's width."""

    def __init__(self, rows: np.ndarray):
        width = LEVELS[-1]
        self.rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % width)))
        self.levels = []
        for n in LEVELS:
            parts = self.rows.reshape(len(rows), n, -1)
            root = parts.shape[2] ** 0.5
            self.levels.append((parts.mean(axis=2) * root, parts.std(axis=2) * root))

    def take(self, at) -> Summary:
        out = object.__new__(Summary)
        out.rows, out.levels = self.rows[at], [(m[at], s[at]) for m, s in self.levels]
        return out

    def __len__(self) -> int:
        return len(self.rows)


def _slack(a: Summary, b: Summary) -> float:
    """More than rounding can do to a bound; scores are whole numbers."""
    return 0.25 + 1e-12 * float(np.abs(a.rows).max(initial=0)) * float(np.abs(b.rows).max(initial=0)) * a.rows.shape[1]


def interested(anchors: Summary, rows: Summary, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Positions of the anchors that some row of the slice may interest, by the slice's own summary."""
    (m, s), (means, deviations) = anchors.levels[-1], rows.levels[-1]
    low, high, spread = means.min(axis=0), means.max(axis=0), deviations.max(axis=0)
    upper = np.maximum(m * low, m * high).sum(axis=1) + s @ spread
    lower = np.minimum(m * low, m * high).sum(axis=1) - s @ spread
    slack = _slack(anchors, rows)
    return np.flatnonzero((upper + slack >= least) & (lower - slack <= most))


def exact(a: np.ndarray, b: np.ndarray, rowwise: bool) -> np.ndarray:
    """Inner products of whole numbers: in doubles while they are exact, else in Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return np.einsum("ij,ij->i", a, b) if rowwise else a @ b.T
    a, b = a.astype(np.int64).astype(object), b.astype(np.int64).astype(object)
    return (a * b).sum(axis=1) if rowwise else a @ b.T


def passing(anchors: Summary, rows: Summary, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs whose bounds leave them between ``least`` and ``most`` of their anchor."""
    slack = _slack(anchors, rows)
    (m, s), (means, deviations) = anchors.levels[0], rows.levels[0]
    middle, spread = m @ means.T, s @ deviations.T
    a, r = np.nonzero((middle + spread + slack >= least[:, None]) & (middle - spread - slack <= most[:, None]))
    for (m, s), (means, deviations) in zip(anchors.levels[1:], rows.levels[1:], strict=True):
        if len(a) >= DENSE * len(anchors) * len(rows):
            break
        middle, spread = np.einsum("ij,ij->i", m[a], means[r]), np.einsum("ij,ij->i", s[a], deviations[r])
        fine = (middle + spread + slack >= least[a]) & (middle - spread - slack <= most[a])
        a, r = a[fine], r[fine]
    if len(a) < DENSE * len(anchors) * len(rows):
        score = exact(anchors.rows[a], rows.rows[r], rowwise=True)
    else:
        score = exact(anchors.rows, rows.rows, rowwise=False)[a, r]
    fine = (score >= least[a]) & (score <= most[a])
    return a[fine], r[fine], score[fine]


class Best:
    """The k best rows of each window of each anchor that a task has met."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        """Windows ``low`` to ``high`` (anchors x windows) of scores; empty where low > high."""
        self.low, self.high, self.k = low, high, k
        n = len(low)
        self.owner, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(low.shape, -np.inf)
        self.most = np.where(low <= high, high, -np.inf).max(axis=1) if low.shape[1] else np.full(n, -np.inf)

    def least(self) -> np.ndarray:
        return np.where(self.low <= self.high, np.maximum(self.low, self.worst), np.inf).min(axis=1)

    def add(self, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(owner):
            return
        owner, ids, scores = (np.concatenate([x, y]) for x, y in ((self.owner, owner), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, owner))
        owner, ids, scores = owner[order], ids[order], scores[order]
        again = np.concatenate([[False], (owner[1:] == owner[:-1]) & (ids[1:] == ids[:-1]) & (scores[1:] == scores[:-1])])
        owner, ids, scores = owner[~again], ids[~again], scores[~again]
        keep = np.zeros(len(owner), bool)
        for w in range(self.low.shape[1]):
            inside = np.flatnonzero((scores >= self.low[owner, w]) & (scores <= self.high[owner, w]))
            if not len(inside):
                continue
            own = owner[inside]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
            keep[inside[place < self.k]] = True
            last = place == self.k - 1
            self.worst[own[last], w] = scores[inside[last]]
        self.owner, self.ids, self.scores = owner[keep], ids[keep], scores[keep]


class Block:
    """Anchors that every task holds: ids, labels, vectors, and the windows of scores that each looks for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.rows, self.low, self.high = ids, labels, rows, low, high


def _met(size: int, shared, same: bool, k: int):
    """Rows of (id, label, v) -> the best of each anchor's windows, of its own label or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        anchors, best = Summary(block.rows), Best(block.low, block.high, k)
        for batch in batches:
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            rows = Summary(whole(batch.column("v"), size))
            order = np.lexsort((rows.levels[0][0][:, 0], labels))
            starts = np.flatnonzero(np.concatenate([[True], labels[order][1:] != labels[order][:-1]])) if len(order) else []
            for own in np.split(order, starts[1:]) if len(order) else []:
                among = np.flatnonzero((block.labels == labels[own[0]]) == same)
                for slice_at in range(0, len(own), ROWS):
                    at = own[slice_at : slice_at + ROWS]
                    part = rows.take(at)
                    for first in range(0, len(among), ANCHORS):
                        some = among[first : first + ANCHORS]
                        least = best.least()
                        some = some[interested(anchors.take(some), part, least[some], best.most[some])]
                        if len(some):
                            a, r, score = passing(anchors.take(some), part, least[some], best.most[some])
                            fine = block.ids[some[a]] != ids[at[r]]
                            best.add(some[a[fine]], ids[at[r[fine]]], score[fine])
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[best.owner]), pa.array(best.ids), pa.array(best.scores.astype(np.int64))], names=["anchor_id", "vec_id", "score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, v) of the rows that take part, with the labels of every seventh id moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    kept = rows.select(F.col("vec_id").cast("bigint").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    return kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vectors.finite(F.col("v")))


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def mine(kept: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """kept and anchors (id, label, v) -> the contract's rows."""
    spark = kept.sparkSession
    scratch = Scratch(spark)
    one = Window.partitionBy("id").orderBy("label", "v")
    stated = scratch.table(anchors.select("*", F.row_number().over(one).alias("no")).where("no = 1").drop("no"), "anchors")
    size = kept.agg(F.max(F.size("v"))).first()[0]
    blocks = -(-stated.count() // BLOCK) if size else 0
    found = []
    for i in range(blocks):
        block = stated.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).orderBy("id").toArrow().combine_chunks()
        ids, labels, rows = block.column("id").to_numpy(), block.column("label").to_numpy(), whole(block.column("v").combine_chunks(), size)
        anywhere = np.full((len(ids), 1), np.inf)
        shared = spark.sparkContext.broadcast(Block(ids, labels, rows, -anywhere, anywhere))
        same = kept.mapInArrow(_met(size, shared, True, positives), PAIRS).distinct()
        same = scratch.table(_ranked(same, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), f"positives-{i}")
        low, high = np.full((len(ids), positives), np.inf), np.full((len(ids), positives), -np.inf)
        pairs = same.toArrow()  # at most BLOCK * positives rows
        at, place = np.searchsorted(ids, pairs.column("anchor_id").to_numpy()), pairs.column("rank").to_numpy() - 1
        score = pairs.column("positive_score").to_numpy()
        low[at, place], high[at, place] = [-(-LEAST * x // 100) for x in score.tolist()], [MOST * x // 100 for x in score.tolist()]
        shared.unpersist()
        shared = spark.sparkContext.broadcast(Block(ids, labels, rows, low, high))
        other = scratch.table(kept.mapInArrow(_met(size, shared, False, negatives), PAIRS).distinct(), f"others-{i}")
        inside = (LEAST * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= MOST * F.col("positive_score"))
        both = same.drop("rank").join(other, "anchor_id").where(inside)
        found.append(_ranked(both, ["anchor_id", "positive_id", "positive_score"], negatives))
    if not found:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100."""
    kept = usable(table(spark, sf_dir, "embeddings"))
    return mine(kept, kept.where(F.col("id") % 100 == 0))


ORACLE = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT DISTINCT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score QUALIFY rank <= {NEGATIVES}"""
