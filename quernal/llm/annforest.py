"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees, spread over the cluster.

A tree gives every vector a long string of bits, the sides of BITS random hyperplanes it lies on, and keeps the vectors
sorted by it: vectors that share a prefix are neighbours there, and the longer it is the nearer they tend to be.  Two
vectors at a cosine s agree in a bit with p(s) = 1 - acos(s)/pi.

1. Descent.  In each tree a query goes to the longest prefix that anything shares with it, which is its place in the sorted
   array; the NEAR vectors on either side are compared, by codes of one byte an entry.  Over all trees that gives a cosine
   that the query's k-th neighbour has at least.
2. Ascent.  All trees go up together, one prefix bit after the other, until a vector at that cosine would be missed with
   at most MISS: (1 - p^x)^(trees at x bits) * (1 - p^(x+1))^(the others) <= MISS.  So a query with near neighbours stops
   at long prefixes and few candidates, one without any goes as far up as it needs; there is no cap on candidates.  All
   vectors below the prefixes are compared exactly.

A tree is cut into cells, its prefixes of some first bits (so that a cell has about CELL rows), and cells of far more rows
into parts by id: a cell or part is one group of a cogroup with the queries that reach it, sorted there.  Of each group
only the k best of each query go on.  Identical vectors meet before the forest is made and only their k + 1 least ids stay,
as no other can be among the k nearest, so groups of copies cost nothing.  More queries than BLOCK are taken in blocks, so
that what meets in a group stays bounded.

* Vectors that are null, zero or hold null or non-finite entries take no part, nor do rows with a null id; shorter vectors
  count as filled up with 0.  Rows of one id are one row, with the best of their scores.
* Ties go to the smaller id; a table of at most k candidates gives them all; an empty one gives no rows.
* Columns of other names are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernal.llm import vectors
from quernal.llm.scratch import Scratch
from quernal.llm.text import table

K = 5
TREES, BITS, SEED = 24, 63, 12
#: The chance that the k-th neighbour is missed.
MISS = 0.05
#: Rows of a cell, about; neighbours looked at on either side of a query's place.
CELL, NEAR = 8192, 8
#: Queries of one pass over the forest.
BLOCK = 200_000
#: Cells in several parts that are broadcast at most (some 30 bytes each); beyond it they are joined by shuffling.
BROADCAST_CELLS = 200_000
ROWS = 2048
#: Scores that differ by less are compared again, entry by entry, so that equal vectors tie exactly.
SLACK = 1e-9
FOUND = "query_id bigint, vec_id bigint, score double"


class Forest(NamedTuple):
    """The hyperplanes, and how many first bits of a tree's string name a cell."""

    size: int
    cell_bits: int

    def planes(self) -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((self.size, TREES * 64)).astype(np.float32)

    def strings(self, matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """The hash string of each row in each tree, as a number of BITS bits."""
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        bits = np.packbits(unit.astype(np.float32) @ planes > 0, axis=1)
        return (np.ascontiguousarray(bits).view(">u8").astype(np.uint64) >> np.uint64(1)).astype(np.int64)

    def cells(self, strings: np.ndarray, tree: int) -> np.ndarray:
        return (tree << self.cell_bits) + (strings >> (BITS - self.cell_bits))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


def _codes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as bytes, and the size of a step."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    step = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / step[:, None]).astype(np.int8), step


def _binaries(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray, size: int, kind: type) -> np.ndarray:
    cells = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(x.as_buffer() for x in cells), kind).reshape(len(cells), size)


def _planted(kept: DataFrame, forest: Forest, what: str) -> DataFrame:
    """(cell, id, string, and of ``what``: nothing, code and step, or v) of rows (id, v), one for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        for part in _slices(batches):
            matrix = vectors.dense(part.column("v"), forest.size)
            strings = forest.strings(matrix, planes)
            more = {}
            if what == "code":
                codes, steps = _codes(matrix)
                more = {"code": _binaries(codes), "step": pa.array(steps)}
            elif what == "v":
                more = {"v": part.column("v")}
            for tree in range(TREES):
                own = strings[:, tree]
                columns = {"cell": pa.array(forest.cells(own, tree))} | ({"id": part.column("id"), "string": pa.array(own)} if what else {}) | more
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = {"": "cell bigint", "code": "cell bigint, id bigint, string bigint, code binary, step double", "v": f"cell bigint, id bigint, string bigint, v {kept.schema['v'].dataType.simpleString()}"}
    return kept.mapInArrow(run, schema[what])


def _levels(cosine: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, j): the first j trees stop at x bits, the others at x + 1; a query of fewer than k found goes all the way up."""
    p = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.floor(np.log(1 - MISS ** (1 / TREES)) / np.log(p))
        x = np.where(p >= 1, BITS, np.clip(x, 0, BITS))
        low, high = np.log1p(-np.minimum(p**x, 1 - 1e-12)), np.log1p(-np.minimum(p ** (x + 1), 1 - 1e-12))
        j = np.ceil((np.log(MISS) - TREES * high) / (low - high))
    j = np.where((x >= BITS) | ~np.isfinite(j), TREES, np.clip(j, 1, TREES))
    all_of_it = (found < k) | ~np.isfinite(cosine)
    return np.where(all_of_it, 0, x).astype(np.int64), np.where(all_of_it, TREES, j).astype(np.int64)


def _routed(asked: DataFrame, forest: Forest, k: int) -> DataFrame:
    """asked (id, v, cosine, found) -> (cell, id, string, level, v): a row for each cell that a query reaches in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = forest.planes()
        for part in _slices(batches):
            strings = forest.strings(vectors.dense(part.column("v"), forest.size), planes)
            cosine, found = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("cosine", "found"))
            x, j = _levels(cosine, found, k)
            for tree in range(TREES):
                own, level = strings[:, tree], np.where(tree < j, x, np.minimum(x + 1, BITS))
                above = np.maximum(forest.cell_bits - level, 0)  # bits of the cell's name that are open
                first = (forest.cells(own, tree) >> above) << above
                columns = {"first": first, "last": first + (1 << above) - 1, "string": own, "level": level}
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), *map(pa.array, columns.values())], names=["id", "v", *columns])

    kind = asked.schema["v"].dataType.simpleString()
    rows = asked.mapInArrow(run, f"id bigint, v {kind}, first bigint, last bigint, string bigint, level bigint")
    return rows.select(F.explode(F.sequence("first", "last")).alias("cell"), "id", "string", "level", "v")


def _parted(rows: DataFrame, large: DataFrame, of_id: bool) -> DataFrame:
    """rows with ``part``: for data the one their id falls in, for queries every part of the cell."""
    met = rows.join(large, "cell", "left")
    n = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("id"), n).cast("int") if of_id else F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    return met.select(*rows.columns, part.alias("part"))


def _near(forest: Forest, k: int):
    """The k cosines that the neighbours in sorted order have at least, for each query of a group."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        columns: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(asked):
            order = np.argsort(data.column("string").to_numpy(), kind="stable")
            ids, strings = data.column("id").to_numpy()[order], data.column("string").to_numpy()[order]
            codes, steps = _matrix(data.column("code"), forest.size, np.int8)[order], data.column("step").to_numpy()[order]
            own, places = asked.column("id").to_numpy(), np.searchsorted(strings, asked.column("string").to_numpy())
            matrix = vectors.dense(asked.column("v").combine_chunks(), forest.size)
            matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            error = np.abs(matrix).sum(axis=1) / 2
            for start in range(0, len(own), 256):
                stop = min(start + 256, len(own))
                at = places[start:stop, None] + np.arange(-NEAR, NEAR)
                there = (at >= 0) & (at < len(ids))
                at = np.clip(at, 0, len(ids) - 1)
                score = np.einsum("qnd,qd->qn", codes[at].astype(np.float32), matrix[start:stop].astype(np.float32)) * steps[at]
                score = np.where(there & (ids[at] != own[start:stop, None]), score - error[start:stop, None] * steps[at] - 1e-5, -np.inf)
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                row, column = np.repeat(np.arange(stop - start), best.shape[1]), best.ravel()
                fine = np.isfinite(score[row, column])
                row, column = row[fine], column[fine]
                for name, values in (("query_id", own[start:stop][row]), ("vec_id", ids[at[row, column]]), ("score", score[row, column])):
                    columns[name].append(values)
        return pa.table({name: pa.array(np.concatenate(parts) if parts else [], kind) for (name, parts), kind in zip(columns.items(), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def _picked(score: np.ndarray, ids: np.ndarray, own: int, exact, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and their exact scores; ``exact`` makes them of positions."""
    score = np.where(ids == own, -np.inf, score)
    need = k
    while True:
        cut = np.partition(score, len(score) - need)[len(score) - need] if len(score) > need else -np.inf
        at = np.flatnonzero(np.isfinite(score) & (score >= cut - SLACK))
        if len(np.unique(ids[at])) >= k or need >= len(score):  # rows of one id count once
            break
        need *= 2
    sure = exact(at)
    order = np.lexsort((ids[at], -sure))
    at, sure = at[order], sure[order]
    first = np.sort(np.unique(ids[at], return_index=True)[1])[:k]
    return ids[at[first]], sure[first]


def _below(forest: Forest, k: int):
    """The k nearest below each query's prefix, exactly, among the rows of a group."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(data) and len(asked):
            order = np.argsort(data.column("string").to_numpy(), kind="stable")
            ids, strings = data.column("id").to_numpy()[order], data.column("string").to_numpy()[order].astype(np.uint64)
            matrix = vectors.dense(data.column("v").combine_chunks(), forest.size)[order]
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            free = np.uint64(BITS) - asked.column("level").to_numpy().astype(np.uint64)
            first = (asked.column("string").to_numpy().astype(np.uint64) >> free) << free
            low, high = np.searchsorted(strings, first), np.searchsorted(strings, first + (np.uint64(1) << free))
            own = asked.column("id").to_numpy()
            queries = vectors.dense(asked.column("v").combine_chunks(), forest.size)
            sizes = np.sqrt((queries * queries).sum(axis=1))
            spans, which = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
            for s, (a, b) in enumerate(spans.T.tolist()):
                rows = np.flatnonzero(which.ravel() == s)
                for some in np.array_split(rows, -(-len(rows) * (b - a) // 4_000_000) or 1) if b > a else []:
                    scores = (queries[some] @ matrix[a:b].T) / (sizes[some, None] * norms[a:b])
                    for i, q in enumerate(some.tolist()):
                        exact = lambda at, q=q, a=a: (matrix[a + at] * queries[q]).sum(axis=1) / (norms[a + at] * sizes[q])
                        best, sure = _picked(scores[i], ids[a:b], own[q], exact, k)
                        out.append((np.full(len(best), own[q]), best, sure))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("query_id", "vec_id", "score"), parts, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each id once, with their rank."""
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def nearest(rows: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """rows (vec_id, embedding), asked (query_id, embedding) -> (query_id, rank, vec_id, score); see the module.

    A query doesn't find rows of its own id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = rows.sparkSession
    scratch = Scratch(spark)
    nonzero = F.exists("v", lambda x: x != 0)
    usable = lambda df, c: df.select(F.col(c).cast("bigint").alias("id"), F.col("embedding").alias("v")).where(F.col("id").isNotNull() & vectors.finite(F.col("v")) & nonzero)
    queries = usable(asked, "query_id")
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    kept = usable(rows, "vec_id").select("*", F.dense_rank().over(copies).alias("copy")).where(F.col("copy") <= k + 1)
    kept = scratch.table(kept.select("id", "v", F.xxhash64("v").alias("h")).dropDuplicates(["h", "v", "id"]).select("id", "v"), "kept")
    n, size = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(size or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    if not n or not size:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    forest = Forest(size, min(40, max(0, (n // CELL).bit_length())))
    counted = _planted(kept, forest, "").groupBy("cell").count().where(F.col("count") > 2 * CELL)
    large = scratch.table(counted.select("cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_CELLS else large
    coded, whole = (_parted(_planted(kept, forest, what), large, of_id=True).groupBy("cell", "part") for what in ("code", "v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    found = []
    for i in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)
        at = _parted(_planted(some, forest, "v"), large, of_id=False).groupBy("cell", "part")
        seen = scratch.table(coded.cogroup(at).applyInArrow(_near(forest, k), FOUND), f"seen-{i}")
        least = _best(seen, k).groupBy("query_id").agg(F.min("score").alias("cosine"), F.count("*").alias("found"))
        placed = some.join(least, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("cosine", F.lit(-1.0)).alias("cosine"), F.coalesce("found", F.lit(0)).alias("found"))
        reached = _parted(_routed(placed, forest, k), large, of_id=False).groupBy("cell", "part")
        found.append(scratch.table(_best(whole.cogroup(reached).applyInArrow(_below(forest, k), FOUND), k), f"found-{i}"))
        scratch.drop(f"seen-{i}")
    scratch.drop("kept")
    return reduce(DataFrame.unionByName, found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 asks for its 5 nearest among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding"))
