"""MinHash near-dedup by min-max hashing.

Under each of 65 random permutations of 64-bit shingle hashes both the least and the greatest value are kept, so 65
hash evaluations a shingle give 130 signature values; each is by itself an unbiased sample of a shingle, equal in two
documents with probability J.  Bands of up to 5 values make candidates, as many values as the threshold allows if a pair
just at it may share no band with a probability of MISS at most: 26 bands of 5 from 0.8 on (3e-5 at 0.8, 3e-7 at 0.85),
43 of 3 at 0.6.  Links are confirmed on the full shingle sets, and groups are connected components.

How big groups are kept from squaring:

* documents with equal sets are one node, counted by a partially aggregated group-by;
* of each band bucket only the pairs with its most central document are candidates at first;
* what that leaves open is the buckets whose members are still in different components: the sets of those members are
  joined across components, exactly, by rarity-ordered prefixes (see :func:`across`), so no link between components is
  lost, and a group that hangs together costs one pair a document.

Texts are shuffled only for the documents that candidates name.  Every stage is a written table in the shared folder.

Defined cases: a null or wordless text has no shingles, is its own component and is kept; a text with fewer words than
a shingle has its whole sequence as one shingle; rows that repeat a doc_id are one document (all its rows get the same
verdict); a row with a null doc_id links with nothing, has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernal.llm import kernel
from quernal.llm.components import components
from quernal.llm.scratch import Scratch
from quernal.llm.text import packed, table

PERMUTATIONS = 65
BAND_ROWS, MISS = 5, 1e-4
#: Ids of candidate documents that are broadcast at most (8 bytes each); beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000
_rng = np.random.default_rng(20240601)
_FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * PERMUTATIONS): the minima and then the maxima of each set; rows of empty sets mean nothing."""
    out = np.zeros((len(first) - 1, 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        x = grams * _FACTORS[p] + _SHIFTS[p]
        out[:, p] = kernel.fold(x, first, np.minimum)
        out[:, PERMUTATIONS + p] = kernel.fold(x, first, np.maximum)
    return out


def band_rows(percent: int) -> int:
    """How many values a band has for a threshold."""
    fits = [r for r in range(1, BAND_ROWS + 1) if (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r) <= MISS]
    if not fits:
        raise ValueError(f"{2 * PERMUTATIONS} values don't find pairs of {percent} percent")
    return max(fits)


def band_keys(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """(texts, bands) 64-bit keys; the band's number is part of the key."""
    n_bands = signature.shape[1] // rows
    keys = np.empty((len(signature), n_bands), np.uint64)
    for b in range(n_bands):
        acc = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):  # a band takes minima and maxima of different permutations
            acc = kernel.mix(acc * np.uint64(3) + signature[:, b + r * n_bands])
        keys[:, b] = acc
    return keys


def _sign(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in kernel.blocks(batch.column("text")):
                grams, first = kernel.shingles(kernel.words(data, offsets), k)
                counts = np.diff(first)
                keys = band_keys(signatures(grams, first), rows).view(np.int64)
                sums = kernel.fold(grams, first, np.add).view(np.int64)
                other = kernel.fold(kernel.mix(grams + np.uint64(77)), first, np.add).view(np.int64)
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(counts > 0, keys.shape[1], 0))]).astype(np.int32), keys[counts > 0].ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row:stop].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sums), pa.array(other), bands], schema=_SIGNED)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in kernel.blocks(batch.column("text")):
                grams, first = kernel.shingles(kernel.words(data, offsets), k)
                own = pa.ListArray.from_arrays(first.astype(np.int32), grams.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row:stop].cast(pa.int64()), own], names=["doc_id", "grams"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, at), (right, to) = (kernel.lists(batch.column(side)) for side in ("left", "right"))
            both = kernel.common(left, at, right, to)
            good = 100 * both >= percent * (np.diff(at) + np.diff(to) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def sets_of(ids: DataFrame, docs: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """ids (id), docs (doc_id, text) -> table (doc_id, grams) of the whole shingle sets of those documents."""
    ids = scratch.table(ids.distinct(), f"{name}-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")
    sets = texts.mapInArrow(_sets(k), "doc_id long, grams array<long>").where("size(grams) > 0").distinct()
    return scratch.table(sets, f"{name}-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets are similar enough."""
    left, right = sets.select(F.col("doc_id").alias("ida"), F.col("grams").alias("left")), sets.select(F.col("doc_id").alias("idb"), F.col("grams").alias("right"))
    both = pairs.join(left, F.col("a") == F.col("ida")).join(right, F.col("b") == F.col("idb")).select("a", "b", "left", "right")
    return scratch.table(both.mapInArrow(_confirm(percent), "a long, b long").distinct(), f"{name}-links")


def across(sets: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """sets (doc_id, grams), labels (node, c) -> candidate pairs (a, b) of similar sets with different labels.

    Exact: shingles in order of rarity among these sets, prefix, positional and length filters, all in the join.  A copy
    with many edits of its own has only rare shingles in its prefix, so it meets few others, however big its group.
    """
    n, rare = F.size("grams"), Window.partitionBy("doc_id", "size", "c", "mark").orderBy(F.coalesce("df", F.lit(1)), "gram")
    # dealt out, since a few files of sets would be as few tasks, each with all the shingles of its sets
    dealt = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = dealt.join(labels.withColumnRenamed("node", "known"), F.col("doc_id") == F.col("known"))
    rows = rows.select("doc_id", "c", n.alias("size"), F.xxhash64("grams").alias("mark"), F.explode("grams").alias("gram"))
    counts = scratch.table(rows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("gram", "counted"), "shingle-counts")
    rows = rows.join(counts, F.col("gram") == F.col("counted"), "left").select("*", (F.row_number().over(rare) - 1).alias("pos"))
    rows = rows.where(f"df > 1 and pos <= size - cast(({percent} * size + 99) div 100 as int)").select("gram", "doc_id", "c", "size", "pos")
    near = f"""x.gram = y.gram and x.doc_id < y.doc_id and x.c <> y.c and 100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)
        and {100 + percent} * least(x.size - x.pos, y.size - y.pos) >= {percent} * (x.size + y.size)"""
    return rows.alias("x").join(rows.alias("y"), F.expr(near)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with doc_id and text -> (doc_id, n_shingles, component_id, kept), one row per row of docs.

    Documents are linked where 100 * |A & B| >= percent * |A | B| of their distinct k-word shingles (words lower-cased
    A-Z only); component_id is the smallest doc_id reachable, and the document with that id is kept.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.table(texts.mapInArrow(_sign(k, band_rows(percent)), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # one node per distinct set: its smallest doc_id
    nodes = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m")).select("set_a", "set_b", F.col("m.doc_id").alias("node"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands"))
    nodes = scratch.table(nodes, "nodes")
    # links between the sets of one doc_id that has several
    same_id = full.select("doc_id", "set_a", "set_b").distinct().join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    rows = nodes.select(F.explode("bands").alias("band"), "node", "n")
    shared = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").withColumnRenamed("band", "shared")
    # written, here and below, so that the join shuffles both sides itself and the engine can split a very full bucket
    shared = scratch.table(shared, "shared")
    bucketed = scratch.table(rows.join(shared, F.col("band") == F.col("shared")).select("band", "node", "n", "members"), "bucketed")
    # the hub of a bucket is its most central document: the one that shares most over all buckets
    central = bucketed.groupBy(F.col("node").alias("ranked")).agg(F.sum("members").alias("weight"))
    weighed = bucketed.join(central, F.col("node") == F.col("ranked")).select("band", "node", "n", "members", "weight")
    hubs = weighed.groupBy(F.col("band").alias("hub_band")).agg(F.max(F.struct("weight", F.negative("node").alias("order"), "node", "n")).alias("hub")).select("hub_band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    hubs = scratch.table(hubs, "hub-of")
    bucketed = scratch.table(bucketed.join(hubs, F.col("band") == F.col("hub_band")).select("band", "node", "n", "members", "hub", "hub_n"), "hubs")
    stars = bucketed.where("node <> hub").where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = scratch.table(stars, "stars")
    sets = sets_of(stars.select(F.explode(F.array("a", "b")).alias("id")), texts, k, scratch, "star")
    first = confirmed(stars, sets, percent, scratch, "star").unionByName(same_id)
    groups = components(first, scratch, "first")
    for done in ("star-ids", "star-sets", "stars"):
        scratch.drop(done)
    # buckets whose members are still apart
    labelled = bucketed.where("members > 2").join(groups.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    labelled = scratch.table(labelled, "labelled")
    apart = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select(F.col("band").alias("apart"))
    apart = scratch.table(apart, "apart")
    open_nodes = scratch.table(labelled.join(apart, F.col("band") == F.col("apart"), "left_semi").select("node", "c").distinct(), "open")
    sets = sets_of(open_nodes.select(F.col("node").alias("id")), texts, k, scratch, "open")
    second = confirmed(scratch.table(across(sets, open_nodes, percent, scratch), "across"), sets, percent, scratch, "across")
    if not second.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), scratch, "second")
    found = nodes.select("set_a", "set_b", "node").join(groups.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    found = scratch.table(found, "found")
    for done in ("bucketed", "hubs", "labelled", "open", "open-ids", "open-sets", "nodes", "star-links", "across", "across-links", "shared", "hub-of", "apart", "shingle-counts"):
        scratch.drop(done)
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(found.withColumnsRenamed({"set_a": "fa", "set_b": "fb"}), F.expr("set_a = fa and set_b = fb and n_shingles > 0 and doc_id is not null"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with the columns of docs."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: groups of the whole documents table, by three-word shingles and a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)
