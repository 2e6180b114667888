"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words: the words under its ones are hashed, the others are ignored, so a
substituted word costs only the seeds that read it.  The seeds of all benchmark windows and of all document windows are
joined by hash, and around each hit the two texts are compared word by word on the hit's diagonal.  An overlap counts
where WINDOW consecutive aligned words (the whole item or the whole document, if that is shorter) agree in at least AGREE
percent.

With the three long masks here (found by search) each stretch of 16 words with up to three substitutions has a hit, and
99.9 % of those with four.  Shorter items and documents are found exactly: two neighbouring words are a mask of their own
for items of under SHORT words, and for documents of under SHORT words with all items.  No window of 4 to 15 words with as
many substitutions as AGREE admits is without two such words that agree.

Words are compared lower-cased with all but letters and digits removed, so case and punctuation don't hide a passage.

Native throughout.  Words become hashes inside the row; a bitmap of the benchmark's bigrams (every mask begins with two
ones) leaves few positions, a second one of its seeds leaves few seeds, and only those leave the row.  Both bitmaps have
a fixed greatest size and only save work: the join on the full hash and the comparison of words decide.

Defined cases: null or wordless texts and items overlap with nothing.  What is no evidence: items of fewer than LEAST words,
and pieces of fewer than FEW words of longer items; items of fewer than FEW words have to agree whole.  A very long text is
one row's work, linear in it.  Columns of docs may have any names.  Every row is judged by its own text, so ids may repeat or be null (overlaps() names documents by doc_id and
a fingerprint of the text); an empty benchmark leaves every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm.scratch import Scratch
from quernal.llm.text import packed, table

MASKS = ("1101101", "11000111", "11100000101")
#: The two masks of neighbouring words: of short items, and of all items for short documents.
PAIR_OF_SHORT, PAIR_OF_ANY = len(MASKS), len(MASKS) + 1
WINDOW, AGREE = 16, 75
LEAST, FEW, SHORT = 4, 7, 16
REACH = WINDOW - 1
#: Longs in a bitmap: 2**14 of them have a million bits, one benchmark seed in 16 to 64 bits up to the greatest size.
LEAST_LONGS, MOST_LONGS = 1 << 14, 1 << 17
#: Benchmark seeds that are broadcast at most (about 300 bytes each); beyond it the same join is shuffled.
BROADCAST_SEEDS = 200_000
#: Contaminated rows that are broadcast at most (some 100 bytes each).
BROADCAST_IDS = 200_000


def _words(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _hashed(text: Column) -> Column:
    return F.transform(_words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def _bigrams(h: str) -> Column:
    """Hash of each word and the next; the last word's is of itself and null."""
    return F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _seeds(h: Column, i: Column, item: bool) -> Column:
    """Seeds of the windows that begin at position i (from 1), as an array of hashes, null where a window is cut off."""
    size = F.size(h)

    def pair(n: int, when: Column) -> Column:
        return F.when((i < size) & when, F.xxhash64(F.lit(n), F.get(h, i - 1), F.get(h, i)))

    short, all_ = size < SHORT, F.lit(True)
    pairs = (pair(PAIR_OF_SHORT, short if item else all_), pair(PAIR_OF_ANY, all_ if item else short))

    def seed(n: int, mask: str) -> Column:
        read = [F.get(h, i - 1 + at) for at, bit in enumerate(mask) if bit == "1"]
        return F.when(i + (len(mask) - 1) <= F.size(h), F.xxhash64(F.lit(n), *read))

    return F.array(*[seed(n, mask) for n, mask in enumerate(MASKS)], *pairs)


def _bitmap(hashes: DataFrame, column: str, longs: int) -> Column:
    """A literal array of longs with a bit set for each hash; read by :func:`_in`."""
    word = F.col(column).bitwiseAND(F.lit(longs - 1))
    rows = hashes.groupBy(word.alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 58) as int))")).alias("bits")).collect()
    bits = np.zeros(longs, np.int64)
    for row in rows:
        bits[row.i] = row.bits
    # split and cast are folded into one literal when the plan is made, so the array isn't made anew for each lookup
    return F.split(F.lit(",".join(map(str, bits.tolist()))), ",").cast("array<bigint>")


def _in(bitmap: Column, h: Column, longs: int) -> Column:
    bits = F.element_at(bitmap, (h.bitwiseAND(F.lit(longs - 1)) + 1).cast("int"))
    return F.getbit(bits, F.shiftrightunsigned(h, 58).cast("int")) == 1


def _around(h: str, i: Column) -> Column:
    return F.slice(h, F.greatest(i - REACH, F.lit(1)), REACH * 2 + max(map(len, MASKS)))


def _mark(text: Column) -> Column:
    """Tells texts under one doc_id apart: 128 bits, for there may be any number of rows without an id."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, mark, item_id, matched): the most words that agree in
    one window, for each document and item with an overlap that counts; ``mark`` is the text's fingerprint."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select("item_id", _hashed(F.col("text")).alias("h"))
    items = items.where(F.size("h") >= LEAST).select("*", _bigrams("h").alias("g"))
    seeds = items.select("item_id", "h", F.size("h").alias("n"), F.posexplode("g").alias("j", "pair")).withColumn("j", F.col("j") + 1)
    seeds = seeds.select("item_id", "n", "j", "pair", _around("h", F.col("j")).alias("item_words"), F.explode(_seeds(F.col("h"), F.col("j"), True)).alias("seed")).where("seed is not null")
    seeds = scratch.table(seeds, "seeds")
    n_seeds = seeds.count()
    longs = LEAST_LONGS
    while longs < MOST_LONGS and longs * 4 < n_seeds:
        longs *= 2
    pairs, known = _bitmap(seeds, "pair", longs), _bitmap(seeds, "seed", longs)
    # no filter on a computed column here: it would be pushed below and inlined into the lambdas, once per element
    step = docs.select("doc_id", _mark(F.col("text")).alias("mark"), _hashed(F.col("text")).alias("h"))
    step = step.select("doc_id", "mark", "h", _bigrams("h").alias("g"))
    step = step.select("doc_id", "mark", "h", F.array_compact(F.transform("g", lambda g, i: F.when(_in(pairs, g, longs), i + 1))).alias("at"))
    hit = F.flatten(F.transform("at", lambda i: F.transform(F.filter(_seeds(F.col("h"), i, False), lambda s: s.isNotNull() & _in(known, s, longs)), lambda s: F.struct(i.alias("i"), s.alias("s")))))
    step = step.select("doc_id", "mark", "h", hit.alias("hits"))
    step = step.select("doc_id", "mark", "h", F.explode_outer("hits").alias("hit")).where("hit is not null").select("doc_id", "mark", F.size("h").alias("m"), F.col("hit.i").alias("i"), F.col("hit.s").alias("hash"), _around("h", F.col("hit.i")).alias("doc_words"))
    met = step.join(F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds, F.col("hash") == F.col("seed"))
    lead = F.least(F.lit(REACH), F.col("i") - 1, F.col("j") - 1)
    from_hit = lambda c, i: F.slice(c, F.least(F.lit(REACH), F.col(i) - 1) - lead + 1, 2 * REACH + max(map(len, MASKS)))
    window = F.least(F.lit(WINDOW), F.col("n"), F.greatest(F.col("m"), F.lit(FEW)))  # a document of fewer words is no piece
    met = met.select("doc_id", "mark", "item_id", window.alias("w"), from_hit("doc_words", "i").alias("a"), from_hit("item_words", "j").alias("b"))
    met = met.select("doc_id", "mark", "item_id", "w", F.slice(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), 1, F.least(F.size("a"), F.size("b"))).alias("same")).where("size(same) >= w")
    starts = F.when(F.size("same") >= F.col("w"), F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("w") + 1, F.lit(1))))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("same", s, F.col("w")), F.lit(0), lambda t, x: t + x)))
    met = met.select("doc_id", "mark", "item_id", "w", best.cast("long").alias("matched")).where(f"100 * matched >= {AGREE} * w and (w >= {FEW} or matched = w)")
    return met.groupBy("doc_id", "mark", "item_id").agg(F.max("matched").alias("matched"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, item_ids, matched), one row for each text of a doc_id with an overlap that counts."""
    found = overlaps(docs, benchmark).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("matched"))
    return Scratch(docs.sparkSession).table(found, "found")


def _judged(docs: DataFrame, benchmark: DataFrame, how: str) -> DataFrame:
    """docs -> (row, item_ids, matched) joined with what was found of each row; ``row`` packs every column of docs."""
    found = contaminated(docs.select("doc_id", "text"), benchmark).withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), _mark(F.col("text")).alias("own_mark"))
    return rows.join(found, F.expr("id <=> found_id and own_mark = found_mark"), how)


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap that counts, with their own columns."""
    return _judged(docs, benchmark, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document with the benchmark items that it overlaps, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _judged(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), "left")
    none = F.array().cast("array<bigint>")
    return out.select("row.doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.col("matched").isNull().alias("kept"))


_SPAN = "(" + " UNION ALL ".join(f"SELECT {n} AS m, {len(mask)} AS span, [{', '.join(str(i) for i, b in enumerate(mask) if b == '1')}] AS reads" for n, mask in enumerate((*MASKS, "11", "11"))) + ")"
ORACLE = rf"""
WITH masks AS {_SPAN},
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT * FROM (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark) WHERE len(w) >= {LEAST}),
ds AS (SELECT r, i, m, hash([w[i + k] for k in reads]) AS s FROM (SELECT r, w, m, span, reads, unnest(range(1, len(w) - span + 2)) AS i FROM d, masks WHERE m <> {PAIR_OF_ANY} OR len(w) < {SHORT})),
bs AS (SELECT item_id, j, m, hash([w[j + k] for k in reads]) AS s FROM (SELECT item_id, w, m, span, reads, unnest(range(1, len(w) - span + 2)) AS j FROM b, masks WHERE m <> {PAIR_OF_SHORT} OR len(w) < {SHORT})),
hits AS (SELECT DISTINCT r, item_id, i - j AS diagonal, i FROM ds JOIN bs USING (m, s)),
spans AS (SELECT h.*, d.w AS dw, b.w AS bw, least({WINDOW}, len(b.w), greatest(len(d.w), {FEW})) AS n FROM hits h JOIN d USING (r) JOIN b USING (item_id)),
-- word positions in the document that lie on the diagonal, near the hit
windows AS (SELECT r, item_id, n, dw, bw, diagonal,
    unnest(range(greatest(1, 1 + diagonal, i - {REACH}), least(len(dw), len(bw) + diagonal, i + {REACH + max(map(len, MASKS))} - 1) - n + 2)) AS p FROM spans),
scored AS (SELECT r, item_id, n, len([1 for k in range(p, p + n) if dw[k] = bw[k - diagonal]]) AS matched FROM windows),
pairs AS (SELECT r, item_id, max(matched) AS matched FROM scored WHERE 100 * matched >= {AGREE} * n AND (n >= {FEW} OR matched = n) GROUP BY ALL),
found AS (SELECT r, list_sort(list(item_id)) AS item_ids, max(matched) AS matched FROM pairs GROUP BY r)
SELECT doc_id, coalesce(len(item_ids), 0)::BIGINT AS n_items, coalesce(item_ids, []::BIGINT[]) AS item_ids, coalesce(matched, 0)::BIGINT AS matched, item_ids IS NULL AS kept
FROM d LEFT JOIN found USING (r)
"""
