"""Mixing sources to target weights.

Every document gets a hash-random key, each source is ordered by that key, and the source's budget is cut off the
distributed prefix sum of sizes.  The order within a source is range-partitioned by the leading digits of the key,
whose values are uniform, so no task ever holds a whole source: sums of 256 ranges a source tell in which the cut falls,
sums of the 256 buckets in that range tell the bucket, and only the documents of that one bucket are summed one by one.
What joins back to the documents is one row per source: a key below the cut is taken once more than one above it.  The
text itself is never shuffled, and sources may be many: their order and their targets are prefix sums too.

Defined cases: a null or wordless text has size 0 and nothing is taken of it; null sources form one source, ordered
last; rows that share source and doc_id (repeated rows, null ids) are one unit of the order and share what is taken of
it in proportion to their sizes, rounded down; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernal.llm.prefix import before
from quernal.llm.scratch import Scratch
from quernal.llm.text import n_words_of, packed, table

SEED = "mix-1"
MAX_EPOCHS = 3
#: Leading hex digits of the key that name a bucket: 65,536 buckets a source keep a bucket small at any size.
BUCKET_DIGITS, RANGE_DIGITS = 4, 2
#: Sources whose one-row plans are broadcast at most; beyond it the same joins are shuffled.
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  Targets share the sum of all sizes by weight;
    none is above ``max_epochs`` times its source, the excess goes to the others by weight.  Closed form: in order of
    cap over weight the capped sources come first, so sums over those before decide which are capped.  One row per source.
    """
    scratch = Scratch(sources.sparkSession)
    name = F.col("source").asc_nulls_last()
    ranked = before(sources.select("source", "source_size"), [name], {"place": "1"}, scratch, "named")
    weighed = ranked.select("source", "source_size", (F.col("place") % 3 + 1).cast("double").alias("weight"), (max_epochs * F.col("source_size").cast("double")).alias("cap"))
    ratio = F.col("cap") / F.col("weight")
    sums = before(weighed, [ratio, name], {"cap_before": "cap", "weight_before": "weight"}, scratch, "weighed")
    total, weights = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0).cast("double") - F.col("cap_before")) / (F.lit(weights or 1.0) - F.col("weight_before"))
    ranked = sums.select("source", "source_size", "weight", "cap", level.alias("level"))
    share = ranked.agg(F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))).first()[0]
    target = F.col("cap") if share is None else F.least(F.col("cap"), F.lit(share) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def _cut(parts: DataFrame, part: str, size: str) -> DataFrame:
    """parts (source, part, size, offset, rest) of the range a cut is in -> those (source, part, offset, rest) that it falls
    into; ``offset`` is what lies before."""
    upto = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.select("source", part, size, "rest", (F.col("offset") + F.sum(size).over(upto)).alias("end"))
    return ends.where(f"end - {size} <= rest and rest < end").select("source", part, F.expr(f"end - {size}").alias("offset"), "rest")


def mix(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with doc_id, text, source -> (row, size, source_size, target, taken); ``row`` packs every column of docs."""
    keyed = docs.select(
        packed(docs).alias("row"), F.col("source").alias("source"), n_words_of(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
    )
    slim = keyed.select("source", "size", "key", F.substring("key", 1, BUCKET_DIGITS).alias("bucket"))
    scratch = Scratch(docs.sparkSession)
    buckets = scratch.table(slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    goal = targets(scratch.table(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), "sources"), max_epochs)
    goal = scratch.table(goal, "goal")
    small = F.broadcast if goal.count() <= BROADCAST_SOURCES else lambda rows: rows
    goal = goal.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    # where the rest of the budget ends: first the range, then the bucket in it, then the document
    ranges = buckets.groupBy("source", F.substring("bucket", 1, RANGE_DIGITS).alias("range")).agg(F.sum("bucket_size").alias("range_size"))
    ranges = ranges.alias("r").join(small(goal.select("source", "rest").alias("g")), F.expr("r.source <=> g.source")).select("r.*", "g.rest", F.lit(0).cast("long").alias("offset"))
    cut_range = scratch.table(_cut(ranges, "range", "range_size"), "ranges")
    inner = buckets.alias("b").join(small(cut_range.alias("c")), F.expr(f"b.source <=> c.source and substring(b.bucket, 1, {RANGE_DIGITS}) = c.range")).select("b.*", "c.offset", "c.rest")
    cut_bucket = scratch.table(_cut(inner, "bucket", "bucket_size"), "cut-buckets")
    units = slim.alias("s").join(small(cut_bucket.alias("c")), F.expr("s.source <=> c.source and s.bucket = c.bucket")).groupBy("s.source", "s.key", "c.offset", "c.rest").agg(F.sum("size").alias("unit"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut = units.select("*", (F.col("offset") + F.sum("unit").over(running)).alias("unit_end")).where("unit_end - unit <= rest and rest < unit_end")
    cut = cut.select("source", F.col("key").alias("cut_key"), F.expr("rest - (unit_end - unit)").alias("cut_words"), "unit")
    plan = goal.alias("g").join(cut.alias("c"), F.expr("g.source <=> c.source"), "left").select(F.col("g.source").alias("plan_source"), "source_size", "target", "epochs", "cut_key", "cut_words", "unit")
    plan = scratch.table(plan, "plan")
    for done in ("buckets", "sources", "goal", "ranges", "cut-buckets"):
        scratch.drop(done)
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.floor(F.col("size") * F.col("cut_words") / F.col("unit"))).otherwise(0)
    return keyed.join(small(plan), F.expr("source <=> plan_source")).select("row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document once per pass that takes words of it, with ``mix_pass`` (from 1) and ``mix_words``.

    A name of docs equal to one of these two gives way to it.
    """
    planned = mix(docs, seed)
    passes = planned.where("taken > 0").select("row", "size", F.explode(F.expr("sequence(1L, cast(ceil(taken / size) as bigint))")).alias("mix_pass"), "taken")
    words = F.least(F.col("size"), F.col("taken") - (F.col("mix_pass") - 1) * F.col("size"))
    kept = [c for c in docs.columns if c.lower() not in ("mix_pass", "mix_words")]
    return passes.select(*[F.col("row")[c].alias(c) for c in kept], F.col("mix_pass"), words.alias("mix_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the whole documents table, with the words the mix takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, {MAX_EPOCHS} * source_size::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
shares AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS share FROM levels),
goals AS (
  SELECT source, source_size, round(CASE WHEN share IS NULL THEN cap ELSE least(cap, share * weight) END, 6) AS target FROM shares),
plans AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM goals),
plans2 AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM plans),
ordered AS (
  SELECT d.*, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM sized d JOIN plans2 p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM ordered
"""
