"""Hybrid search: reciprocal-rank fusion of both legs, boosts, penalties, saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernal.functions.ranking import DEFINITION_KEYWORDS, is_symbol_query, path_hits, path_keywords, path_penalty, query_symbols, resolve_alpha
from quernal.operators.lexical import KEY, top_k
from quernal.plans.storage import scratch

RRF, DEPTH = 60, 5
#: Pairs of a query and a symbol that are broadcast at most (some 60 bytes each).
BROADCAST_SYMBOLS = 200_000
FILE_BOOST, SYMBOL_BOOST, EMBEDDED_BOOST, SATURATION = 0.2, 3.0, 1.5, 0.5


def fuse(queries: DataFrame, semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """queries (qid, query[, alpha]) and ranked legs -> (qid, key, score): alpha/(60+rank) + (1-alpha)/(60+rank)."""
    alpha = queries.select("qid", resolve_alpha(F.col("query"), F.col("alpha") if "alpha" in queries.columns else None).alias("a"))
    legs = semantic.select("qid", *KEY, "rank", F.lit(True).alias("sem")).unionByName(lexical.select("qid", *KEY, "rank", F.lit(False).alias("sem")))
    part = F.when(F.col("sem"), F.col("a")).otherwise(1 - F.col("a")) / (RRF + F.col("rank"))
    return legs.join(alpha, "qid").groupBy("qid", *KEY).agg(F.sum(part).alias("score"))


def boost_files(scores: DataFrame) -> DataFrame:
    """The best chunk of each file gains 0.2 * max score * the file's share of the strongest file's sum."""
    # sums and greatest values go ahead of each shuffle, so that a file or query of very many chunks is no task's own, as in a window
    first = F.struct(F.round("score", 9).alias("r"), (-F.col("chunk_no")).alias("no"), F.col("score").alias("score"))
    scores = scores.groupBy("qid", *KEY, "score").agg(F.count("*").cast("int").alias("n"))  # of rows that are equal only one gains
    files = scores.groupBy("qid", "file_path").agg(F.sum(F.col("score") * F.col("n")).alias("s"), F.max("score").alias("most"), F.max(first).alias("first"))
    peaks = files.groupBy("qid").agg(F.max("most").alias("m"), F.max("s").alias("top"))
    gain = F.when(F.col("m") > 0, FILE_BOOST * F.col("m") * F.col("s") / F.col("top")).otherwise(0.0)
    gains = files.join(peaks, "qid").select(F.col("qid").alias("q"), F.col("file_path").alias("f"), "first", gain.alias("gain"))
    rows = scores.join(gains, (F.col("qid") == F.col("q")) & F.col("file_path").eqNullSafe(F.col("f"))).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    best = (F.col("i") == 1) & first.eqNullSafe(F.col("first"))
    return rows.select("qid", *KEY, (F.col("score") + F.when(best, F.col("gain")).otherwise(0.0)).alias("score"))


def declared_names(content: str) -> Column:
    """The distinct words that follow a definition keyword and a space."""
    pattern = f"(?:{'|'.join(DEFINITION_KEYWORDS)}) (?=([A-Za-z0-9_]+))"
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), 1))


def declared(chunks: DataFrame) -> DataFrame:
    """(name, key): the word that follows a definition keyword and a space, once for each chunk that has it."""
    return chunks.select(*KEY, F.explode(declared_names("content")).alias("name")).select("name", *KEY)


def boost_definitions(scores: DataFrame, queries: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks that define a symbol of the query gain 3 (symbol query) or 1.5 (prose) times the best score, candidates or not.

    ``names`` are those of :func:`declared`.  A chunk has "<keyword> <symbol>" as a substring if the symbol begins the word
    after a keyword: so the beginnings of names, as long as symbols are, meet symbols by equality.
    """
    asked = queries.select("qid", F.explode(query_symbols(F.col("query"))).alias("symbol"), is_symbol_query(F.col("query")).alias("exact"))
    lengths = {row.n: row.c for row in asked.groupBy(F.char_length("symbol").alias("n")).agg(F.count("*").alias("c")).collect()}
    if not lengths:
        return scores
    small = F.broadcast if sum(lengths.values()) <= BROADCAST_SYMBOLS else lambda rows: rows
    begins = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.char_length("name"))
    begun = names.select(*KEY, "name", F.explode(begins).alias("n")).select(*KEY, F.left("name", F.col("n")).alias("symbol"))
    found = begun.join(small(asked), "symbol").select("qid", *KEY, "exact").distinct()
    peak = scores.groupBy("qid").agg(F.max("score").alias("m"))
    bonus = found.join(peak, "qid").select("qid", *KEY, (F.col("m") * F.when(F.col("exact"), SYMBOL_BOOST).otherwise(EMBEDDED_BOOST)).alias("score"))
    return scores.unionByName(bonus).groupBy("qid", *KEY).agg(F.sum("score").alias("score"))


def boost_stems(scores: DataFrame, queries: DataFrame, peak: DataFrame | None = None) -> DataFrame:
    """Prose queries: a chunk gains max score * the share of query keywords that its file's name answers."""
    asked = queries.where(~is_symbol_query(F.col("query"))).select("qid", path_keywords(F.col("query")).alias("words"))
    peak = scores.groupBy("qid").agg(F.max("score").alias("m")) if peak is None else peak
    rows = scores.join(asked, "qid", "left").join(peak, "qid")
    gain = F.when(F.size("words") > 0, F.col("m") * path_hits(F.col("words"), F.col("file_path")) / F.size("words")).otherwise(0.0)
    return rows.select("qid", *KEY, (F.col("score") + F.coalesce(gain, F.lit(0.0))).alias("score"))


def penalise_paths(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.col("score") * path_penalty(F.col("file_path")))


def saturate_files(scores: DataFrame) -> DataFrame:
    """The i-th best chunk of a file, from 0, counts 0.5**i."""
    order = Window.partitionBy("qid", "file_path").orderBy(F.round("score", 9).desc(), "chunk_no")
    return scores.select("qid", *KEY, (F.col("score") * F.pow(F.lit(SATURATION), F.row_number().over(order) - 1)).alias("score"))


def hybrid_topk(queries: DataFrame, names: DataFrame, semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Legs are the top DEPTH * k of each; ``names`` are the declared ones, which definitions are looked for in."""
    scores = scratch(boost_files(fuse(queries, semantic, lexical)))  # few rows for each query, which is read three times
    peak = scores.groupBy("qid").agg(F.max("score").alias("m"))
    scores = boost_stems(boost_definitions(scores, queries, names), queries, peak)
    whole = queries.where(resolve_alpha(F.col("query"), F.col("alpha")) >= 1).select("qid", F.lit(True).alias("plain")) if "alpha" in queries.columns else None
    penalty = path_penalty(F.col("file_path"))
    if whole is not None:  # meaning alone: paths don't count
        scores, penalty = scores.join(whole, "qid", "left"), F.when(F.col("plain"), 1.0).otherwise(penalty)
    return top_k(saturate_files(scores.select("qid", *KEY, (F.col("score") * penalty).alias("score"))), k, "hybrid")
