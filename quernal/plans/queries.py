"""The registered queries over the driver's tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.functions import ranking, tokens
from quernal.operators import blocks, chunking, dense, fusion, incremental, lexical, locate, metric, savings
from quernal.plans import store
from quernal.plans.index import SearchIndex
from quernal.plans.storage import scratch
from quernal.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = 10
NOW = 1_700_000_000.0
PATHS = ("src/main.rs", "lib/a.PY", "x/y.tsx", "b.tar.gz", ".rs", "Makefile", "tests/foo_test.rs", "pkg/__init__.py", "types/lib.d.ts", "legacy/old.go", "latest/x.rb", "a/compat/b.c", "win\\\\tests\\\\x.ts", "docs/readme.md", "q.yml", "z.h")
ASKS = ("HandlerStack", "_x", "a::b", "a.b", "foo->bar", "encode", "authentication flow", "Auth", "how does parseQuery work", "use HandlerStack and MyParser", "snake_case", "  Auth  ")
CODE = (("src/stack.rs", 0, "pub struct HandlerStack { }\nimpl HandlerStack {}", 1, 2), ("src/parse.rs", 0, "fn parseQuery(s: &str) {}\nfn add_one() {}", 1, 2), ("py/auth.py", 0, "class Auth:\n    def check(self): HandlerStack()", 1, 2), ("py/auth.py", 1, "# only\n# comments", 4, 5), ("py/auth.py", 2, "def encode(x):\n    return x", 9, 10), ("tests/t.py", 0, "def test_auth():\n    parseQuery(Auth)", 1, 2))


def _register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    listed = ", ".join("(" + ", ".join(_s(v) if isinstance(v, str) else str(v) for v in (row if isinstance(row, tuple) else (row,))) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {listed}) v({names}))"


DOCS = "(SELECT source || '/doc_' || doc_id || '.txt' AS file_path, 0 AS chunk_no, lang, text AS content, doc_id, source FROM documents)"
_PLACE = "[" + ", ".join(map(_s, corpus.PLACES)) + "][try_cast(regexp_extract(source, '([0-9]*)$', 1) AS INT) % 6 + 1]"
BY_SOURCE = f"(SELECT {_PLACE} || source || '.d.ts' AS file_path, doc_id::INT AS chunk_no, lang, text AS content FROM documents)"
ASKED_SQL = "(SELECT item_id AS qid, text AS query FROM benchmark)"
_AT = lambda values, n: "[" + ", ".join(map(_s, values)) + f"][{n} % {len(values)} + 1]"
DOC_PATHS = f"(SELECT {_AT(corpus.PLACES, f'(doc_id // {len(corpus.NAMES)})')} || source || '/' || doc_id || '/' || {_AT(corpus.NAMES, 'doc_id')} AS path FROM documents)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a query, whole."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some source files, and every document as a chunk of its source's file."""
    rows = spark.createDataFrame(list(CODE), "file_path string, chunk_no int, content string, start_line int, end_line int")
    rows = rows.unionByName(corpus.documents_by_source(spark, sf_dir).select(*lexical.KEY, "content", F.lit(1).alias("start_line"), F.lit(9).alias("end_line")))
    found = rows.select("*", F.when(F.endswith("file_path", F.lit(".rs")), "rust").otherwise("python").alias("language"))
    names = F.regexp_extract_all("content", F.lit(r"\b(?:struct|fn|class|def) ([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return found.select("*", F.transform(names, lambda n: F.struct(F.lower(n).alias("name"), F.lit("function").alias("kind"), F.col("start_line").alias("line"))).alias("symbols"))


CODE_SQL = f"""(SELECT *, [lower(n) for n in regexp_extract_all(content, '\\b(?:struct|fn|class|def) ([A-Za-z_][A-Za-z0-9_]*)', 1)] AS names
  FROM (SELECT * FROM {_values(CODE, "file_path, chunk_no, content, start_line, end_line")} UNION ALL SELECT file_path, chunk_no, content, 1, 9 FROM {BY_SOURCE}))"""


def bm25_sql(chunks: str, queries: str, k: int, extra: str = "") -> str:
    return f"""c AS (SELECT file_path, chunk_no, {tokens.sql_tokenize(tokens.sql_enriched("content", "file_path"))} AS toks FROM {chunks}),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM c),
p AS (SELECT term, file_path, chunk_no, len, count(*) AS tf FROM (SELECT file_path, chunk_no, len(toks) AS len, unnest(toks) AS term FROM c) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, st GROUP BY term),
qt AS (SELECT qid, term, count(*)::DOUBLE AS mult FROM (SELECT qid, unnest({tokens.sql_tokenize("query")}) AS term FROM {queries}) GROUP BY ALL),
bs AS (SELECT qid, file_path, chunk_no, sum(mult * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM p JOIN qt USING (term) JOIN idf USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, file_path, chunk_no) AS rank FROM bs {extra} QUALIFY rank <= {k})"""


def semantic_sql(chunks: str, queries: str, k: int, where: str = "") -> str:
    def encoded(rows: str, keys: str, text: str) -> str:
        return f"""(SELECT {keys}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {keys})) AS w FROM (
          SELECT {keys}, ('0x' || md5(token)[1:2])::INT AS bucket, count(*)::DOUBLE AS c FROM (SELECT {keys}, unnest({tokens.sql_tokenize(text)}) AS token FROM {rows}) GROUP BY ALL))"""

    return f"""dw AS {encoded(chunks, "file_path, chunk_no", "content")}, qw AS {encoded(queries, "qid", "query")},
ss AS (SELECT q.qid, k.file_path, k.chunk_no, coalesce(s.score, 0) AS score FROM {queries} q CROSS JOIN (SELECT file_path, chunk_no FROM {chunks}) k
  LEFT JOIN (SELECT qid, file_path, chunk_no, sum(dw.w * qw.w) AS score FROM dw JOIN qw USING (bucket) GROUP BY ALL) s USING (qid, file_path, chunk_no) {where}),
sm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, file_path, chunk_no) AS rank FROM ss QUALIFY rank <= {k})"""


FUSE_SQL = rf"""fa AS (SELECT qid, query, regexp_matches(regexp_replace(query, '^\s+|\s+$', '', 'g'), {_s(ranking.SYMBOL_QUERY)}) AS sym FROM QUERIES),
al AS (SELECT *, CASE WHEN sym THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS a FROM fa),
f0 AS (SELECT qid, file_path, chunk_no, sum(CASE WHEN sem THEN a ELSE 1 - a END / (60 + rank)) AS score
  FROM (SELECT qid, file_path, chunk_no, rank, true AS sem FROM sm UNION ALL SELECT qid, file_path, chunk_no, rank, false FROM bm) JOIN al USING (qid) GROUP BY ALL)"""
B1_SQL = """b1a AS (SELECT *, sum(score) OVER (PARTITION BY qid, file_path) AS s, row_number() OVER (PARTITION BY qid, file_path ORDER BY round(score, 9) DESC, chunk_no) AS i FROM f0),
b1b AS (SELECT *, max(score) OVER (PARTITION BY qid) AS m, max(s) OVER (PARTITION BY qid) AS top FROM b1a),
b1 AS (SELECT qid, file_path, chunk_no, score + CASE WHEN i = 1 AND m > 0 THEN 0.2 * m * s / top ELSE 0 END AS score FROM b1b),
pk AS (SELECT qid, max(score) AS m FROM b1 GROUP BY qid)"""
_DEFINES = " OR ".join(f"contains(c.content, '{kw} ' || symbol)" for kw in ranking.DEFINITION_KEYWORDS)
B2_SQL = rf"""sy AS (SELECT qid, sym, unnest(CASE WHEN sym THEN [string_split_regex(regexp_replace(query, '^\s+|\s+$', '', 'g'), '::|\\|->|\.')[-1]] ELSE list_distinct(regexp_extract_all(query, {_s("(" + ranking.EMBEDDED_SYMBOL + ")")}, 1)) END) AS symbol FROM al),
df AS (SELECT DISTINCT qid, sym, file_path, chunk_no FROM CHUNKS c JOIN sy ON ({_DEFINES})),
b2 AS (SELECT qid, file_path, chunk_no, sum(score) AS score FROM (SELECT * FROM b1 UNION ALL SELECT qid, file_path, chunk_no, m * CASE WHEN sym THEN 3 ELSE 1.5 END FROM df JOIN pk USING (qid)) GROUP BY ALL)"""
_STOP = ", ".join(map(_s, ranking.STOPWORDS))
B4_SQL = rf"""kw AS (SELECT qid, [w for w in string_split_regex(lower(query), '\s+') if strlen(w) > 2 AND w NOT IN ({_STOP})] AS words FROM al WHERE NOT sym),
b4 AS (SELECT b.qid, file_path, chunk_no, score + coalesce(CASE WHEN len(words) > 0 THEN m * len([w for w in words if len([p for p in {tokens.sql_split_identifier("lower(" + tokens.sql_stem("file_path") + ")").replace("'t'", "'t'")} if starts_with(p, left(w, 3))]) > 0]) / len(words) END, 0) AS score
  FROM b2 b JOIN pk ON b.qid = pk.qid LEFT JOIN kw ON b.qid = kw.qid)"""
FINAL_SQL = f"""b5 AS (SELECT qid, file_path, chunk_no, score * {ranking.sql_penalty("file_path")} AS score FROM b4),
b6 AS (SELECT qid, file_path, chunk_no, score * pow(0.5, row_number() OVER (PARTITION BY qid, file_path ORDER BY round(score, 9) DESC, chunk_no) - 1) AS score FROM b5)"""


def _out(scores: DataFrame) -> DataFrame:
    return scores.select("qid", "file_path", F.col("chunk_no").cast("int").alias("chunk_no"), F.round("score", 8).alias("score"))


def _index(chunks: DataFrame):
    """Postings and statistics; the texts are analysed once."""
    found, stats = _analysed(chunks)
    return lexical.postings(found), stats


def _analysed(chunks: DataFrame):
    found = scratch(lexical.analysed(chunks))
    return found, lexical.corpus_stats(lexical.doc_lengths(found))


def _sel(table: str) -> str:
    return f"SELECT qid, file_path, chunk_no::INT AS chunk_no, round(score, 8) AS score FROM {table}"


@_register("tokenize_terms", f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens.sql_tokenize('content')}) AS term FROM {DOCS}) GROUP BY term")
def tokenize_terms(spark, sf_dir):
    each = lexical.postings(lexical.analysed(corpus.documents(spark, sf_dir), stems=False))
    return each.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@_register("corpus_stats", f"SELECT count(DISTINCT file_path) AS indexed_files, count(*) AS total_chunks, count(DISTINCT lang) AS languages FROM {DOCS}")
def corpus_stats(spark, sf_dir):
    return corpus.documents(spark, sf_dir).agg(F.countDistinct("file_path").alias("indexed_files"), F.count("*").alias("total_chunks"), F.countDistinct("lang").alias("languages"))


@_register("language_histogram", f"SELECT lang, count(*) AS chunks FROM {DOCS} WHERE lang IS NOT NULL GROUP BY lang")
def language_histogram(spark, sf_dir):
    return corpus.documents(spark, sf_dir).where("lang is not null").groupBy("lang").agg(F.count("*").alias("chunks"))


@_register("doc_lengths", f"SELECT file_path, chunk_no, len({tokens.sql_tokenize(tokens.sql_enriched('content', 'file_path'))})::BIGINT AS len FROM {DOCS}")
def doc_lengths(spark, sf_dir):
    return lexical.doc_lengths(lexical.analysed(corpus.documents(spark, sf_dir)))


@_register("term_idf", f"WITH {bm25_sql(DOCS, ASKED_SQL, K)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_idf(spark, sf_dir):
    post, stats = _index(corpus.documents(spark, sf_dir))
    return lexical.term_idf(post, stats).select("term", "df", F.round("idf", 6).alias("idf"))


ONE = _values([(1, "the thing of and license")], "qid, query")


@_register("bm25_topk", f"WITH {bm25_sql(DOCS, ONE, K)} {_sel('bm')}")
def bm25_topk(spark, sf_dir):
    """The flagship: the best chunks for one query."""
    query = spark.createDataFrame([(1, "the thing of and license")], "qid int, query string")
    return _out(lexical.bm25_best(query, *_analysed(corpus.documents(spark, sf_dir)), K))


@_register("bm25_batch", f"WITH {bm25_sql(DOCS, ASKED_SQL, K)} {_sel('bm')}")
def bm25_batch(spark, sf_dir):
    return _out(lexical.bm25_best(asked(spark, sf_dir), *_analysed(corpus.documents(spark, sf_dir)), K))


@_register("bm25_filtered", f"WITH {bm25_sql(DOCS, ASKED_SQL, K, f'SEMI JOIN (SELECT file_path FROM {DOCS} WHERE lang IN (' + _s('en') + ')) USING (file_path)')} {_sel('bm')}")
def bm25_filtered(spark, sf_dir):
    """The selector: statistics of the whole corpus, results in one language only."""
    docs = corpus.documents(spark, sf_dir)
    post, stats = _index(docs)
    scores = lexical.bm25_scores(asked(spark, sf_dir), post, stats)
    chosen = docs.where(F.col("lang").isin("en")).select(*lexical.KEY)
    return _out(lexical.top_k(scores.join(chosen, list(lexical.KEY), "left_semi"), K, "bm25"))


def _kept(docs: DataFrame) -> SearchIndex:
    """Documents as an index on disk, of words alone: no query over it asks for vectors or names."""
    line = lambda name, value: F.lit(value).alias(name)
    return SearchIndex.of_chunks(docs.select(*lexical.KEY, F.col("lang").alias("language"), "content", line("start_byte", 0), F.octet_length("content").alias("end_byte"), line("start_line", 1), line("end_line", 1)), only_words=True)


@_register("bm25_index", ORACLES["bm25_batch"])
def bm25_index(spark, sf_dir):
    """The same from posting blocks in buckets, of which only those of the queries' terms are read."""
    return _out(_kept(corpus.documents(spark, sf_dir)).words(asked(spark, sf_dir), K))


@_register("bm25_pruned", ORACLES["bm25_batch"])
def bm25_pruned(spark, sf_dir):
    """The same by bounds: documents that can't be among the best are not scored."""
    index = _kept(corpus.documents(spark, sf_dir))
    terms = scratch(lexical.query_terms(asked(spark, sf_dir)))
    buckets = [r.b for r in terms.select(blocks.bucket_column("term", store.BUCKETS).alias("b")).distinct().collect()]
    df = index.store.table("df", index.commit.ids).groupBy("term").agg(F.sum("df").alias("df"))
    weights = scratch(blocks.weighed(terms, df, index.commit.n))
    post = index.store.blocks(index.commit, buckets, None).join(F.broadcast(weights.select("term").distinct()), "term", "left_semi")
    found = blocks.pruned(weights, post, index.commit.avg_len, K, scratch)
    keys = index.store.table("chunks", index.commit.ids).select("doc", *lexical.KEY)
    return _out(lexical.top_k(found.join(keys, "doc"), K, "bm25"))


@_register("index_filtered", ORACLES["bm25_filtered"])
def index_filtered(spark, sf_dir):
    """The selector as ranges of documents: blocks outside them aren't read, nothing is joined."""
    index = _kept(corpus.documents(spark, sf_dir))
    return _out(index.words(asked(spark, sf_dir), K, index.chosen(["en"], None)))


_STAYED = f"(SELECT * FROM {DOCS} WHERE doc_id % 11 <> 0)"


@_register("index_upsert", f"WITH {bm25_sql(_STAYED, ASKED_SQL, K)} {_sel('bm')}")
def index_upsert(spark, sf_dir):
    """An index of an older state of the documents, brought up by one segment of those that came, went or changed: its
    statistics and results are those of the new state."""
    docs = corpus.documents(spark, sf_dir)
    old = docs.where("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), "content")).otherwise(F.col("content")))
    came = docs.where("doc_id % 11 <> 0 and (doc_id % 7 = 0 or doc_id % 5 = 0)")
    line = lambda name, value: F.lit(value).alias(name)
    came = came.select(*lexical.KEY, F.col("lang").alias("language"), "content", line("start_byte", 0), F.octet_length("content").alias("end_byte"), line("start_line", 1), line("end_line", 1))
    index = _kept(old).upsert(came, docs.where("doc_id % 11 = 0 and doc_id % 7 <> 0").select("file_path"))
    return _out(index.words(asked(spark, sf_dir), K))


@_register("hash_embed", f"WITH {semantic_sql(DOCS, ONE, K)} SELECT file_path, bucket, round(w, 6) AS weight FROM dw")
def hash_embed(spark, sf_dir):
    rows = dense.HashEncoder().encode(corpus.documents(spark, sf_dir), "content", list(lexical.KEY))
    return rows.select("file_path", F.inline("vector")).select("file_path", "bucket", F.round("weight", 6).alias("weight"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _knn_sql(where: str, same: str = "true") -> str:
    return f"""SELECT qid, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT a.vec_id AS qid, b.vec_id, {_COS} AS similarity,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE {where} AND {same}) WHERE rank <= {K}"""


def _knn(spark, sf_dir, where):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = metric.knn(vectors.where(where).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("asked")), vectors, K)
    return found.select("qid", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@_register("cosine_topk", _knn_sql("a.vec_id = 0"))
def cosine_topk(spark, sf_dir):
    return _knn(spark, sf_dir, "vec_id = 0")


@_register("knn_batch", _knn_sql("a.vec_id % 50 = 0"))
def knn_batch(spark, sf_dir):
    """A stated query set, every id divisible by 50, against all vectors."""
    return _knn(spark, sf_dir, "vec_id % 50 = 0")


@_register("semantic_topk", f"WITH {semantic_sql(DOCS, ASKED_SQL, K)} {_sel('sm')}")
def semantic_topk(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    embedded = dense.HashEncoder().encode(docs, "content", list(lexical.KEY))
    return _out(dense.semantic_topk(asked(spark, sf_dir), embedded, K))


_ANCHORS = f"(SELECT doc_id AS qid, lang, content AS query, file_path AS anchor FROM {DOCS} WHERE doc_id % 50 = 0)"
_RELATED = f"SEMI JOIN (SELECT a.qid, d.file_path FROM {_ANCHORS} a JOIN {DOCS} d ON a.lang = d.lang AND a.anchor <> d.file_path) ok ON ok.qid = q.qid AND ok.file_path = k.file_path"


@_register("find_related", f"WITH {semantic_sql(DOCS, _ANCHORS, K, _RELATED)} {_sel('sm')}")
def find_related(spark, sf_dir):
    """For the stated anchors, the most similar chunks of the same language (of any, if theirs is null) but the anchor, filled up with zeros."""
    docs = corpus.documents(spark, sf_dir).withColumnRenamed("lang", "language")
    embedded = scratch(dense.HashEncoder().encode(docs, "content", [*lexical.KEY, "language", "doc_id"]))  # anchors are among them
    anchors = embedded.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector", "language", F.col("file_path").alias("but_path"), F.col("chunk_no").alias("but_no"))
    return _out(dense.semantic_topk(anchors, embedded, K, stored=True))


def _legs(spark, sf_dir, chunks, queries):
    embedded = dense.HashEncoder().encode(chunks, "content", list(lexical.KEY))
    depth = fusion.DEPTH * K
    return dense.semantic_topk(queries, embedded, depth), lexical.bm25_best(queries, *_analysed(chunks), depth)


def _fused(spark, sf_dir, chunks, queries):
    """Few rows for each query, which all that follows reads several times."""
    return scratch(fusion.fuse(queries, *_legs(spark, sf_dir, chunks, queries)))


def _hybrid_sql(chunks: str, queries: str, steps: str, last: str) -> str:
    return f"WITH {bm25_sql(chunks, queries, 5 * K)}, {semantic_sql(chunks, queries, 5 * K)}, {steps.replace('QUERIES', queries).replace('CHUNKS', chunks)} {last}"


@_register("rrf_fusion", _hybrid_sql(DOCS, ASKED_SQL, FUSE_SQL, _sel("f0")))
def rrf_fusion(spark, sf_dir):
    queries, docs = asked(spark, sf_dir), corpus.documents(spark, sf_dir)
    return _out(fusion.fuse(queries, *_legs(spark, sf_dir, docs, queries)))


@_register("multi_chunk_boost", _hybrid_sql(BY_SOURCE, ASKED_SQL, f"{FUSE_SQL}, {B1_SQL}", _sel("b1")))
def multi_chunk_boost(spark, sf_dir):
    queries, docs = asked(spark, sf_dir), corpus.documents_by_source(spark, sf_dir)
    return _out(fusion.boost_files(_fused(spark, sf_dir, docs, queries)))


_CODE_ASKS = _values([(i, q) for i, q in enumerate(ASKS)], "qid, query")
_CODE_SCORES = f"f0 AS (SELECT qid, file_path, chunk_no, (1.0 + length(query)) / (1 + length(content)) AS score FROM {_CODE_ASKS} q, {CODE_SQL} c)"
_CODE_FA = FUSE_SQL.split("f0 AS")[0].rstrip(", \n").replace("QUERIES", _CODE_ASKS)


def _code_scores(spark, sf_dir):
    """Every chunk scored by lengths for each of a dozen stated queries."""
    asks = spark.createDataFrame(list(enumerate(ASKS)), "qid int, query string")
    chunks = code(spark, sf_dir)
    pairs = chunks.crossJoin(F.broadcast(asks))
    return asks, fusion.declared(chunks), pairs.select("qid", *lexical.KEY, ((1.0 + F.char_length("query")) / (1 + F.char_length("content"))).alias("score"))


@_register("definition_boost", f"WITH {_CODE_FA}, {_CODE_SCORES}, {B1_SQL}, {B2_SQL.replace('CHUNKS', CODE_SQL)} {_sel('b2')}")
def definition_boost(spark, sf_dir):
    asks, names, scores = _code_scores(spark, sf_dir)
    return _out(fusion.boost_definitions(fusion.boost_files(scores), asks, names))


@_register("path_stem_boost", f"WITH {_CODE_FA}, {_CODE_SCORES}, {B1_SQL}, {B2_SQL.replace('CHUNKS', CODE_SQL)}, {B4_SQL} {_sel('b4')}")
def path_stem_boost(spark, sf_dir):
    asks, names, scores = _code_scores(spark, sf_dir)
    first = fusion.boost_files(scores)
    peak = first.groupBy("qid").agg(F.max("score").alias("m"))
    return _out(fusion.boost_stems(fusion.boost_definitions(first, asks, names), asks, peak))


ALL_PATHS = f"(SELECT path FROM {_values(PATHS, 'path')} UNION ALL SELECT path FROM {DOC_PATHS} UNION ALL SELECT url FROM pages)"


def _paths(spark, sf_dir):
    """Odd paths, one for each document, and the addresses of pages."""
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").unionByName(corpus.document_paths(spark, sf_dir))
    return rows.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path")))


@_register("path_penalty", f"SELECT path, round({ranking.sql_penalty('path')}, 6) AS penalty FROM {ALL_PATHS}")
def path_penalty(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    return paths.select("path", F.round(ranking.path_penalty(F.col("path")), 6).alias("penalty"))


@_register("file_saturation", _hybrid_sql(BY_SOURCE, ASKED_SQL, f"{FUSE_SQL}, {B1_SQL}, b4 AS (SELECT * FROM b1), {FINAL_SQL}", _sel("b6")))
def file_saturation(spark, sf_dir):
    queries, docs = asked(spark, sf_dir), corpus.documents_by_source(spark, sf_dir)
    boosted = fusion.boost_files(_fused(spark, sf_dir, docs, queries))
    return _out(fusion.saturate_files(fusion.penalise_paths(boosted)))


@_register("hybrid_topk", _hybrid_sql(BY_SOURCE, ASKED_SQL, f"{FUSE_SQL}, {B1_SQL}, {B2_SQL}, {B4_SQL}, {FINAL_SQL}", _sel(f"b6 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(b6.score, 9) DESC, file_path, b6.chunk_no) <= {K}")))
def hybrid_topk(spark, sf_dir):
    queries, docs = asked(spark, sf_dir), corpus.documents_by_source(spark, sf_dir)
    legs = [scratch(leg) for leg in _legs(spark, sf_dir, docs, queries)]
    return _out(fusion.hybrid_topk(queries, fusion.declared(docs), *legs, K))


ALL_ASKS = f"(SELECT query FROM {_values(ASKS, 'query')} UNION ALL SELECT text FROM benchmark UNION ALL SELECT DISTINCT unnest(regexp_extract_all(text, '({tokens.IDENTIFIER})', 1)) FROM benchmark)"


@_register("symbol_query_classify", rf"""SELECT query, regexp_matches(q, {_s(ranking.SYMBOL_QUERY)}) AS is_symbol, CASE WHEN regexp_matches(q, {_s(ranking.SYMBOL_QUERY)}) THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS alpha,
  list_distinct(regexp_extract_all(query, {_s('(' + ranking.EMBEDDED_SYMBOL + ')')}, 1)).list_sort() AS embedded FROM (SELECT query, regexp_replace(query, '^\s+|\s+$', '', 'g') AS q FROM {ALL_ASKS})""")
def symbol_query_classify(spark, sf_dir):
    """Odd queries, every benchmark item, and every identifier in one."""
    items = asked(spark, sf_dir)
    asks = spark.createDataFrame([(q,) for q in ASKS], "query string").unionByName(items.select("query")).unionByName(items.select(F.explode(tokens.identifiers("query")).alias("query")).distinct())
    embedded = F.array_sort(F.array_distinct(F.regexp_extract_all("query", F.lit(f"({ranking.EMBEDDED_SYMBOL})"), 1)))
    return asks.select("query", ranking.is_symbol_query(F.col("query")).alias("is_symbol"), ranking.resolve_alpha(F.col("query")).alias("alpha"), embedded.alias("embedded"))


_LINES = f"""WITH RECURSIVE ls AS (SELECT file_path, content, [l for l in regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+') if l <> ''] AS l FROM {DOCS} WHERE regexp_matches(content, '\\S')),
w AS (SELECT file_path, l, 1 AS i, 0 AS chunk_no, 0 AS cur FROM ls UNION ALL
  SELECT file_path, l, i + 1, chunk_no + CASE WHEN cur > 0 AND cur + strlen(l[i]) > 1500 THEN 1 ELSE 0 END, CASE WHEN cur > 0 AND cur + strlen(l[i]) > 1500 THEN strlen(l[i]) ELSE cur + strlen(l[i]) END FROM w WHERE i <= len(l)),
lc AS (SELECT file_path, chunk_no::INT AS chunk_no, min(i - 1)::INT AS start_line, max(i - 1)::INT AS end_line, sum(strlen(l[i - 1]))::INT AS n_bytes, string_agg(l[i - 1], '' ORDER BY i) AS content FROM w WHERE i > 1 GROUP BY ALL)"""


@_register("line_chunks", f"{_LINES} SELECT file_path, chunk_no, start_line, end_line, n_bytes, md5(content) AS digest FROM lc")
def line_chunks(spark, sf_dir):
    rows = chunking.chunk_lines(corpus.documents(spark, sf_dir).select("file_path", "content"))
    return rows.select("file_path", "chunk_no", "start_line", "end_line", (F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), F.md5(F.col("content").cast("binary")).alias("digest"))


@_register("chunk_ranges", f"{_LINES} SELECT DISTINCT file_path, start_line, end_line FROM lc")
def chunk_ranges(spark, sf_dir):
    return locate.chunk_ranges(chunking.chunk_lines(corpus.documents(spark, sf_dir).select("file_path", "content")))


_CTX = "string_split(regexp_replace(replace(d.content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))"


@_register("context_window", f"""{_LINES}, x AS (SELECT lc.file_path, lc.chunk_no, start_line AS s, least(end_line, len({_CTX})) AS e, {_CTX} AS l FROM lc JOIN {DOCS} d USING (file_path))
SELECT x.file_path, x.chunk_no, md5(array_to_string((CASE WHEN s > 1 THEN l[greatest(s - 2, 1):s - 1] || ['...'] ELSE [] END) || l[s:e] || (CASE WHEN e < len(l) THEN ['...'] || l[e + 1:e + 2] ELSE [] END), chr(10))) AS digest FROM x""")
def context_window(spark, sf_dir):
    files = corpus.documents(spark, sf_dir).select("file_path", "content")
    rows = locate.context(chunking.chunk_lines(files).select("file_path", "chunk_no", "start_line", "end_line"), files, 2)
    return rows.select("file_path", "chunk_no", F.md5(F.col("context").cast("binary")).alias("digest"))


@_register("resolve_location", f"""{_LINES}, a AS (SELECT file_path, doc_id AS aid, (doc_id % 40 + 1)::INT AS line FROM {DOCS}),
g AS (SELECT aid, file_path, chunk_no, start_line, CASE WHEN start_line <= line AND line < end_line THEN 0 WHEN line = end_line THEN 1 WHEN NOT (len(string_split(content, chr(10))) > 0 AND len([x for x in string_split(content, chr(10)) if regexp_matches(x, '\\S')]) > 0 AND len([x for x in string_split(content, chr(10)) if regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*(//|/\\*|\\*|#|<!--)')]) = 0) THEN 2 END AS grade, greatest(start_line - line, line - end_line, 0) AS gap FROM a JOIN lc USING (file_path))
SELECT aid, file_path, chunk_no, grade = 0 AS exact FROM g WHERE grade IS NOT NULL QUALIFY row_number() OVER (PARTITION BY aid ORDER BY grade, CASE WHEN grade < 2 THEN 0 ELSE gap END, CASE WHEN grade = 2 THEN -start_line ELSE 0 END, chunk_no) = 1""")
def resolve_location(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return locate.resolve(docs.select(F.col("doc_id").alias("aid"), "file_path", (F.col("doc_id") % 40 + 1).cast("int").alias("line")), chunking.chunk_lines(docs.select("file_path", "content")))


@_register("symbol_refs", f"SELECT name, count(*) AS chunks FROM (SELECT file_path, unnest(list_distinct([lower(t) for t in regexp_extract_all(content, '({tokens.IDENTIFIER})', 1)])) AS name FROM {DOCS}) GROUP BY name")
def symbol_refs(spark, sf_dir):
    return locate.symbol_refs(corpus.documents(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("chunks"))


_TRACE = _values(("handlerstack", "parsequery", "auth", "encode", "nothing"), "name")


@_register("symbol_trace", f"""WITH c AS {CODE_SQL}, d AS (SELECT unnest(names) AS name, file_path, chunk_no, start_line AS line FROM c),
r AS (SELECT name, file_path, chunk_no, line FROM (SELECT file_path, chunk_no, start_line AS line, names, unnest(list_distinct([lower(t) for t in regexp_extract_all(content, '({tokens.IDENTIFIER})', 1)])) AS name FROM c) WHERE NOT list_contains(names, name))
SELECT name, 'def' AS role, 'function' AS kind, line::INT AS line, file_path, chunk_no::INT AS chunk_no FROM d SEMI JOIN {_TRACE} t USING (name)
UNION ALL SELECT name, 'ref', CASE WHEN name IN (SELECT name FROM d) THEN 'function' ELSE 'unknown' END, line::INT, file_path, chunk_no::INT FROM r SEMI JOIN {_TRACE} t USING (name)""")
def symbol_trace(spark, sf_dir):
    names = spark.createDataFrame([("handlerstack",), ("parsequery",), ("auth",), ("encode",), ("nothing",)], "name string")
    return locate.symbol(names, code(spark, sf_dir))


@_register("trivial_doc_chunks", f"""SELECT file_path, chunk_no::INT AS chunk_no, (len(l) > 0 AND len([x for x in l if NOT regexp_matches(x, '^\\s*(//|/\\*|\\*|#|<!--)')]) = 0) AS trivial FROM (SELECT file_path, chunk_no, [x for x in string_split(content, chr(10)) if regexp_matches(x, '\\S')] AS l FROM (SELECT file_path, chunk_no, content FROM {DOCS} UNION ALL SELECT file_path, chunk_no, content FROM {CODE_SQL}))""")
def trivial_doc_chunks(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir).select(*lexical.KEY, "content").unionByName(code(spark, sf_dir).select(*lexical.KEY, "content"))
    return rows.select(*lexical.KEY, ranking.is_trivial_doc(F.col("content")).alias("trivial"))


_OLD = "(SELECT doc_id::VARCHAR AS path, n_chars AS size, 1000 + doc_id % 3 AS mtime_nanos, md5(CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0)"
_NEW = "(SELECT doc_id::VARCHAR AS path, n_chars AS size, 1000 + doc_id % 2 AS mtime_nanos, md5(text) AS hash FROM documents WHERE doc_id % 11 <> 0)"


def _snapshots(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    snapshot = lambda rows, mod, text: rows.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), (1000 + F.col("doc_id") % mod).alias("mtime_nanos"), F.md5(text.cast("binary")).alias("hash"))
    old = snapshot(docs.where("doc_id % 7 <> 0"), 3, F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("text")))
    return snapshot(docs.where("doc_id % 11 <> 0"), 2, F.col("text")), old


@_register("dirty_classify", f"SELECT n.path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.size = o.size AND n.mtime_nanos = o.mtime_nanos THEN 'clean' WHEN n.hash = o.hash THEN 'touched' ELSE 'changed' END AS state FROM {_NEW} n LEFT JOIN {_OLD} o USING (path)")
def dirty_classify(spark, sf_dir):
    """Two snapshots made of the documents table: files that came, went, were touched or rewritten."""
    return incremental.classify(*_snapshots(spark, sf_dir))


@_register("deleted_files", f"SELECT path FROM {_OLD} o ANTI JOIN {_NEW} n USING (path)")
def deleted_files(spark, sf_dir):
    return incremental.deleted(*_snapshots(spark, sf_dir))


_LEDGER = f"(SELECT CASE WHEN turn = 3 THEN NULL ELSE {NOW} - conv_id * 3600 END AS ts, role AS call, turn AS results, length(text) AS snippet_chars, conv_id * 10 AS file_chars FROM conversations)"


@_register("savings_summary", f"""WITH l AS {_LEDGER}, d AS (SELECT *, (TIMESTAMP '1970-01-01' + to_seconds(ts))::DATE AS day, (TIMESTAMP '1970-01-01' + to_seconds({NOW}))::DATE AS today FROM l),
e AS (SELECT 'All time' AS bucket, * FROM d UNION ALL SELECT 'Last 7 days', * FROM d WHERE day >= today - 7 UNION ALL SELECT 'Today', * FROM d WHERE day = today)
SELECT bucket, count(call) AS calls, coalesce(sum(snippet_chars), 0)::BIGINT AS snippet_chars, coalesce(sum(file_chars), 0)::BIGINT AS file_chars, coalesce(sum(greatest(file_chars - snippet_chars, 0)), 0)::BIGINT AS saved_chars
FROM (SELECT unnest(['All time', 'Last 7 days', 'Today']) AS bucket) b LEFT JOIN e USING (bucket) GROUP BY bucket""")
def savings_summary(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ledger = talk.select(F.when(F.col("turn") == 3, None).otherwise(NOW - F.col("conv_id") * 3600).cast("double").alias("ts"), F.col("role").alias("call"), F.col("turn").alias("results"), F.char_length("text").cast("bigint").alias("snippet_chars"), (F.col("conv_id") * 10).alias("file_chars"))
    return savings.summary(savings.cleaned(ledger), NOW)


@_register("savings_calls", "SELECT role AS call, count(*) AS n FROM conversations GROUP BY role")
def savings_calls(spark, sf_dir):
    return savings.calls(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("role").alias("call")))


_LANGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in corpus.EXTENSIONS.items()) + "}"


@_register("detect_language", f"SELECT path, {_LANGS}[lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))] AS language FROM {ALL_PATHS}")
def detect_language(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", corpus.detect_language(F.col("path")).alias("language"))


SOURCES = (("a.py", "import os\n\n\nclass Loader:\n    def run(self):\n        pass\n\n\ndef compute(x):\n    return x\n", "python"), ("b.rs", "pub struct Config { a: u8 }\n\nfn one() -> u8 { 1 }\n\ntrait Greet { fn hi(&self); }\n", "rust"), ("c.rb", "module Helpers\n  def hello\n  end\nend\n", "ruby"), ("d.go", "package main\n\nfunc Add(a int) int {\n\treturn a\n}\n", "go"), ("e.txt", "plain\ntext\n", None))


#: One class of some 17 kB, which has to be cut at its members.
LARGE = ("Big.java", "public class Big {\n" + "".join(f"    int method{i}(int x) {{\n" + "        x = x + 1;\n" * 20 + "        return x;\n    }\n\n" for i in range(40)) + "}\n", "java")


def _files(spark, sf_dir):
    """Every document as a Markdown file, and source files of several languages."""
    docs = corpus.documents(spark, sf_dir).select("file_path", "content", F.lit("markdown").alias("language"))
    return docs.unionByName(spark.createDataFrame([*SOURCES, LARGE], "file_path string, content string, language string"))


@_register("structural_chunks")
def structural_chunks(spark, sf_dir):
    return chunking.chunk_files(_files(spark, sf_dir)).drop("symbols")


@_register("extract_definitions")
def extract_definitions(spark, sf_dir):
    return locate.symbol_defs(chunking.chunk_files(_files(spark, sf_dir)))
