"""What tasks hold and send stays bounded while tables grow, with the results of the plain forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernal.functions import batches
from quernal.operators import dense, fusion, lexical


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(4)
    rows = [(f"f{i % 7}.py", i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randrange(12)))) for i in range(300)]
    return spark.createDataFrame([*rows, *[("copy.py", i, rows[5][2]) for i in range(20)], ("none.py", 0, None)], "file_path string, chunk_no int, content string")


def rows_of(found):
    return sorted((r.qid, r["rank"], r.file_path, r.chunk_no, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize(("cells", "most"), [(1 << 19, 1000), (1, 1000), (1 << 19, 1)])
def test_scores_of_tasks_are_those_of_joins(spark, chunks, monkeypatch, cells, most):
    queries = spark.createDataFrame([(0, "w1 w2 w2"), (1, "nothing"), (2, ""), (3, "w3 w4 w5 w6 w7")], "qid int, query string")
    found = lexical.analysed(chunks)
    stats = lexical.corpus_stats(lexical.doc_lengths(found))
    want = rows_of(lexical.bm25_topk(queries, lexical.postings(found), stats, 10))
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", most)
    assert rows_of(lexical.bm25_best(queries, found, stats, 10)) == want != []
    assert lexical.bm25_best(queries.where("qid = 2"), found, stats, 10).count() == 0


def test_a_worker_remembers_few_identifiers():
    tokens = batches.Tokens()
    text = " ".join(f"someName{i}" for i in range(60_000))
    found = tokens.count(text) + tokens.count(text)
    for start in range(0, 60_000, 10_000):
        tokens.count(" ".join(f"otherName{i}" for i in range(start, start + 10_000)))
    assert len(tokens.known) <= 30_000
    assert found == Counter({token: n * 2 for token, n in batches.Tokens().count(text).items()})


def test_files_gain_without_a_window(spark):
    rows = [(1, "a", 0, 1.0), (1, "a", 1, 3.0), (1, "a", 1, 3.0), (1, "b", 0, 2.0), (1, None, 4, 2.5), (1, None, 3, 2.5), (2, "a", 0, 0.0)]
    found = fusion.boost_files(spark.createDataFrame(rows, "qid int, file_path string, chunk_no int, score double"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = Counter((r.qid, r.file_path, r.chunk_no, round(r.score, 9)) for r in found.collect())
    assert got == Counter([(1, "a", 0, 1.0), (1, "a", 1, 3.6), (1, "a", 1, 3.0), (1, "b", 0, round(2 + 0.6 * 2 / 7, 9)), (1, None, 3, round(2.5 + 0.6 * 5 / 7, 9)), (1, None, 4, 2.5), (2, "a", 0, 0.0)])


def test_texts_are_encoded_once_for_all_passes(spark, chunks, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(found):
        for batch in found:
            read.add(len(batch))
            yield batch

    rows = dense.HashEncoder().encode(chunks.where("content is not null"), "content", ["file_path", "chunk_no"]).withColumn("language", F.when(F.col("chunk_no") % 2 == 0, "x"))
    seen = rows.mapInArrow(counted, rows.schema)
    asked = chunks.where("chunk_no % 20 = 0 and content is not null").select(F.hash("file_path", "chunk_no").alias("qid"), F.col("content").alias("query"), F.lit("x").alias("language"), F.col("file_path").alias("but_path"), F.col("chunk_no").alias("but_no"))
    whole = dense.semantic_topk(asked, rows, 5)
    want = rows_of(whole)
    monkeypatch.setattr(dense, "MOST_SHARED", 4)
    assert rows_of(dense.semantic_topk(asked, seen, 5)) == want and read.value == rows.count()
    assert all(no % 2 == 0 for _, _, _, no, _ in want)
