"""Anchors without a language or without words still have results."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quernal.operators import dense
from quernal.plans import queries


def test_anchors_of_odd_rows(spark, tmp_path):
    rows = [(0, "alpha beta", None, "s1", 10), (50, "漢字", "zh", "s1", 2), *((i, f"alpha text{i}", "en" if i % 2 else "zh", "s1", 9) for i in range(1, 16))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.find_related(spark, str(tmp_path)).collect():
        got.setdefault(r.qid, []).append((r.file_path, r.score))
    assert len(got[0]) == queries.K and {"s1/doc_0.txt"}.isdisjoint(p for p, _ in got[0]) and any(s > 0 for _, s in got[0])
    # all seven others in its language, by path, for they share no word with it
    assert got[50] == sorted((f"s1/doc_{i}.txt", 0.0) for i in range(2, 16, 2))


def _corpus(n, seed=7):
    """Chunks of few words, so that many tie, with copies, empty ones, and languages of which one is null."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randrange(1, 9))) for _ in range(n // 3)]
    return [(f"f{rng.randrange(n)}_{i}.py", i % 3, rng.choice([None, "en", "en", "fr"]), "" if i % 50 == 1 else rng.choice(texts)) for i in range(n)]


def _best(rows, vectors, query, k):
    """Plain: all of the language but the chunk itself, by (score, key)."""
    path, no, language, _ = rows[query]
    others = [i for i, r in enumerate(rows) if (language is None or r[2] == language) and r[:2] != (path, no)]
    scores = {i: float(vectors[i] @ vectors[query]) for i in others}
    return [(rows[i][:2], round(scores[i], 8)) for i in sorted(others, key=lambda i: (-round(scores[i], 9), rows[i][:2]))[:k]]


def _encoded(rows):
    found = pa.record_batch({"key": pa.array(range(len(rows))), "text": [r[3] for r in rows]})
    vectors = pa.concat_arrays([part.column("vector") for part in dense._hashed(iter([found]))])
    return vectors, dense._matrix(vectors, dense.BUCKETS)


@pytest.mark.parametrize(("few", "size"), [(0, 16), (1 << 40, 16), (64, 50), (4096, 5000)])
def test_a_task_finds_what_plain_python_finds(monkeypatch, few, size):
    monkeypatch.setattr(dense, "FEW", few)
    monkeypatch.setattr(dense, "ROWS", size)
    monkeypatch.setattr(dense, "MOST_QUERIES", 7)
    rows, k = _corpus(900), 6
    vectors, matrix = _encoded(rows)
    asked = list(range(0, len(rows), 9))
    columns = [pa.array([rows[i][c] for i in asked], t) for c, t in ((2, pa.string()), (0, pa.string()), (1, pa.int32()))]
    queries = pa.table([pa.array(asked), *columns, vectors.take(pa.array(asked))], names=["qid", "language", "but_path", "but_no", "vector"])
    chunks = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), vectors, pa.array([r[2] for r in rows], pa.string())], names=["file_path", "chunk_no", "vector", "language"])
    got = {}
    for part in dense._nearest(SimpleNamespace(value=dense._Asked(queries, dense.BUCKETS)), dense.BUCKETS, k)(chunks.slice(i, 130) for i in range(0, len(rows) + 130, 130)):
        for r in part.to_pylist():
            got.setdefault(r["qid"], []).append(((r["file_path"], r["chunk_no"]), round(r["score"], 8)))
    assert {i: found for i in asked if (found := _best(rows, matrix, i, k))} == got


def test_few_rows_of_a_task_and_each_text_is_encoded_once(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(60)], k=6)), "en" if i % 4 else "fr", "s", 9) for i in range(9000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    passed, encoded, top_k, encode = [], spark.sparkContext.accumulator(0), dense.top_k, dense.HashEncoder.encode

    def counted(found):
        for batch in found:
            encoded.add(len(batch))
            yield batch

    def spy(scores, k, source):
        passed.append((scores.count(), scores.rdd.getNumPartitions()))
        return top_k(scores, k, source)

    monkeypatch.setattr(dense, "top_k", spy)
    monkeypatch.setattr(dense.HashEncoder, "encode", lambda self, chunks, text, keys: encode(self, chunks.mapInArrow(counted, chunks.schema), text, keys))
    got = {}
    for r in sorted(queries.find_related(spark, str(tmp_path)).collect(), key=lambda r: (-r.score, r.file_path)):
        got.setdefault(r.qid, []).append(((r.file_path, r.chunk_no), r.score))
    (sent, tasks), = passed
    assert sent <= len(got) * queries.K * tasks
    assert encoded.value == len(rows)
    plain = [(f"s/doc_{i}.txt", 0, lang, text) for i, text, lang, _, _ in rows]
    _, matrix = _encoded(plain)
    assert all(sorted(found) == sorted(_best(plain, matrix, qid, queries.K)) for qid, found in list(got.items())[::20]) and len(got) == 180
