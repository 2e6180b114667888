"""What a refresh reads and writes, broken caches, sessions, the ledger and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quernal import cli
from quernal.functions import batches, tokens
from quernal.operators import chunking, dense, fusion, lexical, savings
from quernal.plans import index as plans
from quernal.plans import session, storage, store
from quernal.plans.index import SearchIndex
from quernal.sources import files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("import os\n\ndef alpha():\n    return 'one'\n")
    (root / "b.rs").write_text("fn beta() { alpha(); }\n")
    (root / "note.md").write_text("# gamma\n\ntext of alpha\n")
    return root


def segments(home):
    return sorted(os.listdir(f"{home}/chunks"))


def test_unchanged_tree_writes_nothing(spark, tree, tmp_path):
    home = str(tmp_path / "home")
    first = SearchIndex.refresh(spark, str(tree), home)
    before = segments(home)
    again = SearchIndex.refresh(spark, str(tree), home)
    assert segments(home) == before and len(before) == 1 and again.commit == first.commit
    assert first.search("alpha", k=2).count() == again.search("alpha", k=2).count() == 2


def test_only_changed_files_are_read_and_embedded(spark, tree, tmp_path, monkeypatch):
    home = str(tmp_path / "home")
    old = SearchIndex.refresh(spark, str(tree), home)
    (tree / "b.rs").write_text("fn delta() {}\n")
    os.utime(tree / "a.py", ns=(1, 1))  # touched
    (tree / "c.go").write_text("package c\n\nfunc Epsilon() {}\n")
    read, made = [], []
    real_read, real_write = plans.read_files, store.Store.write
    monkeypatch.setattr(plans, "read_files", lambda rows, root: read.append({r.file_path for r in rows.collect()}) or real_read(rows, root))
    monkeypatch.setattr(store.Store, "write", lambda self, chunks, *a, **b: made.append({r.file_path for r in chunks.collect()}) or real_write(self, chunks, *a, **b))
    new = SearchIndex.refresh(spark, str(tree), home)
    assert read == [{"a.py", "b.rs", "c.go"}] and made == [{"b.rs", "c.go"}]
    assert {r.file_path for r in new.symbol("alpha").collect()} == {"a.py"}
    assert {r.file_path for r in new.symbol("delta").collect()} == {"b.rs"} and new.symbol("beta").count() == 0
    fresh = SearchIndex.of_tree(spark, str(tree))
    for name in ("chunks", "embedded", "declared", "defs", "refs"):
        rows = lambda ix: sorted(repr(r.asDict(True)) for r in ix.tables[name].select(*sorted(set(ix.tables[name].columns) - {"doc"})).collect())  # noqa: B023, E731
        assert rows(new) == rows(fresh), name
    assert {r.path: r.mtime_nanos for r in new.tables["manifest"].collect()}["a.py"] == 1
    assert old.search("beta", k=3).count() > 0  # an index that is still open goes on
    (tree / "c.go").unlink()
    assert SearchIndex.refresh(spark, str(tree), home).symbol("epsilon").count() == 0


def test_broken_cache_counts_as_none(spark, tree, tmp_path):
    home = str(tmp_path / "home")
    SearchIndex.refresh(spark, str(tree), home)
    (segment,) = segments(home)
    os.remove(f"{home}/names/{segment}/_SUCCESS")
    assert SearchIndex.open(spark, home) is None
    assert SearchIndex.refresh(spark, str(tree), home).search("alpha", k=1).count() == 1
    last = sorted(n for n in os.listdir(f"{home}/commits") if n.endswith(".json"))[-1]
    with open(f"{home}/commits/{last}") as f:
        good = json.load(f)
    for odd in ("", "{", "[]", '{"version": 1}', json.dumps(good | {"version": 2}), json.dumps(good | {"segments": [{"id": 99, "docs": 1, "bucketed": False, "languages": []}]})):
        with open(f"{home}/commits/{last}", "w") as f:
            f.write(odd)
        for crc in os.listdir(f"{home}/commits"):
            if crc.endswith(".crc"):
                os.remove(f"{home}/commits/{crc}")
        assert SearchIndex.open(spark, home) is None
    assert SearchIndex.refresh(spark, str(tree), home).search("alpha", k=1).count() == 1  # built anew on top


def test_no_supported_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    for build in (lambda: SearchIndex.of_tree(spark, str(tmp_path)), lambda: SearchIndex.refresh(spark, str(tmp_path), str(tmp_path / "home"))):
        with pytest.raises(ValueError, match="no supported files"):
            build()


def test_session_tells_indexes_apart(spark, tree, tmp_path):
    held = session.Session(spark, str(tmp_path / "cache"))
    assert held.get(str(tree)).stats().first().indexed_files == 2
    assert held.get(str(tree), include_text=True).stats().first().indexed_files == 3
    assert held.get(str(tree)) is held.get(str(tree)) and len(held.held) == 2
    assert session.Session(spark, None).get(str(tree)).stats().first().indexed_files == 2


def test_filters_and_context(spark, tree, tmp_path):
    index = SearchIndex.refresh(spark, str(tree), str(tmp_path / "home"))
    assert index.search("alpha", languages=["cobol"]).count() == 0
    assert index.search("alpha", languages=["cobol"], lenient_filters=True).count() == 2
    assert {r.file_path for r in index.search("alpha", paths=["b.rs"], languages=["cobol"]).collect()} == {"b.rs"}
    rows = {r.file_path: r for r in index.search("alpha", context=1).collect()}
    assert rows["b.rs"].context == "fn beta() { alpha(); }"
    (tree / "b.rs").unlink()
    assert {r.file_path: r.context for r in index.search("alpha", context=1).collect()}["b.rs"] is None


def test_searches_are_logged(spark, tree, tmp_path):
    ledger = str(tmp_path / "ledger")
    index = SearchIndex.refresh(spark, str(tree), str(tmp_path / "home"), ledger=ledger)
    hit = index.search("alpha", k=1).first()
    assert index.find_related("a.py", 3, k=1).count() == 0
    (row,) = [r for r in savings.read(spark, ledger).collect() if r.call == "search"]
    assert (row.results, row.file_chars, row.snippet_chars) == (1, os.path.getsize(tree / hit.file_path), len(hit.content.encode()))
    assert {r.call for r in savings.read(spark, ledger).collect()} == {"search", "find_related"}


def test_batches_are_logged_and_tables_in_between_go(spark, tree, tmp_path):
    ledger = str(tmp_path / "ledger")
    index = SearchIndex.refresh(spark, str(tree), str(tmp_path / "home"), ledger=ledger)
    queries = spark.createDataFrame([(1, "alpha"), (2, "zzz")], "qid int, query string")
    assert index.batch(queries, 3, "bm25").count() == 2
    assert sorted(r.results for r in savings.read(spark, ledger).collect()) == [0, 2]
    root = storage.Folder(spark, storage.scratch_root(spark))
    before = set(root.names())
    assert index.search("alpha", 2, "hybrid").count() == 2
    assert len(set(root.names()) - before) <= 1  # the rows that the ledger has read


def test_numbers_of_a_ledger(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text('{"ts": 5, "call": "search", "results": 2.5, "snippet_chars": "x", "file_chars": 7}\n{"ts": 6, "snippet_chars": -4, "file_chars": null}\n[1]\nnot json\n')
    got = sorted((r.ts, r.call, r.results, r.snippet_chars, r.file_chars) for r in savings.read(spark, str(path)).where("ts is not null").collect())
    assert got == [(5.0, "search", 0, 0, 7), (6.0, "unknown", 0, 0, 0)]


def test_command_line(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setenv("QUERNAL_LEDGER", str(tmp_path / "ledger"))
    assert cli.main(["savings"]) == "nothing is logged yet" == cli.main(["savings", "--ledger", "none"])
    common = ["--source", str(tree), "--cache", str(tmp_path / "cache")]
    assert "not cached" in cli.main(["info", *common])
    assert "2 files" in cli.main(["stats", *common]) and "cached" in cli.main(["info", *common])
    found = cli.main(["search", "alpha", "-k", "1", "--context", "2", "--path", "a.py", *common])
    assert "## 1. a.py:" in found and "```python" in found and "return 'one'" in found
    assert "Defined at" in cli.main(["symbol", "alpha", *common]) and "fn beta()" in cli.main(["symbol", "alpha", *common])
    assert "# beta" in cli.main(["symbols-at", "b.rs", "1", *common])
    assert cli.main(["related", "a.py", "3", *common]).startswith("# related")
    assert "Nothing found" in cli.main(["search", "zzz", "--mode", "bm25", *common]) and "hybrid" in cli.main(["search", "zzz", "--mode", "bm25", *common])
    assert "3 calls" in cli.main(["savings"]).split("All time")[1].splitlines()[0] or "4 calls" in cli.main(["savings"])
    assert "1 indexes" in cli.main(["status", *common])
    cli.main(["clear", *common])
    assert "0 indexes" in cli.main(["status", *common])


def test_batches_split_like_expressions(spark):
    odd = ["HandlerStack", "my_func", "my_fooBar", "XMLHttpRequest", "HTTP2Server", "__", "_a_", "aB", "ABc", "aBCd", "A1b2C3", "x" * 500, "parseHTTPResponse2x"]
    text = " ".join(odd) + " é漢 a-b.c MAX_len"
    rows = spark.createDataFrame([(0, "src/fooBar_test.rs", 0, text), (1, "x", 1, ""), (2, "y", 2, None)], "id int, file_path string, chunk_no int, content string")
    found = {r.chunk_no: r for r in lexical.analysed(rows).collect()}
    native = rows.select("chunk_no", tokens.enriched_tokens(F.coalesce("content", F.lit("")), "file_path").alias("t"), tokens.counted(tokens.enriched_tokens(F.coalesce("content", F.lit("")), "file_path"), "term", "tf").alias("n")).collect()
    for row in native:
        own = found[row.chunk_no]
        assert own.len == len(row.t) and sorted((t.term, t.tf) for t in own.terms) == sorted((t, row.t.count(t)) for t in set(row.t)) == [(x.term, x.tf) for x in row.n]
    assert all(list(batches.split(t)) == spark.range(1).select(tokens.split_identifier(F.lit(t)).alias("s")).first().s for t in odd[:4])


def test_declared_names_meet_symbols(spark):
    rows = [("a", 0, "class def Foo {"), ("b", 0, "undef encodeAll"), ("c", 0, "define encode"), ("d", 0, "defmodule Foo"), ("e", 0, "fn  Foo")]
    chunks = spark.createDataFrame(rows, "file_path string, chunk_no int, content string")
    got = {(r.name, r.file_path) for r in fusion.declared(chunks).collect()}
    assert got == {("def", "a"), ("Foo", "a"), ("encodeAll", "b"), ("Foo", "d")}


def test_many_symbols_meet_names_by_equality(spark, monkeypatch):
    names = spark.createDataFrame([("encodeAll", "a", 0), ("Foo", "b", 0), ("Foo", "b", 1), ("Fo", "c", 0), ("bar", "d", 0)], "name string, file_path string, chunk_no int")
    asks = spark.createDataFrame([(0, "Foo"), (1, "x::encode"), (2, "use FooBar or MyParser"), (3, "F"), (4, "nothing to find")], "qid int, query string")
    scores = spark.createDataFrame([(i, "b", 0, 1.0 + i) for i in range(5)], "qid int, file_path string, chunk_no int, score double")
    want = sorted(fusion.boost_definitions(scores, asks, names).collect())
    monkeypatch.setattr(fusion, "BROADCAST_SYMBOLS", 0)
    assert sorted(fusion.boost_definitions(scores, asks, names).collect()) == want
    assert {(r.qid, r.file_path) for r in want} > {(0, "b"), (1, "a"), (3, "c")}


def test_queries_in_passes(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"f{i % 7}", i, f"word{i} alpha beta{i % 3}") for i in range(40)], "file_path string, chunk_no int, content string")
    asks = spark.createDataFrame([(i, f"word{i} beta{i % 3}") for i in range(11)] + [(11, "")], "qid int, query string")
    embedded = dense.HashEncoder().encode(chunks, "content", list(lexical.KEY))
    want = sorted(dense.semantic_topk(asks, embedded, 5).collect())
    monkeypatch.setattr(dense, "MOST_SHARED", 4)
    assert sorted(dense.semantic_topk(asks, embedded, 5).collect()) == want and len(want) == 60


def test_token_tables(spark, tmp_path):
    spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 2.0])], "term string, vector array<double>").write.parquet(f"{tmp_path}/table")
    encoder = dense.TableEncoder.load(spark, f"{tmp_path}/table")
    chunks = spark.createDataFrame([("a", 0, "alpha alpha beta"), ("b", 0, "beta"), ("c", 0, "nothing")], "file_path string, chunk_no int, content string")
    found = dense.semantic_topk(spark.createDataFrame([(1, "alpha")], "qid int, query string"), encoder.encode(chunks, "content", ["file_path", "chunk_no"]), 3, encoder).orderBy("rank").collect()
    assert [(r.file_path, round(r.score, 4)) for r in found] == [("a", 0.7071), ("b", 0.0), ("c", 0.0)]
    spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "term string, vector array<double>").write.parquet(f"{tmp_path}/odd")
    with pytest.raises(ValueError):
        session.load_encoder(spark, f"{tmp_path}/odd")


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "big.py").write_bytes(b"x" * (files.MOST_BYTES + 1))
    (tmp_path / "odd.py").write_bytes(b"\xff")
    assert [files.read_file(str(tmp_path), p) for p in ("big.py", "odd.py", "none.py")] == [None] * 3
    assert files.normalise_path(str(tmp_path), str(tmp_path / "odd.py")) == "odd.py" and files.normalise_path(str(tmp_path), "/else.py") == "/else.py"


def test_long_texts_are_cut_in_linear_time(spark):
    text = "some words of a line\n" * 400_000
    rows = chunking.chunk_lines(spark.createDataFrame([("f", text)], "file_path string, content string")).select("start_byte", "end_byte", "start_line", "end_line").orderBy("start_byte").collect()
    assert rows[0].start_byte == 0 and rows[-1].end_byte == len(text) and all(a.end_byte == b.start_byte and a.end_line + 1 == b.start_line for a, b in zip(rows, rows[1:]))
    assert rows[-1].end_line == 400_000
