"""Unit cases of the search operators and the index over a small tree."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernal.functions import ranking, tokens
from quernal.operators import chunking, locate, metric, savings, structure
from quernal.plans import queries, render
from quernal.plans.index import SearchIndex
from quernal.sources import files

SMALL = "/root/testdata/sf0.001"


def test_split_identifier(spark):
    cases = {"HandlerStack": ["handlerstack", "handler", "stack"], "my_func": ["my_func", "my", "func"], "simple": ["simple"], "my_fooBar": ["my_foobar", "my", "foobar"], "XMLHttpRequest": ["xmlhttprequest", "xml", "http", "request"], "HTTP2Server": ["http2server"], "__": ["__"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tokens.split_identifier(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == cases


def test_path_stem(spark):
    cases = {"a/b.tar.gz": "b.tar", ".rs": ".rs", "Makefile": "Makefile", "a.b/c": "c"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", tokens.path_stem("p").alias("s")).collect()
    assert {r.p: r.s for r in rows} == cases


def test_symbol_queries(spark):
    cases = {"HandlerStack": True, "_x": True, "a::b": True, "foo->bar": True, "encode": False, "authentication flow": False, "Auth": True}
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", ranking.is_symbol_query(F.col("q")).alias("s")).collect()
    assert {r.q: r.s for r in rows} == cases


def test_line_chunks_tile(spark):
    text = "".join(f"line {i} é\n" for i in range(400)) + "x" * 4000 + "\nend"
    rows = chunking.chunk_lines(spark.createDataFrame([("f", text), ("blank", " \n\t\n"), ("n", None)], "file_path string, content string")).orderBy("chunk_no").collect()
    assert {r.file_path for r in rows} == {"f"} and "".join(r.content for r in rows) == text
    assert [(r.start_byte, r.end_byte) for r in rows] == structure.line_ranges(text.encode())
    assert rows[-1].end_line == text.count("\n") + 1


@pytest.mark.parametrize(
    ("language", "source", "wanted"),
    [
        ("rust", "mod helpers {}\nfn one() {}\nstruct Config;\nenum Kind { A }\ntrait Greet { fn hi(&self); }\nconst MAX: u8 = 1;\n", {("one", "function"), ("config", "struct"), ("kind", "enum"), ("greet", "trait"), ("hi", "function"), ("max", "constant"), ("helpers", "module")}),
        ("python", "def compute():\n    pass\nclass Loader:\n    def run(self):\n        pass\n", {("compute", "function"), ("loader", "class"), ("run", "function")}),
        ("ruby", "module Helpers\n  class Greeter\n    def hello\n    end\n    def self.greet\n    end\n  end\nend\n", {("greeter", "class"), ("helpers", "module"), ("hello", "method"), ("greet", "method")}),
        ("typescript", "interface Task { id: number }\ntype UserId = string\nfunction fetchTask() {}\nclass Repo {\n}\n", {("task", "interface"), ("userid", "type"), ("fetchtask", "function"), ("repo", "class")}),
        ("go", "func Add(a int) int { return a }\ntype Store struct {}\nfunc (s *Store) Get() {}\n", {("add", "function"), ("store", "type"), ("get", "method")}),
        ("java", "class Main {\n  int compute(int a) { return a; }\n}\ninterface Reader {\n  String read();\n}\n", {("main", "class"), ("compute", "method"), ("reader", "interface"), ("read", "method")}),
    ],
)
def test_definitions(language, source, wanted):
    assert {(n, k) for n, k, _, _ in structure.definitions(source, language)} == wanted
    assert structure.chunks(source, language)


def test_structure_falls_back_to_lines():
    assert [c["content"] for c in structure.chunks("def broken(:\n", "python")] == ["def broken(:\n"]
    assert structure.chunks("  \n", "python") == []


def test_cosine_and_zero_vector(spark):
    vectors = spark.createDataFrame([(0, [1.0] * 8), (1, [0.7] * 8), (2, [-1.0] * 8), (3, [0.0] * 8)], "vec_id int, embedding array<float>")
    found = metric.knn(spark.createDataFrame([(9, [1.0] * 8)], "qid int, asked array<float>"), vectors, 4).collect()
    assert [(r.vec_id, round(r.similarity, 6)) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1.0), (1, 1.0), (3, 0.0), (2, -1.0)]


def test_resolve_and_context(spark):
    chunks = spark.createDataFrame([("f", 0, 1, 10, "a\nb"), ("f", 1, 40, 50, "c"), ("f", 2, 60, 61, "// doc")], "file_path string, chunk_no int, start_line int, end_line int, content string").withColumn("symbols", F.expr("cast(array() as array<struct<name:string,kind:string,line:int>>)"))
    anchors = spark.createDataFrame([(1, "f", 5), (2, "f", 25), (3, "f", 99), (4, "g", 1)], "aid int, file_path string, line int")
    got = {r.aid: (r.chunk_no, r.exact) for r in locate.resolve(anchors, chunks).collect()}
    assert got == {1: (0, True), 2: (1, False), 3: (1, False)}
    lines = spark.createDataFrame([("f", "\r\n".join(f"line {i}" for i in range(1, 21)) + "\r\n")], "file_path string, content string")
    found = spark.createDataFrame([("f", 5, 7), ("f", 1, 2), ("f", 18, 20), ("g", 1, 2)], "file_path string, start_line int, end_line int")
    got = [r.context for r in locate.context(found, lines, 2).orderBy("file_path", "start_line").collect()]
    assert got[1].split("\n") == ["line 3", "line 4", "...", "line 5", "line 6", "line 7", "...", "line 8", "line 9"]
    assert got[0].split("\n")[-1] == "line 4" and got[2].split("\n")[0] == "line 16" and got[2].split("\n")[-1] == "line 20" and got[3] is None


def test_walk_and_index(spark, tmp_path):
    tree = tmp_path / "tree"
    for path, text in {"main.rs": "pub struct HandlerStack;\nfn run() {}\n", "_private/x.py": "def parse_query():\n    return HandlerStack\n", ".gitignore": "build/\n*.go\n!keep.go\n", "build/b.rs": "fn b() {}", "x.go": "package x", "keep.go": "package keep\n", "notes.txt": "no", "node_modules/m.js": "function m() {}", "bad.py": b"\xff\xfe"}.items():
        p = tree / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    assert sorted(r.file_path for r in files.walk(spark, str(tree), files.extensions()).collect()) == ["_private/x.py", "bad.py", "keep.go", "main.rs"]
    home = str(tmp_path / "home")
    index = SearchIndex.refresh(spark, str(tree), home)
    assert {r.file_path for r in index.tables["chunks"].collect()} == {"main.rs", "_private/x.py", "keep.go"}
    top = index.search("HandlerStack", k=2).collect()
    assert top[0].file_path == "main.rs" and index.search("  ", k=2).count() == 0
    assert {(r.role, r.file_path) for r in index.symbol("handlerstack").collect()} == {("def", "main.rs"), ("ref", "_private/x.py")}
    assert index.find_related("main.rs", 1, 3).count() == 0
    assert index.search("stack", k=3, mode="bm25", languages=["python"]).count() <= 1
    with pytest.raises(ValueError):
        index.search("x", k=0)
    (tree / "main.rs").write_text("fn other() {}\n")
    (tree / "keep.go").unlink()
    again = SearchIndex.refresh(spark, str(tree), home)
    assert {(r.file_path, r.content.strip()) for r in again.tables["chunks"].collect()} == {("main.rs", "fn other() {}"), ("_private/x.py", "def parse_query():\n    return HandlerStack")}
    # segments stay for those who still read them
    assert len(os.listdir(f"{home}/chunks")) == 2 and index.search("HandlerStack", k=2).count() == 2
    SearchIndex.clear(spark, home)
    assert SearchIndex.open(spark, home) is None


def test_git_urls_and_sizes():
    assert files.is_git_url("https://x/y.git") and files.is_git_url("git@host:x") and not files.is_git_url("/a@b:c") and not files.is_git_url("dir")
    assert [render.human_size(n) for n in (0, 512, 2048, 3 << 20)] == ["0 B", "512 B", "2.00 KiB", "3.00 MiB"]


def test_savings(spark, tmp_path):
    now = 1_700_000_000
    lines = [{"ts": now, "call": "search", "snippet_chars": 10, "file_chars": 50}, {"ts": now - 6 * 86400, "call": "search", "snippet_chars": 90, "file_chars": 50}, {"ts": now - 9 * 86400, "file_chars": -5}, {"call": "find_related", "file_chars": 7}]
    path = tmp_path / "ledger.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = {r.bucket: (r.calls, r.saved_chars) for r in savings.summary(savings.read(spark, str(path)), now).collect()}
    assert rows == {"Today": (1, 40), "Last 7 days": (2, 40), "All time": (4, 47)}


def test_ranked_limit_before_the_shuffle(spark):
    plan = queries.QUERIES["bm25_batch"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["bm25_topk", "tokenize_terms", "hybrid_topk", "line_chunks", "savings_summary", "dirty_classify", "context_window", "bm25_index", "bm25_pruned", "index_filtered", "index_upsert"])
def test_oracles(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings", "pages", "labels"):
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_entry_has_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
