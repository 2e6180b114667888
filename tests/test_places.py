"""Lines and chunks by an as-of join, trees listed by tasks, subwords, and streams into an index: against plain Python."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernal import streaming
from quernal.operators import dense, locate
from quernal.plans import session
from quernal.plans.index import SearchIndex
from quernal.plans.store import Store
from quernal.sources import files

SYMBOLS = "array<struct<name:string,kind:string,line:int>>"


def resolved(line, chunks):
    """The chunk at a line by looking at each; chunks (no, start, end, has symbols, trivial)."""
    best = None
    for no, s, e, has, trivial in chunks:
        grade = 0 if s <= line < e else 1 if line == e else None if trivial else 2
        if grade is None:
            continue
        rank = (grade, max(s - line, line - e, 0), -has, -s, no) if grade == 2 else (grade, 0, 0, 0, no)
        if best is None or rank < best[0]:
            best = (rank, no, grade == 0)
    return best and best[1:]


@pytest.mark.parametrize("span", [7, 100_000])
def test_resolve_is_that_of_looking_at_each_chunk(spark, monkeypatch, span):
    monkeypatch.setattr(locate, "SPAN", span)
    rng, chunks, anchors, want = random.Random(span), [], [], {}
    for f in range(60):
        own, at = [], rng.randint(1, 9)
        for no in range(rng.randint(0, 12)):
            end = at + rng.choice([0, 0, 1, 2, 5, 30])
            own.append((no, at, end, rng.random() < 0.5, rng.random() < 0.3))
            at = end + rng.choice([0, 1, 1, 1, 2, 9])
        chunks += [(f"f{f}", no, s, e, "# only\n// this" if trivial else "code", [("n", "function", s)] if has else []) for no, s, e, has, trivial in own]
        for line in {*range(0, 12), *(rng.randint(0, at + 20) for _ in range(25))}:
            anchors.append((len(anchors), f"f{f}", line))
            if found := resolved(line, own):
                want[anchors[-1][0]] = found
    anchors.append((len(anchors), "none", 3))
    chunks = spark.createDataFrame(chunks, f"file_path string, chunk_no int, start_line int, end_line int, content string, symbols {SYMBOLS}")
    asked = spark.createDataFrame(anchors, "aid int, file_path string, line int")
    assert {r.aid: (r.chunk_no, r.exact) for r in locate.resolve(asked, chunks).collect()} == want
    plain = asked.join(locate.resolve(asked.where("aid < 0"), chunks).select("aid"), "aid", "left_semi")
    assert plain.count() == 0 and locate.resolve(asked, chunks.limit(0)).count() == 0
    for aid, path, line in anchors[:: len(anchors) // 6]:
        got = locate.at_line(chunks.where(F.col("file_path") == path), line).collect()
        assert [(r.chunk_no, r.exact) for r in got] == ([want[aid]] if aid in want else [])


def walked(root, wanted):
    """The tree entered folder by folder."""
    found = []

    def enter(folder, patterns):
        for name in files.IGNORE_FILES:
            if os.path.isfile(os.path.join(folder, name)):
                with open(os.path.join(folder, name)) as f:
                    patterns = patterns + [x.strip() for x in f if x.strip() and not x.startswith("#")]
        for name in sorted(os.listdir(folder)):
            whole = os.path.join(folder, name)
            path = os.path.relpath(whole, root)
            if os.path.islink(whole):
                continue
            if os.path.isdir(whole):
                if name not in files.SKIPPED and not files.is_ignored(path, True, patterns):
                    enter(whole, patterns)
            elif name.endswith(wanted) and not files.is_ignored(path, False, patterns):
                found.append((path, os.path.getsize(whole)))

    enter(root, [p for e in wanted for p in (f"!**/*{e}", f"!*{e}")])
    return sorted(found)


@pytest.mark.parametrize("entries", [1, 20_000])
def test_a_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch, entries):
    monkeypatch.setattr(files, "ENTRIES", entries)
    rng = random.Random(4)
    folders = [tmp_path]
    for _ in range(25):
        folder = rng.choice(folders) / rng.choice(["a", "b", "build", "_x", ".hid", "node_modules", "deep"])
        folder.mkdir(exist_ok=True)
        folders.append(folder)
    for folder in set(folders):
        for name in rng.sample(["m.py", "n.rs", "x.go", "keep.go", "t.txt", "n.md", ".e.py"], 4):
            (folder / name).write_text("x" * rng.randint(0, 9))
        if rng.random() < 0.4:
            (folder / ".gitignore").write_text(rng.choice(["build/\n", "*.go\n!keep.go\n", "# no\nm.py\n", "a/*.rs\n"]))
    os.symlink(tmp_path / "a", tmp_path / "link")
    got = files.walk(spark, str(tmp_path), files.extensions())
    assert sorted((r.file_path, r.size) for r in got.collect()) == walked(str(tmp_path), files.extensions())
    (tmp_path / "nothing").mkdir()
    assert files.walk(spark, str(tmp_path / "nothing"), files.extensions()).count() == 0


def test_clones_on_a_cluster_need_a_shared_folder(monkeypatch):
    class Far:
        sparkContext = type("Context", (), {"master": "spark://far:7077"})()

    monkeypatch.setattr(files.SparkSession, "getActiveSession", lambda: Far)
    with pytest.raises(RuntimeError, match="share"), files.cloned("https://x/y.git"):
        pass


def test_subwords_are_the_longest_pieces(spark, tmp_path):
    rng = np.random.default_rng(5)
    pieces = ["parse", "pars", "query", "er", "q", "u", "e", "r", "y", "s", "_", "Auth", "漢"]
    vectors, weights = rng.normal(size=(len(pieces), 6)), rng.uniform(0.5, 2, len(pieces))
    spark.createDataFrame([(p, v.tolist(), float(w)) for p, v, w in zip(pieces, vectors, weights)], "piece string, vector array<double>, weight double").write.parquet(f"{tmp_path}/table")
    encoder = session.load_encoder(spark, f"{tmp_path}/table")
    texts = ["parseQuery parsers", "auth_query!", "zzz", "", None, "漢字 auth", "ParserParser " * 3000]
    got = {r.k: {x.bucket: x.weight for x in r.vector} for r in encoder.encode(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", ["k"]).collect()}
    low = {p.lower(): v * w for p, v, w in zip(pieces, vectors, weights)}

    def cut(word):
        for n in range(len(word), 0, -1):
            if word[:n] in low:
                return [word[:n], *cut(word[n:])]
        return cut(word[1:]) if word else []

    assert cut("parsequery") == ["parse", "query"] and cut("parsers") == ["parse", "r", "s"]
    for i, text in enumerate(texts):
        words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).replace("_", " _ ").split()
        total = sum((low[p] for w in words for p in cut(w)), np.zeros(6))
        norm = np.linalg.norm(total)
        assert np.allclose([got[i].get(b, 0.0) for b in range(6)], total / norm if norm else 0, atol=1e-6)
    chunks = spark.createDataFrame([("a", 0, "queryParse unseenparser"), ("b", 0, "auth")], "file_path string, chunk_no int, content string")
    found = dense.semantic_topk(spark.createDataFrame([(1, "Parser query")], "qid int, query string"), encoder.encode(chunks, "content", ["file_path", "chunk_no"]), 2, encoder).orderBy("rank").collect()
    assert found[0].file_path == "a" and found[0].score > 0.5
    with pytest.raises(ValueError):
        dense.SubwordEncoder(spark, ["a"], np.zeros((2, 3)))


def version(path, at, content):
    return {"file_path": path, "language": "python", "content": content, "at": at}


def test_streams_of_files_are_taken_in_once(spark, tmp_path, monkeypatch):
    home, arrive, marks = str(tmp_path / "home"), tmp_path / "in", str(tmp_path / "marks")
    arrive.mkdir()
    (arrive / "1.json").write_text("\n".join(map(json.dumps, [version("a.py", 1, "def one():\n    pass\n"), version("b.py", 1, "def two():\n    pass\n"), version("a.py", 2, "def newer():\n    pass\n")])))
    run = lambda: streaming.follow(streaming.arriving(spark, str(arrive)), home, "files", marks).awaitTermination()
    run()
    index = SearchIndex.open(spark, home)
    assert index.commit.n == 2 and index.symbol("newer").count() == 1 and index.symbol("one").count() == 0
    run()  # nothing new
    assert Store(spark, home).numbers() == [1]
    (arrive / "2.json").write_text("\n".join(map(json.dumps, [version("b.py", 3, None), version("c.py", 3, "def three():\n    pass\n")])))
    real, died = streaming.apply, []

    def dies(*args, **more):
        real(*args, **more)
        if not died:
            died.append(True)
            raise RuntimeError("killed after the commit, before the stream has noted it")

    monkeypatch.setattr(streaming, "apply", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert Store(spark, home).numbers() == [1, 2]
    run()  # the batch is run again and finds itself done
    index = SearchIndex.open(spark, home)
    assert Store(spark, home).numbers() == [1, 2] and index.commit.batches == {"files": 1}
    assert index.commit.n == 2 and index.symbol("two").count() == 0 and index.symbol("three").count() == 1
