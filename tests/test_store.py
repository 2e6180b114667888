"""Segments, commits, posting blocks: what is read and written, and that results don't depend on how an index came to be."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quernal.operators import blocks, lexical
from quernal.plans import index as plans
from quernal.plans import store as stores
from quernal.plans.index import SearchIndex
from quernal.plans.storage import Folder, scratch


@pytest.fixture(scope="module")
def chunks(spark):
    """Texts of common and rare words, copies among them, in three languages."""
    rng = random.Random(6)
    common, rare = [f"the{i}" for i in range(12)], [f"rare{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        words = [w for w in common if rng.random() < 0.6] + ([rng.choice(rare)] if rng.random() < 0.3 else []) + ["pad"] * rng.choice([3, 3, 3, 4])
        rng.shuffle(words)
        rows.append((f"src/f{i % 97}.py", i, " ".join(words), ["python", "rust", None][i % 3]))
    rows += [("src/copy.py", i, rows[7][2], "python") for i in range(40)] + [("src/empty.py", 0, "", "rust")]
    df = spark.createDataFrame(rows, "file_path string, chunk_no int, content string, language string")
    return scratch(df.select("*", F.lit(0).alias("start_byte"), F.octet_length("content").alias("end_byte"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    before, stores.WHOLE = stores.WHOLE, 0  # in buckets, however small
    try:
        return SearchIndex.of_chunks(chunks, home=str(tmp_path_factory.mktemp("home") / "x"))
    finally:
        stores.WHOLE = before


@pytest.fixture(scope="module")
def queries(spark):
    asked = [*[f"rare{i} the1 the2 the3 the4" for i in range(0, 40, 2)], "the1 the2", "rare3 rare3 the5", "nothing here", "", "pad the0", "rare1 rare2 rare3 rare4 the6 the7"]
    return scratch(spark.createDataFrame(list(enumerate(asked)), "qid int, query string"))


def rows_of(found):
    return sorted((r.qid, r["rank"], r.file_path, r.chunk_no, round(r.score, 8)) for r in found.collect())


def wanted(chunks, queries, k, where="true"):
    """By every posting of every text, as the plain operators do it."""
    found = lexical.analysed(chunks)
    scores = lexical.bm25_scores(queries, lexical.postings(found), lexical.corpus_stats(lexical.doc_lengths(found)))
    return rows_of(lexical.top_k(scores.join(chunks.where(where), ["file_path", "chunk_no"], "left_semi").select(*scores.columns), k, "bm25"))


def test_a_term_is_read_from_its_bucket_alone(index):
    bucket = blocks.bucket_of("the7", stores.BUCKETS)
    found = index.store.blocks(index.commit, [bucket], ["the7"])
    plan = found._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [bucket" in plan.toString() and "PushedFilters: [" in plan.toString() and "the7" in plan.toString()
    n = len(plan.executeCollectPublic())
    leaf = plan.collectLeaves().head()
    folder = [f for f in os.listdir(f"{index.store.folder.path}/postings/segment=1/bucket={bucket}") if f.endswith(".parquet")]
    assert n == found.count() > 0 and leaf.metrics().apply("numFiles").value() == len(folder) == 1
    assert len(os.listdir(f"{index.store.folder.path}/postings/segment=1")) > 50


@pytest.mark.parametrize("k", [1, 10])
def test_every_plan_gives_the_same_top_k(spark, chunks, index, queries, k, monkeypatch):
    want = wanted(chunks, queries, k)
    assert rows_of(index.words(queries, k)) == want
    monkeypatch.setattr(plans, "PRUNE_FROM", 0)
    assert rows_of(index.words(queries, k)) == want
    monkeypatch.setattr(plans, "MOST_QUERIES", 3)
    monkeypatch.setattr(plans, "MOST_VALUES", 5)
    assert rows_of(index.words(queries, k)) == want


def test_range_scoring_in_many_steps(index, chunks, queries, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 1)
    assert rows_of(index.words(queries, 10)) == wanted(chunks, queries, 10)


def test_selectors_are_ranges_of_documents(index, chunks, queries):
    assert index.chosen(None, None) is None and index.chosen(["cobol"], None) == [] and index.chosen(["cobol"], None, lenient=True) is None
    assert rows_of(index.words(queries, 10, index.chosen(["rust"], None))) == wanted(chunks, queries, 10, "language = 'rust'")
    paths = ["src/f3.py", "src/copy.py"]
    assert rows_of(index.words(queries, 10, index.chosen(["rust"], paths))) == wanted(chunks, queries, 10, "language = 'rust' or file_path in ('src/f3.py', 'src/copy.py')")
    asked = index._asked("rare2 the1")
    meaning = {(r.file_path, r.chunk_no) for r in index.batch(asked, 2000, "semantic", index.chosen(["rust"], None)).collect()}
    assert meaning == {(r.file_path, r.chunk_no) for r in chunks.where("language = 'rust'").collect()}
    plan = index.batch(asked, 5, "semantic", index.chosen(["rust"], None))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "GreaterThanOrEqual(doc" in plan


def test_pruning_looks_at_few_documents(spark, index, monkeypatch):
    few = spark.createDataFrame([(i, f"rare{i} rare{i + 1} the1 the2 the3 the4 the5") for i in range(20)], "qid int, query string")
    weights = spark.createDataFrame(index._weights([(r.qid, t, 1) for r in few.collect() for t in r.query.split()]), "qid int, term string, df bigint, w double")
    post, seen = index.store.blocks(index.commit, range(stores.BUCKETS), None), []

    def table(rows):
        seen.append(scratch(rows))
        return seen[-1]

    found = blocks.pruned(weights, post, index.commit.avg_len, 1, table)
    want = blocks.exhaustive(weights, post, index.commit.avg_len, 1)
    assert sorted((r.qid, r.doc) for r in found.collect()) == sorted((r.qid, r.doc) for r in want.collect())
    looked_at, whole = seen[-1].count(), blocks._scored(post, weights, index.commit.avg_len, lambda rows: rows).count()
    assert looked_at * 5 < whole


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(12):
        (root / f"m{i}.py").write_text("".join(f"def f{i}_{j}(alpha):\n    return beta{i} + gamma{j}\n\n\n" for j in range(60)))
    return root


def size_of(home):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(home) for f in files if f.endswith(".parquet")}


def results(index):
    words = [tuple(r) for q in ("gamma3 beta2", "alpha", "delta") for r in index.search(q, 5, "bm25").select("rank", "file_path", "chunk_no", "score").collect()]
    stats = index.stats().first()
    return [(a, b, c, round(s, 8)) for a, b, c, s in words], (stats.indexed_files, stats.total_chunks), index.commit.n, index.commit.tokens, sorted(map(tuple, index.symbol("f2_3").collect()))


def test_a_small_change_writes_little_and_equals_a_full_build(spark, tree, tmp_path):
    home = str(tmp_path / "home")
    first = SearchIndex.refresh(spark, str(tree), home)
    before, old = size_of(home), results(first)
    (tree / "m2.py").write_text("def delta(alpha):\n    return gamma3\n")
    second = SearchIndex.refresh(spark, str(tree), home)
    after = size_of(home)
    assert all(after[f] == size for f, size in before.items())  # nothing is written again
    text = sum(len(r.content) for r in second.tables["chunks"].where("file_path = 'm2.py'").collect())
    rows = {t: second.store.table(t, second.commit.ids[-1:]).count() for t in ("chunks", "embedded", "manifest")}
    assert rows == {"chunks": 1, "embedded": 1, "manifest": 1} and text < 60 and second.commit.dead == first.tables["chunks"].where("file_path = 'm2.py'").count()
    assert sum(after.values()) - sum(before.values()) < 0.5 * sum(before.values())  # what few rows take in Parquet
    (tree / "m5.py").unlink()
    third = SearchIndex.refresh(spark, str(tree), home)
    fresh = SearchIndex.of_tree(spark, str(tree))
    assert results(third) == results(fresh) and results(first) == old  # a reader keeps to its commit
    assert third.search("alpha", 3, "hybrid").select("file_path", "chunk_no").collect() == fresh.search("alpha", 3, "hybrid").select("file_path", "chunk_no").collect()
    merged = SearchIndex.compact(spark, home)
    assert len(merged.commit.segments) == 1 and merged.commit.dead == 0 and results(merged) == results(fresh)
    assert SearchIndex.refresh(spark, str(tree), home).commit == merged.commit  # and nothing has changed
    assert SearchIndex.open(spark, home, version=1).commit == first.commit
    assert SearchIndex.collect_garbage(spark, home, 3600) == 0
    assert SearchIndex.collect_garbage(spark, home, -1) == 3 and len(os.listdir(f"{home}/chunks")) == 1
    assert results(SearchIndex.open(spark, home)) == results(fresh) and SearchIndex.open(spark, home, version=1) is None


def test_two_writers(spark, tree, tmp_path, monkeypatch):
    home, real = str(tmp_path / "home"), stores.Store.append
    SearchIndex.refresh(spark, str(tree), home)
    raced = []

    def overtaken(change):
        """While the first writer is about to commit, another one changes the tree and is faster."""

        def append(self, *args, **more):
            if not raced:
                raced.append(True)
                change()
                SearchIndex.refresh(spark, str(tree), home)
            return real(self, *args, **more)

        raced.clear()
        monkeypatch.setattr(stores.Store, "append", append)

    (tree / "m1.py").write_text("def from_first():\n    pass\n")
    overtaken(lambda: ((tree / "m2.py").write_text("def from_second():\n    pass\n"), os.utime(tree / "m1.py", ns=(5, 5))))
    index = SearchIndex.refresh(spark, str(tree), home)  # the other saw m1 too: the same file, so this one begins anew
    assert {r.file_path for n in ("from_first", "from_second") for r in index.symbol(n).collect()} == {"m1.py", "m2.py"}
    assert index.commit.number == 3 or index.commit.number == 2

    hidden = tmp_path / "other"
    hidden.mkdir()
    (tree / "m3.py").write_text("def third():\n    pass\n")

    def other():
        os.rename(tree / "m3.py", hidden / "m3.py")  # what the other sees: m3 is gone
        (tree / "new.py").write_text("def fourth():\n    pass\n")

    overtaken(other)
    index = SearchIndex.refresh(spark, str(tree), home)  # m3 was changed by both: anew again
    assert index.symbol("third").count() == 0 and index.symbol("fourth").count() == 1


def test_writers_of_other_files_lose_nothing(spark, tree, tmp_path):
    home = str(tmp_path / "home")
    base = SearchIndex.refresh(spark, str(tree), home).commit
    store = stores.Store(spark, home)
    encoder = SearchIndex._derive(plans.dense.HashEncoder())
    deltas = []
    for name in ("one", "two"):
        chunk = spark.createDataFrame([(f"{name}.py", 0, f"def {name}_added(): alpha", "python", 0, 9, 1, 1)], "file_path string, chunk_no int, content string, language string, start_byte int, end_byte int, start_line int, end_line int")
        chunk = chunk.withColumn("symbols", F.expr(f"array(named_struct('name', '{name}_added', 'kind', 'function', 'line', 1))"))
        files = spark.createDataFrame([(f"{name}.py", 1, 1, "h", False)], "path string, size bigint, mtime_nanos bigint, hash string, gone boolean")
        deltas.append((store.write(chunk, encoder, files), files))
    for delta, files in deltas:  # both from the same base
        last = store.append(base, delta, base.root, lambda files=files: files.select("path"))
    assert last.number == base.number + 2 and last.n == base.n + 2
    index = SearchIndex(spark, store, last)
    assert index.symbol("one_added").count() == index.symbol("two_added").count() == 1 and index.search("alpha", 1000, "bm25").count() == last.n
    with pytest.raises(stores.Conflict, match="same files"):
        store.append(base, deltas[0][0]._replace(segment=(99, 0, False, ())), base.root, lambda: deltas[0][1].select("path"))
    with pytest.raises(stores.Conflict, match="merged"):
        store.append(base, deltas[0][0]._replace(replaced=tuple(base.ids)), base.root)
    with pytest.raises(stores.Conflict, match="first commit"):
        store.append(None, deltas[0][0], None)


def test_files_are_created_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "a"))
    assert folder.create("b/c", "one") and not folder.create("b/c", "two") and folder.read("b/c") == "one"
    assert os.listdir(tmp_path / "a" / "b") in (["c"], ["c", ".c.crc"], [".c.crc", "c"])


def test_paths_as_they_are_written(spark, tree, tmp_path):
    index = SearchIndex.refresh(spark, str(tree), str(tmp_path / "home"))
    for path in ("m2.py", "./m2.py", str(tree / "m2.py"), f"{tree}/../tree/m2.py"):
        assert index.find_related(path, 1, 2).count() == 2 and index.symbols_at(path, 1).count() > 0
    assert index.find_related("none.py", 1, 2).count() == 0


def test_an_index_for_words_alone(spark, chunks, queries):
    index = SearchIndex.of_chunks(chunks, only_words=True)
    assert not Folder(spark, f"{index.store.home}/names").exists() and not Folder(spark, f"{index.store.home}/embedded").exists()
    gone = chunks.where("file_path = 'src/f3.py'").select("file_path").distinct()
    came = chunks.where("file_path = 'src/f5.py'").withColumn("content", F.concat("content", F.lit(" rare1 the7")))
    index = SearchIndex.open(spark, index.store.home).upsert(came, gone)
    now = chunks.where("file_path not in ('src/f3.py', 'src/f5.py')").unionByName(came)
    assert index.commit.lacks == ("embedded", "names") and index.commit.dead > 20
    assert rows_of(index.words(queries, 10)) == wanted(now, queries, 10)
    with pytest.raises(ValueError, match="words alone"):
        index.search("the1", mode="hybrid")


def test_many_terms_pass_on_only_their_blocks(index, monkeypatch):
    monkeypatch.setattr(stores, "MOST_TERMS", 1)
    found = index.store.blocks(index.commit, range(stores.BUCKETS), ["the7", "the8"])
    assert {r.term for r in found.select("term").distinct().collect()} == {"the7", "the8"}


def test_dying_documents_are_counted_in_blocks(spark, index, chunks, monkeypatch):
    made, real = [], blocks.built
    monkeypatch.setattr(blocks, "built", lambda rows: made.append(real(rows)) or made[-1])
    index.store.write(chunks.limit(1).withColumn("symbols", F.array().cast(stores.SYMBOLS)), {}, spark.createDataFrame([], "path string, size bigint, mtime_nanos bigint, hash string, gone boolean"), index.store.live("chunks", index.commit).orderBy(F.rand(1)))
    assert made[1].where("term = 'pad'").count() <= 8  # in random order, one for each of 1,500 documents
