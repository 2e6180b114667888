"""Each operator against plain Python, on rows with nulls, copies, ties, odd texts and clashing column names."""

import random
import time
from itertools import combinations

import duckdb
import pytest
from helpers import lower, words
from pyspark.sql import functions as F

import corpus_pipeline
from quernal.llm import decontam, htmlmain, kernel, langid, licences, linedup, mixing, neardup, quality, registry, secrets, toxicity

SMALL = "/root/testdata/sf0.001"


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, percent):
    sets = {}
    for row in rows:
        if row[0] is not None:
            sets.setdefault(row[0], set()).update(shingles(row[1], k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def removed_lines(rows, percent=80):
    """Line numbers to remove, by doc_id: those that an earlier line matches."""
    seen, out = [], {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        for n, line in enumerate(text.split("\n")):
            own = set(words(lower(line)))
            if own:
                if any(100 * len(own & s) >= percent * len(own | s) for s in seen):
                    out.setdefault(doc_id, []).append(n)
                seen.append(own)
    return out


def as_rows(frame):
    return sorted((repr(tuple(r)) for r in frame.collect()))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_near_duplicates(docs, corpus, k, percent):
    want = groups(corpus, k, percent)
    got = neardup.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(corpus)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.component_id, row.kept) == (want[row.doc_id], want[row.doc_id] == row.doc_id)


def test_large_near_copy_group(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        copy = base[:]
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(60)] = rng.choice(base)
        rows.append((i, " ".join(copy)))
    want = groups(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_line_dedup(docs, corpus):
    want = removed_lines(corpus)
    for row in linedup.dedup_lines(docs).collect():
        gone = want.get(row.row.doc_id, []) if row.row.text is not None else []
        expected = None if row.row.text is None else "\n".join(x for n, x in enumerate(row.row.text.split("\n")) if n not in gone)
        if row.row.doc_id is None:
            assert row.text == row.row.text and row.removed == []
        else:
            assert row.text == expected and (row.row.text is None or row.removed == gone)
    assert linedup.strip(docs).columns == docs.columns


def test_lines_go_from_a_long_text_in_linear_time(spark, monkeypatch):
    n = 100_000
    docs = spark.range(1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("first\n"), F.array_join(F.sequence(F.lit(0), F.lit(n)), "\n")).alias("text"))
    monkeypatch.setattr(linedup, "removed_lines", lambda rows, percent: spark.range(1, n + 1).select(F.lit(2).alias("doc_id"), F.col("id").alias("line")))
    began = time.time()
    whole, cut = (r.text for r in linedup.dedup_lines(docs).orderBy("row.doc_id").collect())
    assert time.time() - began < 30 and whole.count("\n") == n + 1 and cut == f"first\n{n}"


def test_stages_keep_columns_and_take_empty_tables(spark, docs, nothing, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        out = stage(spark, nothing, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, nothing, str(tmp_path)).count() == 0 and "mix_words" in last(spark, docs, str(tmp_path)).columns


def test_empty_tables(nothing):
    empty = nothing.select("doc_id", "text", "lang", "source")
    assert neardup.near_duplicates(empty).count() == 0 and quality.ledger(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert secrets.secrets(empty).count() == 0 and licences.licences(empty).count() == 0 and decontam.overlaps(empty, empty.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0 and toxicity.score(empty, None).count() == 0
    pages = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url"))
    assert htmlmain.extract(pages).count() == 0


def test_quality_measures(docs, corpus):
    def repeats(w):
        grams = {}
        for i in range(len(w) - 7):
            grams.setdefault(tuple(w[i : i + 8]), []).append(i)
        return len({p + j for at in grams.values() if len(at) > 1 for p in at for j in range(8)})

    got = quality.ledger(docs).collect()
    for row in got:
        text = row.row.text or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(w), sum(map(len, w)), repeats(w))
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_lines == len(lines)
        assert bool(row.failed_bits & quality.mask_of("base-1")) == (len(w) < 20 or 100 * repeats(w) > 30 * len(w))
    table = {(r.policy, r.without_rule): r for r in quality.ablations(quality.ledger(docs)).collect()}
    kept = sum(r.failed_bits & quality.mask_of("prose-1") == 0 for r in got)
    assert table["prose-1", None].n_kept == kept and table["prose-1", None].n_docs == len(got)
    without = quality.mask_of("prose-1") - quality.BIT["few_words"]
    assert table["prose-1", "few_words"].n_kept == sum(r.failed_bits & without == 0 for r in got)


def test_mixing(docs, corpus):
    got = mixing.mix(docs).collect()
    assert as_rows(mixing.mix(docs)) == as_rows(mixing.mix(docs.repartition(7)))
    sizes, taken, goal = {}, {}, {}
    for row in got:
        source = row.row.source
        assert row.size == len(words(row.row.text)) and 0 <= row.taken <= 3 * row.size
        sizes[source], taken[source] = sizes.get(source, 0) + row.size, taken.get(source, 0) + row.taken
        goal[source] = row.target
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-3
    for source in sizes:
        assert abs(taken[source] - goal[source]) <= 3 and goal[source] <= 3 * sizes[source] + 1e-6
    assert sum(r.mix_words for r in mixing.mixed_documents(docs).collect()) == sum(taken.values())


def test_mixing_targets_are_capped(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got == {"a": 30.0, "b": 960.0, "c": 0.0, None: 30.0}


def test_secrets_and_ledger(spark):
    text = "é password = hunter22! AKIA" + "B" * 18 + " token=abc secret=token: abcdefgh \x01\x02 " + "0f" * 13
    rows = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "nothing"), (None, text)], "doc_id long, text string")
    got = secrets.secrets(rows).collect()
    spans = {s.split(":")[0]: tuple(map(int, s.split(":")[1:])) for s in got[0].spans.split(",")}
    assert text[slice(*spans["access"])] == "AKIA" + "B" * 18 and text[slice(*spans["hex"])] == "0f" * 13
    assert [(r.n_assign, r.n_access, r.n_hex) for r in sorted(got, key=lambda r: (r.row.doc_id or 9))] == [(1, 1, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 1, 1)]
    found, ledger = secrets.findings(rows)
    assert ledger.count() == 3
    more = rows.unionByName(spark.createDataFrame([(6, "api_key: 'qwertyuiop'")], "doc_id long, text string"))
    fresh, added = secrets.findings(more, ledger)
    assert added.count() == 1 and {r.kind for r in fresh.collect()} == {"assign"}
    assert as_rows(secrets.secrets(more).select("row.doc_id", "spans")) == as_rows(secrets.secrets(more, ledger, found).select("row.doc_id", "spans"))


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (8, 16, 40, 60, 3)]
    other = [[word() for _ in range(80)] for _ in range(6)]
    changed = items[2][:]
    for i in (3, 9, 14, 21, 30, 37):
        changed[i] = word()
    texts = [" ".join(o) for o in other]
    texts[1] = texts[1] + "\n" + " ".join(items[1]).upper() + "."
    texts[2] = " ".join(other[2][:20] + changed + other[2][20:])
    texts[3] = " ".join(other[3] + items[0])
    texts[4] = " ".join(other[4][:5] + items[3][20:45])
    texts[5] = " ".join(other[5] + items[4] + items[3][:6])
    docs = spark.createDataFrame([*enumerate(texts), (8, None), (8, ""), (None, texts[1])], "doc_id long, text string")
    benchmark = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, benchmark).collect()}
    assert got == {(1, 1), (2, 2), (3, 0), (4, 3), (None, 1)}
    assert sorted(r.doc_id for r in decontam.keep(docs, benchmark).collect()) == [0, 5, 8, 8]


def test_licences(spark):
    mit = dict(licences.LICENCES)["MIT"]
    odd = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " , ").replace("SUBLICENSE", "sub-licence")
    rows = spark.createDataFrame([(1, odd), (2, "text\nreleased UNDER the mit licence"), (3, None), (4, mit + " more"), (None, mit)], "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notices) for r in licences.licences(rows).collect()}
    assert got[2] == (None, ["MIT"]) and got[3] == (None, []) and got[4] == (None, []) and got[None][0] == "MIT"
    assert got[1][0] == "MIT"


def test_html():
    article = "<html><head><title>t</title></head><body><header>top</header><nav><ul><li>menu</ul></nav><div class='ad box'>buy</div><article><h1>A &amp; B</h1><p>one\n two&nbsp;three <b>four</b>five<br>six<p>seven<script>if (a<b) x('</p>')</script><div class=comments><p>reader</div><!-- c --></article><footer>&copy;</footer>"
    assert htmlmain.main_text(htmlmain.parse(article), frozenset()) == "A & B\none two three fourfive\nsix\nseven"
    assert htmlmain.main_text(htmlmain.parse("plain &lt;b&gt; text"), frozenset()) == "plain <b> text"
    assert htmlmain.main_text(htmlmain.parse(None), frozenset()) == "" and htmlmain.main_text(htmlmain.parse("<p <a b"), frozenset()) == "<p <a b"


def test_site_templates(spark):
    page = lambda i: f"<body><div><p>welcome to the site</p></div><div><p>own text {i}</p></div><p>end {i}</p></body>"
    rows = [(i, f"https://site.example/{i}", page(i)) for i in range(8)] + [(20, "https://other.example/", page(20)), (21, None, None), (22, "odd", "")]
    got = {r.row.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "own text 3\nend 3" and got[20] == "welcome to the site\nown text 20\nend 20" and got[21] == "" and got[22] == ""


def test_language(spark):
    got = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    rows = got.where("held_out").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, "123 --"), (3, "")], "doc_id long, text string")
    model = langid.train([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 8)
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, model).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    rows = [(clean(), 0) for _ in range(200)] + [(clean() + " idiot, " + clean(), 1) for _ in range(60)]
    model = toxicity.train(rows)
    assert len(model.index) < 400
    odd = spark.createDataFrame([(1, "You IDIOT"), (2, clean()), (3, None), (4, "")], "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert got[1] >= 0.3 > got[2] and got[3] == got[4] < 0.3


def test_kernel_words():
    import pyarrow as pa

    texts = ["A b\tA", None, "", "é漢 é漢", " x\n\ny "]
    for most in (1, 1 << 20):
        counts, same = [], []
        for _, _, data, offsets in kernel.blocks(pa.array(texts), most):
            w = kernel.words(data, offsets)
            counts += (w.first[1:] - w.first[:-1]).tolist()
            same += w.hashes.tolist()
        assert counts == [len(words(t)) for t in texts] and same[0] == same[2] != same[1] and same[3] == same[4]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_pipeline(spark):
    """The whole run against the same steps in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in quality.keep(docs).collect()}
    gone = removed_lines(rows.items())
    rows = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in rows.items()}
    group = groups(rows.items(), 5, 80)
    rows = {i: t for i, t in rows.items() if group[i] == i}
    left = decontam.keep(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    rows = {r.doc_id: r.text for r in left.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    want = mixing.mix(spark.createDataFrame([(i, t, source[i]) for i, t in rows.items()], "doc_id long, text string, source string"))
    want = {(r.row.doc_id, r.row.text): r.taken for r in want.collect() if r.taken}
    got = {}
    for row in corpus_pipeline.run(spark, SMALL).collect():
        got[row.doc_id, row.text] = got.get((row.doc_id, row.text), 0) + row.mix_words
    assert got == want
