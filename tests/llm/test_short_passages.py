"""Short items and short documents: every admitted substitution is found; quality of scripts with marks and without spaces."""

from itertools import combinations

import pytest

from quernal.llm import decontam, quality


def patterns(n):
    """Positions that may be substituted in n words."""
    most = n * (100 - decontam.AGREE) // 100 if n >= decontam.FEW else 0
    return [p for k in range(most + 1) for p in combinations(range(n), k)]


@pytest.mark.parametrize("sizes", [(4, 6, 7, 8, 9), (10, 11, 12), (13, 15)])
def test_every_admitted_substitution_of_a_short_item_is_found(spark, sizes):
    items = [(n, " ".join(f"item{n}w{i}" for i in range(n))) for n in sizes]
    docs, want = [], set()
    for n, text in items:
        for k, gone in enumerate(patterns(n)):
            words = [f"other{k}" if i in gone else w for i, w in enumerate(text.split())]
            for kind, around in enumerate((f"begin{k} " * 20, "")):
                docs.append((len(docs), f"{around}{' '.join(words)} {around}".strip()))
                want.add((docs[-1][0], n))
        docs.append((len(docs), " ".join(["no"] * (n // 2) + text.split()[n // 2 :])))  # half of it is no evidence
    found = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert want <= got and {d for d, _ in got - want} == set()


def test_short_documents_out_of_long_items(spark):
    item = [f"w{i}" for i in range(60)]
    docs, want = [], set()
    for n in range(3, 16):
        for k, gone in enumerate(patterns(n)[:: 7 if n > 11 else 1]):
            docs.append((len(docs), " ".join(f"x{k}" if i in gone else w for i, w in enumerate(item[11 : 11 + n]))))
            if n >= decontam.FEW:
                want.add(docs[-1][0])
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "w3 w4 " + "z " * 200_000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as seed", "2 as item_id", "'m' as mark", "3 as w")
    found = decontam.overlaps(rows, spark.createDataFrame([(1, " ".join(item)), (2, "a b c"), (3, None)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == want
    kept = decontam.keep(rows, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert kept.columns == rows.columns and kept.count() == len(docs) - len(want)


HINDI = " ".join(f"{a}ि{b}ीं" for a in "कगचजट" for b in "तनपमरलस")
CHINESE = " ".join(["这是一段干净的中文文字其中每个短语之间有空格", "质量规则不应该把它当作过长的单词", "因为中文书写时单词之间没有空格而短语很长"] + [f"第{c}个短语说明这里没有任何重复的内容并且足够长" for c in "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸"])


def test_clean_texts_of_all_scripts_are_kept(spark):
    docs = spark.createDataFrame([(0, HINDI), (1, CHINESE), (2, "x" * 400 + " word" * 3 + " yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy" * 18), (3, " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, text string")
    got = {r.row.doc_id: r for r in quality.ledger(docs.selectExpr("*", "1 as n_words", "2 as failed_bits")).collect()}
    failed = lambda r, policy: [n for n in quality.POLICIES[policy] if r.failed_bits & quality.BIT[n]]
    assert failed(got[0], "prose-1") == ["few_letters"] and failed(got[1], "prose-1") == ["long_words"]
    assert failed(got[0], "prose-2") == failed(got[1], "prose-2") == [] and "long_spaced_words" in failed(got[2], "prose-2")
    assert got[3].n_words == 200_000


def test_a_stored_ledger_answers_later_policies(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'good words here ' * 0}" + " ".join(f"w{i}x{j}" for j in range(10 + 5 * i))) for i in range(6)], "doc_id long, text string")
    quality.store(quality.ledger(docs), str(tmp_path / "ledger"))
    assert {r.row.doc_id: r.kept for r in quality.stored(spark, str(tmp_path / "ledger")).collect()} == {r.row.doc_id: r.failed_bits & quality.mask_of("prose-2") == 0 for r in quality.ledger(docs).collect()}
    assert quality.ablations(spark.read.parquet(str(tmp_path / "ledger"))).where("policy = 'base-1' and without_rule is null").first().n_docs == 6
    monkeypatch.setitem(quality.RULES, "new_rule", "n_words > 1000")
    monkeypatch.setitem(quality.BIT, "new_rule", 1 << len(quality.BIT))
    monkeypatch.setitem(quality.POLICIES, "later", ("few_words", "new_rule"))
    quality.store(quality.ledger(docs.where("doc_id = 5")), str(tmp_path / "ledger"))
    assert sorted((r.rules, r.kept is None) for r in quality.stored(spark, str(tmp_path / "ledger"), "later").collect()) == [(13, True)] * 6 + [(14, False)]
