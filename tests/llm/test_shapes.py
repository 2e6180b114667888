"""Templates by shape: what is around articles goes without any help from tags and names."""

from collections import Counter

from quernal.llm import htmlmain

PAGES = "/root/testdata/sf0.1/pages.parquet"


def lines(rows):
    return {r.row.page_id: Counter(r.text.split("\n")) for r in rows.collect()}


def missing(a, b):
    return sum(sum((a[k] - b[k]).values()) for k in a)


def test_templates_alone_find_the_articles_of_the_given_pages(spark, monkeypatch):
    pages = spark.read.parquet(PAGES).select("page_id", "url", "html")
    hosts = pages.groupBy(htmlmain.host_of(pages.url).alias("host")).count().orderBy("count", ascending=False).limit(6)
    pages = pages.join(hosts, htmlmain.host_of(pages.url) == hosts.host, "left_semi")
    right = lines(htmlmain.extract(pages))
    alone = lines(htmlmain.extract(pages, hints=False))
    monkeypatch.setattr(htmlmain, "templates", lambda pages, *a, **b: pages.selectExpr("cast(0 as bigint) as subtree").limit(0))
    nothing = lines(htmlmain.extract(pages, hints=False))
    boilerplate = missing(nothing, right)
    assert boilerplate > 1000 and missing(right, nothing) == 0
    # what is left is on pages with more text around their article than in it
    assert missing(alone, right) < 0.05 * boilerplate and missing(right, alone) == 0


def page(i, words, body="<div class='x1'><p>{0}</p><p>{0} again</p></div>"):
    menu = "".join(f"<li><a href='/{i}{k}'>{w}</a></li>" for k, w in enumerate(words))
    return f"<html><body><div class='top'><ul>{menu}</ul></div><div class='promo'>buy {words[0]} now</div>{body.format(f'story {i} of the day')}<div class='end'>(c) {words[-1]}</div></body></html>"


def test_shapes_whose_words_change(spark):
    rows = [(i, f"http://a.org/{i}", page(i, [f"w{i}{j}" for j in range(3 + i % 3)])) for i in range(8)]
    rows += [(8, "http://a.org/odd", "<html><body><div class='top'><ul><li>only this</li></ul></div></body></html>")]  # nothing else is there
    rows += [(9, "http://b.org/1", page(9, ["x", "y"])), (10, None, page(10, ["x", "y"])), (11, "http://a.org/n", None), (12, "http://a.org/0", rows[0][2])]
    got = {r.row.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id int, url string, html string"), hints=False).collect()}
    for i in range(8):
        assert got[i] == f"story {i} of the day\nstory {i} of the day again"
    assert got[8] == "only this" and got[11] == "" and got[12] == got[0]
    assert "buy x now" in got[9] and "story 10" in got[10]  # one page makes no template


def test_lists_of_an_article_stay(spark):
    body = "<div class='post'><h1>{0}</h1><ul><li>first</li></ul><p>{0}</p></div>"
    rows = [(i, f"http://a.org/{i}", page(i, [f"w{i}"], body).replace("first", f"first of {i}")) for i in range(8)]
    got = {r.row.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, "page_id int, url string, html string"), hints=False).collect()}
    assert got[3].split("\n") == ["story 3 of the day", "first of 3", "story 3 of the day"]


def test_shapes_beyond_a_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"http://a.org/{i}", page(i, [f"w{i}{j}" for j in range(3)])) for i in range(8)], "page_id int, url string, html string")
    want = lines(htmlmain.extract(rows, hints=False))
    monkeypatch.setattr(htmlmain, "BROADCAST_TEMPLATES", 0)
    assert lines(htmlmain.extract(rows, hints=False)) == want
