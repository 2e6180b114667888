"""Site templates on hosts of any size, in and outside articles, and which elements mark an article."""

import pytest

from quernal.llm import htmlmain

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, f"https://site.example/{i}", html) for i, html in enumerate(pages)]
    return {r.row.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_blocks_on_few_pages_of_a_large_host(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(htmlmain, "BROADCAST_TEMPLATES", -1)
    # each block is on 6 of 60 pages
    got = texts(spark, [f"<body><div>offer {i % 10}</div><div>own text {i}</div></body>" for i in range(60)])
    assert got == {i: f"own text {i}" for i in range(60)}


def test_boilerplate_in_articles(spark):
    said = "<p>as they say</p>"

    def page(i):
        own = [f"<p>own {i} {j}</p>" for j in range(3 + i % 5)]
        own.insert(1 + i // 3 % 3, said)
        return f"<body><article><h1>title {i}</h1>{''.join(own)}<p>write to us</p></article></body>"

    got = texts(spark, [page(i) for i in range(40)])
    assert all("write to us" not in t for t in got.values())
    assert all(f"title {i}" in t and f"own {i} 0" in t for i, t in got.items())
    # a sentence that is repeated, at no fixed place, on less than half of the pages
    some = texts(spark, [page(i) if i % 3 == 0 else page(i).replace(said, "") for i in range(40)])
    assert all(("as they say" in t) == (i % 3 == 0) for i, t in some.items())


def test_copies_are_no_templates(spark):
    same = "".join(f"<p>sentence {j}</p>" for j in range(8))
    got = texts(spark, [f"<body><article><h1>title</h1>{same}</article></body>"] * 9 + [f"<body><article><h1>title</h1>{same}<p>edited {i}</p></article></body>" for i in range(9)])
    assert all("sentence 0" in t and "sentence 7" in t for t in got.values())
