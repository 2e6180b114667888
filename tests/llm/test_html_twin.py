"""Template removal against a twin in plain Python that builds whole trees, and odd, long and repeated pages."""

import random
import time
from collections import defaultdict
from html import escape
from html.parser import HTMLParser

import pytest

from quernal.llm import htmlmain
from quernal.llm.htmlmain import main_text, parse

SCHEMA = "page_id long, url string, html string"
NEVER = {"nav", "footer", "aside", "script", "form", "head"}
PROSE = {"p", "h1", "li"}


class Tree(HTMLParser):
    """Nested lists [tag, child, ...] of a page without unclosed tags."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.stack = [["top"]]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.stack[-1].append([tag])
        self.stack.append(self.stack[-1][-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1].append(data)


def elements(node, around=None, inside=None):
    """(node, what is around it, the article it is in) of all elements."""
    for child in node[1:]:
        if isinstance(child, list):
            yield child, node, inside
            yield from elements(child, node, child if child[0] == "article" else inside)


def twin(pages):
    """rows (page_id, host, html) -> texts by page_id."""
    trees = [(i, host, Tree(html).stack[0]) for i, host, html in pages]
    met, place, whole = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for _, host, tree in trees:
        whole[host].add(repr(tree))
        for article in [None, *(n for n, _, _ in elements(tree) if n[0] == "article")]:
            prose = [(n, a) for n, a, inside in elements(tree) if inside is article and article and n[0] in PROSE]
            for at, (n, a) in enumerate(prose):
                for p in (at + 1, at - len(prose)):
                    place[host, True, repr(n)][p].add(repr(a))
        for n, a, inside in elements(tree):
            if n[0] not in ("html", "body", "article"):
                met[host, bool(inside) and n[0] in PROSE, repr(n)].add(repr(a))

    def template(host, n, inside):
        key = (host, bool(inside) and n[0] in PROSE, repr(n))
        if n[0] in ("html", "body", "article") or len(met[key]) < 5:
            return False
        if not key[1]:
            return True
        most = max(map(len, place[key].values()))
        return most >= max(5, 0.8 * len(met[key])) and len(met[key]) >= 0.5 * len(whole[host])

    out = {}
    for i, host, tree in trees:
        blocks = []  # text, in article, lost as prose

        def visit(node, article, lost):
            words = []
            for child in node[1:]:
                if isinstance(child, str):
                    words += child.split()
                    continue
                if words:
                    blocks.append((" ".join(words), article is not None, lost))
                    words = []
                here = template(host, child, article)
                if child[0] in NEVER or (here and not (article and child[0] in PROSE)):
                    continue
                visit(child, child if child[0] == "article" else article, lost or here)
            if words:
                blocks.append((" ".join(words), article is not None, lost))

        visit(tree, None, False)
        left = [b for b in blocks if not b[2]]
        if 2 * (len(blocks) - len(left)) < sum(b[1] for b in blocks):
            blocks = left
        out[i] = "\n".join(b[0] for b in [b for b in blocks if b[1]] or blocks)
    return out


def site(rng, marked):
    common = [f"<div><p>common {i} &amp; more</p></div>" for i in range(3)] + [f"<p>said {i}</p>" for i in range(2)]

    def block(depth):
        kind = rng.random()
        if kind < 0.35:
            return rng.choice(common)
        if kind < 0.6 and depth:
            return f"<div>{''.join(block(depth - 1) for _ in range(rng.randint(1, 3)))}</div>"
        return f"<{(t := rng.choice(['p', 'h1']))}>{escape('own < ' + str(rng.random()))}</{t}>"

    def page():
        body = "".join(block(2) for _ in range(rng.randint(2, 6))) + ("<p>write to us</p>" if rng.random() < 0.9 else "")
        if marked:
            body = f"<article><h1>{rng.random()}</h1>{body}</article>"
        return f"<html><head><title>t</title></head><body><nav><ul><li>menu</li></ul></nav><div>banner of the site</div>{body}<script>if (a<b) x()</script><footer>end</footer></body></html>"

    return page


@pytest.mark.parametrize("marked", [False, True])
def test_against_the_twin(spark, marked):
    rng = random.Random(7 + marked)
    page = site(rng, marked)
    rows = [(i, f"h{i % 3}.example", page()) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]
    want = twin(rows)
    frame = spark.createDataFrame([(i, f"https://{host}/{i}", html) for i, host, html in rows], SCHEMA)
    got = {r.row.page_id: r.text for r in htmlmain.extract(frame).collect()}
    assert got == want
    # the templates decide: without them the texts are others
    assert sum(main_text(parse(html, host), frozenset()) != got[i] for i, host, html in rows) > 100


def test_own_parts_of_an_article():
    page = '<body><article><header><h1 class="entry-header">Title</h1></header><div class="share-price up"><p>rose by 3</p></div><div class="ad">buy</div><section id="comments-2"><p>reader</p></section><div class="comment-list">more</div><footer>by me</footer></article></body>'
    assert main_text(parse(page), frozenset()) == "Title\nrose by 3"
    assert main_text(parse('<body><div class="site-header">top</div><div class="entry-content">text</div><div class="ad-slot-3">buy</div></body>'), frozenset()) == "text"


@pytest.mark.parametrize("odd", ['<a "', "<a '>", "<div>", "<b><p>", "<", "<!--", "<li>", "</p>", "<div><i>", "&amp;"])
def test_time_is_linear(odd):
    began = time.time()
    parse((odd * (1 + 1_000_000 // len(odd)))[:1_000_000] + '"')
    assert time.time() - began < 5


def test_query_and_clashing_names(spark, tmp_path):
    rows = [(1, "http://a.example/x", "<p>a&nbsp;b</p>\n<p>c</p>"), (2, None, None), (None, "odd", ""), (1, "http://a.example/x", "<p>a&nbsp;b</p>\n<p>c</p>")]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as text", "2 as row", "3 as host", "4 as subtree").write.parquet(f"{tmp_path}/pages.parquet")
    got = htmlmain.query(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [(1, rows[0][1], "a b\nc", 5), (2, None, "", 0), (None, "odd", "", 0), (1, rows[0][1], "a b\nc", 5)]))
    done = htmlmain.extract(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert done.where("row.page_id = 2").first().row.host == 3
