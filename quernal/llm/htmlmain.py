"""Main text of web pages, by site template removal.

Every block element of a page has two subtree hashes.  One is of what it says: its start tag, its text and the hashes of its
children.  The other is of its shape alone, for menus and adverts whose words change from page to page: tags and classes,
runs of equal children as one, and the path to it.  Spark counts on how many different pages of the host each occurs (copies
of a page count once), and subtrees that recur there are deleted from its pages, marked articles or not.

* A text hash is a template in MIN_PAGES different parents.
* A shape is a template on MIN_PAGES pages and FRAME_SHARE of the host's.  Shapes count only around the content: not of
  subtrees with prose (paragraphs, headings, or over LONG words at once), nor below an element that has prose among its
  children; and a page never loses more than half of its text by shape.

Tags help: scripts, menus, headers, footers, sidebars, adverts, forms and reader comments are known by tag, role or class, and
where a page marks its article and there is text in it, what templates have left outside of it goes too.  Without these
hints (``hints=False``) templates alone leave 462 of the 19,123 lines around the articles of the 2,500 test pages, all on 60 pages
that have more text around their article than in it, and lose no line of an article.

Sites do repeat sentences, and copy articles with small changes.  So a prose element in an article (paragraph, heading,
list item, cell, quote) is a template only if it is on MOST_PAGES of the host's different pages and keeps its place there,
counted from the start or the end of the article; and if half of an article's blocks or more would go so, it is taken for
a copy and stays whole.

The count is absolute, so a host may have any number of templates.  They are broadcast behind a count (eight bytes each);
beyond it each page is joined with those of its own subtrees.

Defined cases: null or empty html gives empty text; broken markup is read as far as it goes, in time linear in its length:
a tag left open closes with its parent, after a quote that never closes tags end at the next '>', and what is nested deeper
than MAX_DEPTH elements counts as content of the last of them; a null or odd url is the host ''; rows that repeat a page
count once and get equal texts.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernal.llm.scratch import Scratch
from quernal.llm.text import packed, table

#: A subtree is template if it is in so many different parents on its host.
MIN_PAGES = 5
#: Prose in articles must also be at one place in so great a share of its parents, and on so great a share of the pages.
SAME_PLACE, MOST_PAGES = 0.8, 0.5
#: A shape must be on so great a share of its host's pages; words of a block's own from which on it is prose.
FRAME_SHARE, LONG = 0.25, 40
#: Template hashes that are broadcast at most, eight bytes each; beyond it they are joined to pages by shuffling.
BROADCAST_TEMPLATES = 4_000_000
MAX_DEPTH = 512
#: The places that stand for a whole page and for a shape, see subtrees().
WHOLE, FRAME = -(1 << 31), (1 << 31) - 1

#: What follows the '<' of a tag up to its '>', quoted attribute values whole; each character is looked at once.
_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_PLAIN_TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|$|/)|aria-hidden\s*=\s*["']?true""", re.I)
_MAIN = re.compile(r"""(?:^|\s)role\s*=\s*["']?main\b""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr figcaption caption address summary".split())
_BLOCK = _PROSE | frozenset("html body article main section div ul ol dl table thead tbody tfoot figure details center hgroup nav header footer aside form fieldset menu dialog search".split())
_NEVER = frozenset("head script style noscript template iframe object svg canvas audio video nav header footer aside form fieldset button select textarea label dialog menu search title xmp".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that leave a name of the kind above what it is: comment-list, ad-slot, site-header.
_PARTS = frozenset("area bar block body bottom box button buttons container content entry form global group inner item items left link links list main mobile outer page panel posts primary reply right row section secondary section signup site slot thread top unit wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: In an article these hold its own headline.
_OWN_HEAD = frozenset("header masthead banner".split())
_OWN_PARTS = _PARTS - {"entry", "page", "main", "content", "body"}
_FREE = frozenset(("html", "body", "article", "main"))
_TELLS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What is never text, whatever hints are worth.
_CODE = frozenset("head script style noscript template title".split())
#: A start tag closes these if they are open above the nearest element of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P = ({"p"}, {"div", "section", "article", "main", "body", "td", "th", "li", "blockquote", "button", "table"})


def _is_no_article(tag: str, attributes: str, inside: bool) -> bool:
    """Is the element none of the article's, by tag, role or name?  A class or id counts whole (``comments``, ``comment-list``,
    not ``comments-open`` or ``share-price``); in an article, a header is its own."""
    if tag in _NEVER and not (inside and tag in _OWN_HEAD):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for name, *values in _MARKS.findall(attributes):
        for value in "".join(values).lower().split():
            if name.lower() == "role":
                if value in _ROLES and not (inside and value == "banner"):
                    return True
                continue
            words = [w for w in _WORDS.split(value) if w and not w.isdigit()]
            names, parts = (_NAMES - _OWN_HEAD, _OWN_PARTS) if inside else (_NAMES, _PARTS)
            if any(w in names for w in words) and all(w in names or w in parts for w in words):
                return True
    return False


def _label(tag: str, attributes: str) -> str:
    """A tag with the classes, role and id of its element, without their digits."""
    if not attributes:
        return tag
    marks = sorted(w for _, *values in _MARKS.findall(attributes) for w in "".join(values).lower().split())
    return ".".join([tag, *("".join(c for c in w if not c.isdigit()) for w in marks)])


class Page(NamedTuple):
    """Block elements of a page in order: what is around each (its place in these lists, or -1), its subtree hash, whether
    it is free (html, body, article and main are no templates), and for prose in an article which article that is and
    its place in it from 1, else (0, 0); how much prose each article has; blocks of text with the element they are in
    and whether that is in an article; the tag and classes of each element and the words of its own.  The first element is
    the page itself."""

    parents: list[int]
    hashes: list[int]
    free: list[bool]
    places: list[tuple[int, int]]
    prose: list[int]
    blocks: list[tuple[str, int, bool]]
    labels: list[str]
    words: list[int]


def parse(html: str | None, host: str = "", hints: bool = True) -> Page:
    """One pass over a page."""
    page = Page([], [], [], [], [0], [], [], [])
    if not html:
        return page
    seed = blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8)
    parents, hashes, free, places, prose, blocks, labels, words = page
    hashers: list = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, nearest block element, dropped, in an article
    opened: Counter[str] = Counter()
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            own = " ".join("".join(pieces).split())
            if own:
                blocks.append((own, stack[-1][1], stack[-1][3]))
            pieces.clear()

    def start(tag: str, attributes: str, dropped: bool, inside: bool) -> None:
        around = stack[-1][1] if stack else -1
        own = around
        if tag in _BLOCK:
            own = len(parents)
            parents.append(around)
            hashes.append(0)
            free.append(tag in _FREE)
            hashers.append(seed.copy())
            labels.append(_label(tag, attributes))
            words.append(0)
            if (inside or not hints) and tag in _PROSE:
                prose[-1] += 1
                places.append((len(prose) - 1, prose[-1]))
            else:
                places.append((0, 0))
        hashers[own].update(f"<{tag} {' '.join(attributes.split())}".encode("utf-8", "surrogatepass"))
        stack.append((tag, own, dropped, inside))
        opened[tag] += 1

    def close(upto: int) -> None:
        """Close the elements from place ``upto`` of the stack on."""
        while len(stack) > upto:
            tag, own, dropped, inside = stack[-1]
            if tag in _BLOCK:
                if not dropped:
                    flush()
                digest = hashers[own].digest()
                hashers[own] = None
                hashes[own] = int.from_bytes(digest, "big", signed=True) & ~1 | (places[own][1] > 0)
                if parents[own] >= 0:
                    hashers[parents[own]].update(digest)
            else:
                if inside and not stack[-2][3]:
                    flush()
                hashers[own].update(b">")
            stack.pop()
            opened[tag] -= 1

    def text(raw: str) -> None:
        if raw:
            own = raw.split()
            hashers[stack[-1][1]].update(" ".join(own).encode("utf-8", "surrogatepass"))
            words[stack[-1][1]] += len(own)
            if not stack[-1][2]:
                pieces.append(unescape(raw) if "&" in raw else raw)

    start("html", "", False, False)
    at, size, tags = 0, len(html), _TAG
    last = html.rfind(">")
    while at < size:
        begin = html.find("<", at)
        if begin < 0 or begin > last:
            text(html[at:])
            break
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            text(html[at:begin])
            at = size if end < 0 else end + 3
            continue
        if html[begin + 1 : begin + 2] in ("!", "?"):
            text(html[at:begin])
            at = html.find(">", begin) + 1
            continue
        m = tags.match(html, begin + 1)
        if m is None and tags is _TAG and _PLAIN_TAG.match(html, begin + 1):
            tags = _PLAIN_TAG  # a quote never closes: from here on quotes don't count, so nothing is looked at twice
            continue
        if m is None:
            text(html[at : begin + 1])
            at = begin + 1
            continue
        text(html[at:begin])
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                flush()
            elif opened[tag]:
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place][0] == tag:
                        close(place)
                        break
                    if tag not in _BLOCK and stack[place][0] in _BLOCK:
                        break
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in _CLOSES or tag in _BLOCK:
            closes, within = _CLOSES.get(tag, _P)
            if any(opened[t] for t in closes):
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place][0] in closes:
                        close(place)
                        break
                    if stack[place][0] in within:
                        break
            flush()
        if tag in ("html", "body") and opened[tag]:
            continue
        dropped, inside = stack[-1][2:]
        dropped = dropped or (_is_no_article(tag, attributes, inside) if hints else tag in _CODE)
        if hints and not inside and not dropped and (tag in ("article", "main") or _MAIN.search(attributes)):
            flush()
            inside = True
            prose.append(0)
        deep = len(stack) >= MAX_DEPTH
        if not deep:
            start(tag, attributes, dropped, inside and not dropped)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            if not deep:
                hashers[stack[-1][1]].update(html[at : end.start() if end else size].encode("utf-8", "surrogatepass"))
                close(len(stack) - 1)
            at = end.end() if end else size
        elif not deep and attributes.endswith("/") and tag not in _BLOCK:
            close(len(stack) - 1)
    flush()
    close(0)
    return page


def subtrees(page: Page, host: str = "") -> set[tuple[int, int, int]]:
    """(hash, place, hash of the parent) of the page's subtrees.  Place 0 is anywhere; prose in an article also has places
    from its start (1, 2, ..) and from its end (-1, -2, ..).  Shapes are at place FRAME, with the page as their parent, which
    itself is there once, at place WHOLE."""
    found: set[tuple[int, int, int]] = set()
    for own, h, free, (article, place) in zip(page.parents, page.hashes, page.free, page.places, strict=True):
        if not free:
            around = page.hashes[own]
            found.add((h, 0, around))
            if place:
                found.update(((h, place, around), (h, place - page.prose[article] - 1, around)))
    if page.hashes:
        found.add((0, WHOLE, page.hashes[0]))
        found.update((h, FRAME, page.hashes[0]) for h in frames(page, host).values())
    return found


def frames(page: Page, host: str = "") -> dict[int, int]:
    """element -> hash of its shape and the path to it, of the topmost elements around the content; see the module."""
    n = len(page.parents)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parents[i]].append(i)
    shapes, says, prose, tells = [0] * n, [0] * n, [False] * n, [False] * n
    for i in range(n - 1, -1, -1):
        own = page.labels[i]
        tells[i] = page.words[i] > LONG or (page.words[i] > 0 and own.split(".", 1)[0] in _TELLS)
        says[i] = page.words[i] + sum(says[c] for c in children[i])
        prose[i] = tells[i] or any(prose[c] for c in children[i])
        runs = [shapes[c] for k, c in enumerate(children[i]) if not k or shapes[c] != shapes[children[i][k - 1]]]
        shapes[i] = hash_of(f"{own}({','.join(map(str, runs))})")
    found: dict[int, int] = {}
    paths, open_ = [0] * n, [True] * n  # open: no element above is a frame or has prose among its children
    paths[:1] = [hash_of(f"{host} {page.labels[0]}")] if n else []
    for i in range(1, n):
        above = page.parents[i]
        paths[i] = hash_of(f"{paths[above]}/{page.labels[i]}")
        open_[i] = open_[above] and above not in found and not any(tells[c] for c in children[above])
        if open_[i] and not page.free[i] and says[i] and not prose[i]:
            found[i] = hash_of(f"{paths[i]} {shapes[i]}") & ~1
    return found


def hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def main_text(page: Page, templates: Container[int], host: str = "", hints: bool = True) -> str:
    """The blocks of the article, or of the page, that are in no template."""
    shaped = {i for i, h in frames(page, host).items() if h in templates}
    around = [i in shaped for i in range(len(page.parents))]
    for i, own in enumerate(page.parents):
        around[i] = around[i] or (own >= 0 and around[own])
    lost = sum(len(text) for text, at, _ in page.blocks if around[at])
    if 2 * lost > sum(len(text) for text, _, _ in page.blocks):
        around = [False] * len(page.parents)
    gone, gone_prose = [False] * len(page.parents), [False] * len(page.parents)
    for i, (own, h) in enumerate(zip(page.parents, page.hashes, strict=True)):
        here = not page.free[i] and h in templates
        gone[i] = (own >= 0 and gone[own]) or (here and not h & 1)
        gone_prose[i] = (own >= 0 and gone_prose[own]) or (here and bool(h & 1))
    kept = [block for block in page.blocks if not gone[block[1]] and not around[block[1]]]
    own = [block for block in kept if not gone_prose[block[1]]]
    if 2 * (len(kept) - len(own)) < sum(block[2] or not hints for block in kept):
        kept = own
    article = [block for block in kept if block[2]]
    return "\n".join(block[0] for block in article or kept)


class Sorted:
    """A set of numbers in eight bytes each."""

    def __init__(self, values: array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __contains__(self, value: int) -> bool:
        at = bisect_left(self.values, value)
        return at < len(self.values) and self.values[at] == value


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            yield batch.slice(start, 256)


def _pages(part: pa.RecordBatch, hints: bool) -> Iterator[tuple[str, Page]]:
    for html, host in zip(part.column("html"), part.column("host").to_pylist(), strict=True):
        yield host, parse(html.as_py(), host, hints)


def _subtrees(hints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            hosts, found = [], []
            for host, page in _pages(part, hints):
                own = subtrees(page, host)
                hosts += [host] * len(own)
                found += own
            columns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True))], names=["host", "subtree", "place", "parent"])

    return run


def _own(hints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            pages, found = [], []
            for name, (host, page) in zip(part.column("page").to_pylist(), _pages(part, hints), strict=True):
                own = {h for h, free in zip(page.hashes, page.free, strict=True) if not free} | {*frames(page, host).values()}
                pages += [name] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.binary()), pa.array(found, pa.int64())], names=["page", "subtree"])

    return run


def _texts(known, hints: bool):
    """known: a broadcast of all templates, or None where each page has its own in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            owns = [known.value] * len(part) if known else [frozenset(own.as_py() or ()) for own in part.column("templates")]
            texts = [main_text(page, own, host, hints) for (host, page), own in zip(_pages(part, hints), owns, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", html: str = "html", hints: bool = True) -> DataFrame:
    """pages -> (subtree): hashes, host included, of the subtrees that recur on the host."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    found = rows.mapInArrow(_subtrees(hints), "host string, subtree long, place int, parent long").distinct()
    # a hash is of one host, so its host needn't be counted apart; whole pages are counted by host
    counts = found.groupBy("host", "subtree", "place").agg(F.count("*").alias("at")).where(f"at >= {MIN_PAGES}")
    counts = Scratch(pages.sparkSession).table(counts, "counts")
    sizes = counts.where(f"place = {WHOLE}").select(F.col("host").alias("big"), F.col("at").alias("pages"))
    shapes = counts.where(f"place = {FRAME}").join(sizes, F.col("host") == F.col("big")).where(f"at >= {FRAME_SHARE} * pages")
    met = counts.where(f"place not in ({WHOLE}, {FRAME})").groupBy("host", "subtree").agg(F.max(F.expr("if(place = 0, at, 0)")).alias("n"), F.max(F.expr("if(place <> 0, at, 0)")).alias("most"))
    prose = met.where(f"subtree & 1 = 1 and most >= {SAME_PLACE} * n").join(sizes, F.col("host") == F.col("big")).where(f"n >= {MOST_PAGES} * pages")
    return met.where("subtree & 1 = 0").select("subtree").unionByName(prose.select("subtree")).unionByName(shapes.select("subtree"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", hints: bool = True) -> DataFrame:
    """pages -> (row, text); ``row`` packs every column of pages but the html itself.  Without ``hints`` templates alone decide."""
    known = Scratch(pages.sparkSession).table(templates(pages, url, html, hints), "templates")
    rows = pages.select(packed(pages.drop(html)).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, text string"
    if known.count() <= BROADCAST_TEMPLATES:
        hashes = array("q", known.toArrow().column("subtree").combine_chunks().sort().to_numpy().tobytes())
        return rows.mapInArrow(_texts(pages.sparkSession.sparkContext.broadcast(Sorted(hashes)), hints), out)
    page = F.unhex(F.sha2(F.concat("host", F.lit("\n"), F.coalesce("html", F.lit(""))), 256)).alias("page")
    rows = rows.select("*", page)
    own = rows.dropDuplicates(["page"]).mapInArrow(_own(hints), "page binary, subtree long").join(known, "subtree")
    own = own.groupBy("page").agg(F.collect_list("subtree").alias("templates"))
    return rows.join(own, "page", "left").select("row", "host", "html", "templates").mapInArrow(_texts(None, hints), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    done = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
